"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards, every shard has a weight. A document
descends the tree: at each level each child draws ``-ln(u) / weight`` with u from
a hash of the document's id and the child's name, and the least draw wins (child
chosen in proportion to weight). A change of a weight alters the draws of that
child and its ancestors only, so documents move only between the changed subtree
and the rest. A new shard is attached as a region of its own (``grown``); then a
document moves only if the new region wins, hence only into the new shard.

Defined cases: a null doc_id draws as a key of its own; equal ids land in one
shard; a null text has size 1 and the crc32 of no bytes; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (region, rack, shard, weight): two regions of two racks of two shards of equal weight.
LAYOUT = [(f"r{s // 4}", f"k{s // 2}", s, 1.0) for s in range(8)]


def grown(layout: list[tuple], weight: float = 1.0) -> list[tuple]:
    """The layout with one more shard, in a region and rack of its own."""
    new = max(x[2] for x in layout) + 1
    return [*layout, (f"grown{new}", f"grown{new}", new, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def _winner(key: Column, children: dict[str, float], then: dict[str, Column]) -> Column:
    if len(children) == 1:
        return then[next(iter(children))]
    draws = F.array_min(F.array(*[F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, w) in enumerate(children.items())]))["i"]
    out = None
    for i, name in enumerate(children):
        out = F.when(draws == i, then[name]) if out is None else out.when(draws == i, then[name])
    return out


def shard_of(key: Column, layout: list[tuple] = LAYOUT) -> Column:
    """The shard of a key: weighted draws at the region, rack and shard level."""
    tree: dict = defaultdict(lambda: defaultdict(dict))
    for region, rack, shard, weight in layout:
        if weight > 0:
            tree[region][rack][shard] = weight
    regions, at_region = {}, {}
    for region, racks in tree.items():
        names, at_rack = {}, {}
        for rack, shards in racks.items():
            names[f"rack/{region}/{rack}"] = sum(shards.values())
            at_rack[f"rack/{region}/{rack}"] = _winner(key, {f"shard/{s}": w for s, w in shards.items()}, {f"shard/{s}": F.lit(s) for s in shards})
        regions[f"region/{region}"] = sum(names.values())
        at_region[f"region/{region}"] = _winner(key, names, at_rack)
    return _winner(key, regions, at_region)


def assign(docs: DataFrame, layout: list[tuple] = LAYOUT) -> DataFrame:
    """Documents with size, text_crc32, shard, grown_shard and slot (gapless from 0 within a shard, by doc_id).

    Slots come without gathering a shard in one task: rows are numbered within
    contiguous doc_id ranges, and each range starts after the counts of those before it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), shard_of(key, layout).alias("shard"), shard_of(key, grown(layout)).alias("grown_shard"))
    rows, _ = C.with_blocks(rows, rows_per_block=8192, most_blocks=8192)
    per = rows.groupBy("shard", "_block").agg(F.count("*").alias("n"))
    before = per.selectExpr("shard", "_block", "sum(n) over (partition by shard order by _block rows between unbounded preceding and 1 preceding) as before")
    slot = F.expr("row_number() over (partition by shard, _block order by _key, text_crc32, size)")
    return rows.withColumn("_row", slot).join(before, ["shard", "_block"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.coalesce("before", F.lit(0)) + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")
