"""Each stage of the pipeline against brute force over its own input."""

from __future__ import annotations

import collections
import hashlib
import re

import oracle

import corpus_pipeline
from recollect.llm import common, quality


def test_stages(spark, tmp_path):
    sf = oracle.SF_DIR
    docs = common.read(spark, sf, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == docs.columns
        rows = after.collect()
        if name == "quality":
            model = quality.fit(docs, common.read(spark, sf, "labels"))
            passes = model.score(quality.features([r.text for r in before])) >= quality.THRESHOLD
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r, ok in zip(before, passes, strict=True) if ok)
            bad = {r.doc_id for r in common.read(spark, sf, "labels").where("quality = 0").collect()}
            good = {r.doc_id for r in common.read(spark, sf, "labels").where("quality = 1").collect()}
            kept = {r.doc_id for r in rows}
            assert len(kept & bad) <= 0.02 * len(bad) and len(kept & good) >= 0.99 * len(good)
        elif name == "lines":
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before)
            count = collections.Counter(x for r in rows for x in set(r.text.split("\n")))
            assert all(count[x] == 1 for r in before for x in r.text.split("\n") if len(x.split()) >= 50)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near copies":
            from llm.test_ops import brute

            classes = brute([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in rows) == sorted({c for _, c, *_ in classes})
        elif name == "benchmark":
            norm = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
            items = [norm(r.text) for r in common.read(spark, sf, "benchmark").collect()]
            leaky = {r.doc_id for r in before if any(i in norm(r.text) for i in items)}
            assert leaky and {r.doc_id for r in before} - {r.doc_id for r in rows} == leaky
        else:
            texts = {r.doc_id: r.text for r in before}
            assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
        docs = after


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
