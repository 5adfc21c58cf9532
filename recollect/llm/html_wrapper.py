"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is read as a stream of block tags and text, tags closed as HTML implies. A wrapper is
the regular expression of such streams without alternatives: at each level a list of
elements and text slots, each once, optional (?), repeated (+) or both (*), and groups of
optional parts repeated together. ``wrapper`` makes it of one page: siblings alike
fold into a repetition, siblings that come again after others into a repeated group. ``aligned``
brings two into one: parts are matched in order, a part that one side lacks becomes optional, a text that
differs becomes a slot, and repetitions are folded again. Aligning is done page by page in every
task, then between the tasks' results, so no host's pages are gathered.

Slots know in how many pages they were seen, how much text they held and how much of it inside links, and the hashes of texts
that all those pages have there. From that the wrapper's parts are judged (``judged``):

* The article is the article or main element that holds most of the host's text (text of chrome left out), if that is at least half of it;
  in a host without such an element it is the whole page.
* Within it go texts that every page of the host has there (notices, adverts, bylines of the site). A text of the article might be in all pages by
  accident, and the more so the more of the article is alike: with a share q of texts (by number or by size, the less) constant, n pages all have a given
  one with probability q ** (n - 1), and it goes once that is below ``ACCIDENT``. Copies of one page so lose nothing. Headings stay however many pages have
  them: what stands below them varies. So go elements whose text is nearly all links (menus, related pages), with the same certainty.
* What varies from page to page and is no article either (rotating adverts, comments, side notes) no alignment can tell; it goes by
  element and by the words in class, id and role.

A page is then read along its judged wrapper: text comes out only where the wrapper has a slot that stays. Elements more than ``DEPTH`` deep lie side by side
in the one at that depth, but for articles and chrome, which are told apart at any depth.

Defined cases: null or empty html gives the empty text; a null url belongs to the host ""; null ids and
repeated rows are kept; a page that breaks off is read as far as it goes; text of any length is read
whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Fixed values of HTML and of the names that pages give to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title xmp noembed noframes object canvas audio video select".split())
INLINE = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics button a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "thead": set(), "tfoot": {"tr", "td", "th", "tbody", "thead"}}
HOLDS = frozenset("ul ol menu dl table article section div main aside nav header footer form blockquote body html td th details dialog figure".split())
LISTS = frozenset("ul ol menu dl table div section".split())
CHROME_TAGS = frozenset("nav footer aside form dialog menu head search header".split()) | RAW
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification pagination popup promo promoted related share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets copyright".split()
)
#: Words that stand beside these in one name and say no more than where or what kind of box it is; a name with any other word ("share-price") is no chrome.
BOX_WORDS = frozenset("bar box block area inner outer wrap wrapper container content list links link item items button buttons icon icons top bottom left right main site page section post entry article global primary secondary mobile desktop small large inline sticky fixed".split())
#: Words that name the head and foot of a page, and within an article those of the article.
ENDS = frozenset("header footer banner masthead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 th dt caption legend summary figcaption".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())

#: Probability of an accident below which a text that all pages have is taken for the host's, and the least share that is reckoned with.
ACCIDENT, LEAST_SHARE = 0.04, 0.45
#: Nesting that is kept.
DEPTH = 100
#: Share of a host's text that its article holds at least, and of links in a list of links.
ARTICLE_SHARE, LINKS_SHARE = 0.5, 0.9
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|<(?=/?[a-zA-Z])[^>]*$|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile("[a-z]+")


class Node:
    """An element: key (tag and its naming words), and parts: nodes and (text, share of it inside links)."""

    __slots__ = ("key", "tag", "parts")

    def __init__(self, key: str, tag: str):
        self.key, self.tag, self.parts = key, tag, []


def _key(tag: str, attributes: str) -> str:
    """The tag with its naming words, the role behind "@", and "!" if a name is that of chrome ("^": of a head or foot)."""
    if not attributes or "=" not in attributes:
        return tag
    words, role, sign = set(), "", ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "role":
            role = f"@{value.strip()}"
            continue
        for token in value.split():
            own = set(_WORD.findall(token))
            words |= own
            if own & CHROME_WORDS and own <= CHROME_WORDS | BOX_WORDS:
                sign = "!" if own & (CHROME_WORDS - ENDS) else sign or "^"
    return tag + "".join(f".{w}" for w in sorted(words)) + role + sign


def tree(source: str) -> Node:
    """The page as nested tokens. Inline tags vanish, br and the like count as white space."""
    root = Node("#page", "#page")
    stack, text, linked, in_link = [root], [], 0, 0
    deep: list[int] = []

    def flush() -> None:
        nonlocal text, linked
        if text:
            whole = "".join(text)
            if words := " ".join(whole.split()):
                stack[-1].parts.append((words, linked / max(1, len(whole.strip()))))
            text, linked = [], 0

    def close(upto: int) -> None:
        flush()
        del stack[upto:]
        while deep and deep[-1] >= upto:
            deep.pop()

    raw, at, n = None, 0, len(source)
    while at < n:
        if raw is not None:  # up to its own end tag, whatever stands there
            end = re.compile(rf"</{raw}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at, raw = (end.end() if end else n), None
            continue
        m = _TOKEN.match(source, at)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                piece = html.unescape(piece) if "&" in piece else piece
                text.append(piece)
                linked += len(piece.strip()) if in_link else 0
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m[1] else 1
            continue
        if tag in RAW:
            if not m[1] and not m[4]:
                flush()
                stack[-1].parts.append(Node(_key(tag, m[3]), tag))
                raw = tag
            continue
        if tag in VOID:
            text.append(" ")
            if tag == "hr":
                flush()
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            else:
                flush()
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in SAME_CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SAME_CLOSES[tag]:
                    close(k)
                elif stack[k].tag in HOLDS and not (tag in ("td", "th", "tr", "tbody", "tfoot") and stack[k].tag in ("td", "th")):
                    break
        flush()
        if m[4] and tag not in HOLDS:
            continue
        node = Node(_key(tag, m[3]), tag)
        if len(stack) <= DEPTH or not deep and (_is_main(node.key) or _chrome(node.key)):
            stack[-1].parts.append(node)
        else:
            node.parts = stack[-1].parts  # side by side
        if len(stack) > DEPTH and _chrome(node.key):
            deep.append(len(stack))  # nothing below it is told apart
        stack.append(node)
        in_link = 0
    close(1)
    return root


# A wrapper's part is [key, how often, parts] for elements, ["#", how often, hashes of constant texts, [characters, characters in links,
# pages]] for slots (texts that every page seen so far has there; none: all vary), and ["()", how often, parts] for a group.
# How often: "1", "?", "+" or "*".


def _hash(text: str) -> int:
    """64 bits of a digest, and behind them the length (20 bits)."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") << 20 | min(len(text), 0xFFFFF)


def _wider(a: str, b: str) -> str:
    return "*" if "*" in (a, b) or {a, b} == {"?", "+"} else "+" if "+" in (a, b) else "?" if "?" in (a, b) else "1"


def _keys(part: list) -> set[str]:
    return {k for p in part[2] for k in _keys(p)} if part[0] == "()" else {part[0]}


def _joined(a: list, b: list, often: str, pages: bool) -> list:
    """Two parts of one key as one; ``pages``: of two pages (what is constant is in both), else of one (in either)."""
    if a[0] == "#":
        same = sorted(set(a[2]).intersection(b[2]) if pages else set(a[2]).union(b[2]))
        return ["#", often, same, [a[3][0] + b[3][0], a[3][1] + b[3][1], a[3][2] + b[3][2] if pages else max(a[3][2], b[3][2])]]
    return [a[0], often, aligned(a[2], b[2], pages)]


def _members(parts: list[list]) -> dict[str, list]:
    return {x[0]: [x[0], _wider("?", x[1]), *x[2:]] for p in parts for x in (p[2] if p[0] == "()" else [p])}


def _grouped(a: list[list], b: list[list], pages: bool) -> list:
    """All parts of both, each optional, as one repeated group."""
    out = _members(a)
    for k, x in _members(b).items():
        out[k] = _joined(out[k], x, _wider(out[k][1], x[1]), pages) if k in out else x
    return ["()", "+", list(out.values())]


def _folded(parts: list[list], pages: bool) -> list[list]:
    """Repetitions brought together, so that no key occurs twice."""
    out: list[list] = []
    for p in parts:
        keys = _keys(p)
        first = next((i for i, q in enumerate(out) if keys & _keys(q)), None)
        if first is None:
            out.append(p)
        elif first == len(out) - 1 and out[first][0] == p[0] != "()":
            q = out[first]
            out[first] = _joined(q, p, "*" if "?" in (q[1], p[1]) or "*" in (q[1], p[1]) else "+", pages)
        else:  # what lies between comes again as well, or may: a repeated group
            out[first:] = [_grouped(out[first:], [p], pages)]
    return out


def wrapper(node: Node) -> list[list]:
    """The wrapper of one page below a node."""
    return _folded([[p.key, "1", wrapper(p)] if isinstance(p, Node) else ["#", "1", [_hash(p[0])], [len(p[0]), round(len(p[0]) * p[1]), 1]] for p in node.parts], pages=False)


def aligned(a: list[list], b: list[list], pages: bool = True) -> list[list]:
    """The wrapper that both wrappers' pages match."""
    at = {k: i for i, p in enumerate(b) for k in _keys(p)}
    out, done = [], 0
    for p in a:
        hits = sorted({at[k] for k in _keys(p) if k in at and at[k] >= done})
        if not hits:
            out.append([p[0], _wider(p[1], "?"), *p[2:]])
            continue
        out += [[q[0], _wider(q[1], "?"), *q[2:]] for q in b[done : hits[0]]]
        q = b[hits[0]]
        done = hits[0] + 1
        if p[0] == q[0] and p[0] != "()":
            out.append(_joined(p, q, _wider(p[1], q[1]), pages))
        else:
            out.append(_grouped([p], [q], pages))
    out += [[q[0], _wider(q[1], "?"), *q[2:]] for q in b[done:]]
    return _folded(out, pages)


def written(parts: list[list]) -> str:
    """The wrapper as a regular expression over tags."""
    show = lambda p: {"1": ""}.get(p[1], p[1])
    return "".join(("#same" if p[2] else "#text") + show(p) if p[0] == "#" else f"({written(p[2])}){show(p)}" if p[0] == "()" else f"(<{p[0]}>{written(p[2])}</>){show(p)}" for p in parts)


def _chrome(key: str) -> bool:
    named, _, role = key.rstrip("!^").partition("@")
    tag = named.split(".")[0]
    return tag in CHROME_TAGS or role in CHROME_ROLES or (tag not in ("html", "body", "article", "main") and key[-1] in "!^")


def _is_main(key: str) -> bool:
    named, _, role = key.rstrip("!^").partition("@")
    return named.split(".")[0] in ("article", "main") or role == "main"


def _text(parts: list[list]) -> tuple[int, int]:
    """Characters of all slots but those of chrome, and how many of them are inside links."""
    n = links = 0
    for p in parts:
        if p[0] == "#":
            a, b = p[3][0], p[3][1]
        elif p[0] != "()" and _chrome(p[0]):
            continue
        else:
            a, b = _text(p[2])
        n, links = n + a, links + b
    return n, links


def _mains(parts: list[list]) -> Iterator[list]:
    """The outermost article and main elements outside of chrome."""
    for p in parts:
        if p[0] == "#":
            continue
        if p[0] != "()" and _is_main(p[0]):
            yield p
        elif p[0] == "()" or not _chrome(p[0]):
            yield from _mains(p[2])


class Judged:
    """What of a host's wrapper is text of the article: for each part by its key whether it stays, its constant texts, and its own parts."""

    __slots__ = ("article", "constant", "parts", "stays")

    def __init__(self, article: bool, stays: bool, constant: frozenset, parts: dict[str, Judged]):
        self.article, self.stays, self.constant, self.parts = article, stays, constant, parts


def judged(parts: list[list], pages: int) -> tuple[dict[str, Judged], bool]:
    """The wrapper's parts judged, and whether the host has an article element."""
    best = max(_mains(parts), key=lambda p: _text(p[2])[0], default=None)
    if best is not None and _text(best[2])[0] < ARTICLE_SHARE * _text(parts)[0]:
        best = None
    known = [p for p in _slots(best[2] if best is not None else parts) if p[3][1] < LINKS_SHARE * p[3][0]]
    constant = sum(len(p[2]) for p in known), sum(x & 0xFFFFF for p in known for x in p[2]) * pages
    q = min(constant[0] / max(1, sum(max(len(p[2]), 1) for p in known)), constant[1] / max(1, sum(p[3][0] for p in known)))

    def certain(n: int, share: float = LEAST_SHARE) -> bool:
        """Whether what n pages have is the host's and no accident."""
        return max(share, LEAST_SHARE) ** (n - 1) < ACCIDENT

    def down(inner: list[list], inside: bool, heading: bool) -> dict[str, Judged]:
        out = {}
        for p in inner:
            for x in p[2] if p[0] == "()" else [p]:
                if x[0] == "#":
                    fixed = frozenset(x[2]) if not heading and certain(x[3][2], q) else frozenset()
                    out["#"] = Judged(False, inside, fixed, {})
                    continue
                tag = x[0].rstrip("!^").split("@")[0].split(".")[0]
                article = x is best or (best is not None and x[0] == best[0] and not inside and _is_main(x[0]))
                within = inside or article
                # Within an article, its own head and foot are none of the page's.
                own = within and best is not None and ((tag == "header" and x[0][-1] != "!") or (x[0][-1] == "^" and tag not in CHROME_TAGS))
                n, links = _text(x[2])
                listing = within and not article and tag in LISTS and links >= LINKS_SHARE * max(1, n) and certain(_pages(x[2]))
                out[x[0]] = Judged(article, (not _chrome(x[0]) or own) and not listing, frozenset(), down(x[2], within, tag in HEADINGS))
        return out

    return down(parts, best is None, False), best is not None


def _slots(parts: list[list]) -> Iterator[list]:
    for p in parts:
        if p[0] == "#":
            yield p
        elif p[0] == "()" or not _chrome(p[0]):
            yield from _slots(p[2])


def _pages(parts: list[list]) -> int:
    return max((p[3][2] for p in _slots(parts)), default=0)


class Reader:
    """Reads pages along one wrapper of ``pages`` pages."""

    def __init__(self, parts: list[list], pages: int):
        self.parts, self.has_article = judged(parts, pages)
        # A page that lacks the article its host otherwise has is read like those of hosts without one.
        self.plain = _without_article(parts) if self.has_article else self.parts

    def read(self, source: str) -> str:
        page = tree(source)
        blocks: list[str] = []
        found = self.has_article and self._holds(page, self.parts)
        self._walk(page, self.parts if found else self.plain, blocks, found)
        return " ".join(blocks)

    def _holds(self, node: Node, parts: dict[str, Judged]) -> bool:
        for p in node.parts:
            if isinstance(p, Node) and (q := parts.get(p.key)) is not None and (q.article or q.stays and self._holds(p, q.parts)):
                return True
        return False

    def _walk(self, node: Node, parts: dict[str, Judged], blocks: list[str], found: bool) -> None:
        slot = parts.get("#")
        for p in node.parts:
            if isinstance(p, Node):
                q = parts.get(p.key)
                if q is not None and q.stays:
                    self._walk(p, q.parts, blocks, found)
            elif slot is not None and slot.stays and (not slot.constant or _hash(p[0]) not in slot.constant) and (found or p[1] < LINKS_SHARE):
                blocks.append(p[0])


def _without_article(parts: list[list]) -> dict[str, Judged]:
    """Judged as if no element were an article: all that is not chrome stays."""
    out = {}
    for p in parts:
        for x in p[2] if p[0] == "()" else [p]:
            out[x[0]] = Judged(False, True, frozenset(), {}) if x[0] == "#" else Judged(False, not _chrome(x[0]), frozenset(), _without_article(x[2]))
    return out


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


_PARTS = "host string, pages long, wrapper string, part int"


def _fold_rows(rows: Iterator[tuple[str, int, list[list]]], part: int, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Wrappers of equal hosts aligned; at most ``most`` hosts are held, then all are handed on."""
    held: dict[str, tuple[int, list[list]]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([json.dumps(w) for _, w in held.values()], pa.string()), pa.array([part] * len(held), pa.int32())], ["host", "pages", "wrapper", "part"])

    for host, n, w in rows:
        if host in held:
            held[host] = held[host][0] + n, aligned(held[host][1], w)
        else:
            if len(held) >= most:
                yield out()
                held.clear()
            held[host] = n, w
    if held:
        yield out()


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper as JSON) of every host, from all its pages."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((h, 1, wrapper(tree(x or ""))) for b in batches for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from _fold_rows(rows, TaskContext.get().partitionId() % 32)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((h, n, json.loads(w)) for b in batches for h, n, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        yield from _fold_rows(rows, 0, most=1)  # sorted by host

    got = pages.select(_host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(first, _PARTS)
    # A host of very many pages comes from all tasks: their wrappers are aligned in 32 parts first.
    got = got.repartition("host", "part").sortWithinPartitions("host").mapInArrow(again, _PARTS)
    return C.saved(got.repartition("host").sortWithinPartitions("host").mapInArrow(again, _PARTS).select("host", "pages", "wrapper"))


def extracted(pages: DataFrame, most_broadcast: int = 16_000_000, salts: int = 16) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Tasks get each wrapper once: all of them, if they are ``most_broadcast`` characters at most; else pages are dealt by host, pages of a hot host to
    ``salts`` tasks, and every part of a host begins with its wrapper.
    """
    found = wrappers(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", _host(F.col("url")))
    size = found.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0]
    schema = "page_id long, url string, text string, n_chars long"

    def answer(ids: list, urls: list, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if size <= most_broadcast:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: (r.wrapper, r.pages) for r in found.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            readers: dict[str, Reader] = {}
            for b in batches:
                texts = []
                for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                    if host not in readers:
                        if len(readers) > 500:
                            readers.clear()
                        w, n = shared.value[host]
                        readers[host] = Reader(json.loads(w), n)
                    texts.append(readers[host].read(source or ""))
                yield answer(b.column("page_id").to_pylist(), b.column("url").to_pylist(), texts)

        return rows.mapInArrow(run, schema)

    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("page_id", "long"), ("url", "string"), ("html", "string"))]
    first = found.select(*none, "host", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), "pages", "wrapper")
    dealt = rows.select("page_id", "url", "html", "host", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("_salt"), F.lit(None).cast("long").alias("pages"), F.lit(None).cast("string").alias("wrapper"))
    both = first.unionByName(dealt).repartition("host", "_salt").sortWithinPartitions("host", "_salt", F.col("wrapper").isNull())

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for b in batches:
            ids, urls, texts = [], [], []
            for page_id, url, source, w, n in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "wrapper", "pages")), strict=True):
                if w is not None:
                    reader = Reader(json.loads(w), n)
                    continue
                ids.append(page_id)
                urls.append(url)
                texts.append(reader.read(source or ""))
            yield answer(ids, urls, texts)

    return both.mapInArrow(along, schema)
