"""Blocks of a Markdown text, line by line, with a stack of open containers.

Every line first goes through the containers that are open (quotes by ``>``, list items by their indent), then may open new blocks, and what is
left belongs to a leaf: paragraph, heading, code, HTML. A line that meets none of the open containers still goes on with an open paragraph
(lazy continuation). ``top_blocks`` gives the blocks that stand for themselves: each item of a top-level list, each quote, paragraph, heading, code
and HTML block, with the text below it and the byte where that begins.

A subset of CommonMark: links by reference are known where their definition comes before any other text of a paragraph.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

# Elements that begin an HTML block wherever a line begins with them.
HTML_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe "
    "legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_ATTRIBUTE = r"""\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
_TAG = rf"(?:<[A-Za-z][\w-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][\w-]*\s*>)"
#: How an HTML block begins, and how it ends (None: with a blank line).
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile("<!--"), re.compile("-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile("<![A-Za-z]"), re.compile(">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(HTML_BLOCKS.split())})(?:\s|/?>|$)", re.I), None),
]
LONE_TAG = re.compile(rf"{_TAG}\s*$")
HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)(.*?)(?:(?<=[ \t])#+)?[ \t]*$")
UNDERLINE = re.compile(r"(?:=+|-+)[ \t]*$")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
MARKER = re.compile(r"([-+*])|(\d{1,9})([.)])")
DEFINITION = re.compile(r"""\s{0,3}\[((?:[^\[\]\\]|\\.)+)\]:\s*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]+(?:"[^"]*"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)""")


@dataclass
class Block:
    kind: str  # document, list, item, quote, paragraph, heading, fence, code, html
    children: list[Block] = field(default_factory=list)
    lines: list[tuple[str, int]] = field(default_factory=list)  # text and its byte
    open: bool = True
    indent: int = 0  # item: columns of its content; fence: its own
    mark: str = ""  # list: marker; fence: its signs
    end: re.Pattern | None = None


class Line:
    """A line that is read from the left; a tab reaches to the next column that four divides, and may be used up in part."""

    def __init__(self, text: str, at: int):
        self.text, self.at, self.i, self.col, self.spare = text, at, 0, 0, 0

    def indent(self) -> int:
        """Columns of white space from here on."""
        col, i = self.col + self.spare, self.i
        start = self.col
        while i < len(self.text) and self.text[i] in " \t":
            col += 4 - col % 4 if self.text[i] == "\t" else 1
            i += 1
        return col - start

    def skip(self, columns: int) -> None:
        """Goes on by so many columns of white space, at most."""
        while columns > 0:
            if self.spare:
                self.spare, self.col, columns = self.spare - 1, self.col + 1, columns - 1
            elif self.i < len(self.text) and self.text[self.i] in " \t":
                self.spare = 4 - self.col % 4 if self.text[self.i] == "\t" else 1
                self.i += 1
            else:
                return

    def take(self, n: int) -> None:
        """Goes on by n characters that are no white space."""
        self.i, self.col = self.i + n, self.col + n

    def rest(self) -> str:
        return " " * self.spare + self.text[self.i :]

    def blank(self) -> bool:
        return not self.text[self.i :].strip()

    def byte(self) -> int:
        return self.at + len(self.text[: self.i].encode("utf-8", "surrogatepass"))


def parse(text: str) -> tuple[Block, set[str]]:
    """The document's block, and the names of its link definitions."""
    document, at = Block("document"), 0
    names: set[str] = set()
    for raw in text.split("\n"):
        _add(document, Line(raw.rstrip("\r"), at), names)
        at += len(raw.encode("utf-8", "surrogatepass")) + 1
    _close(document, names)
    return document, names


def _close(block: Block, names: set[str]) -> None:
    while block.children and block.children[-1].open:
        block.open = False
        block = block.children[-1]
    block.open = False
    if block.kind == "paragraph":
        _take_definitions(block, names)


def _take_definitions(block: Block, names: set[str]) -> None:
    """Link definitions at a paragraph's beginning are no text."""
    while block.lines and block.lines[0][0].startswith("["):
        m = DEFINITION.match("\n".join(x for x, _ in block.lines))
        if not m:
            return
        names.add(" ".join(m[1].split()).casefold())
        del block.lines[: m[0].rstrip("\n").count("\n") + 1]


def _goes_on(block: Block, line: Line) -> bool:
    """Whether an open container holds the line; uses up what shows that."""
    if block.kind == "quote":
        if line.indent() > 3 or line.blank():
            return False
        line.skip(3)
        if line.text[line.i : line.i + 1] != ">":
            return False
        line.take(1)
        line.skip(1)
        return True
    if block.kind == "item":
        if line.blank():
            block.open = bool(block.children)  # an item can't begin with two blank lines
            return block.open
        if line.indent() < block.indent:
            return False
        line.skip(block.indent)
    return True


def _add(document: Block, line: Line, names: set[str]) -> None:
    path = [document]
    while path[-1].children and path[-1].children[-1].open and path[-1].children[-1].kind in ("list", "item", "quote") and _goes_on(path[-1].children[-1], line):
        path.append(path[-1].children[-1])
    here = path[-2] if path[-1].kind == "list" else path[-1]  # a list that none of its items goes on in stays open for another item
    leaf = here.children[-1] if here.children and here.children[-1].open else None
    if leaf and leaf.kind in ("fence", "html", "code") and _leaf_goes_on(leaf, line, names):
        return
    tip = document
    while tip.children and tip.children[-1].open:
        tip = tip.children[-1]
    lazy = tip.kind == "paragraph" and tip is not leaf  # an open paragraph within containers that the line has left
    started = False
    while not line.blank():
        paragraph = here.children[-1] if here.children and here.children[-1].open and here.children[-1].kind == "paragraph" else None
        new = _opened(here, line, paragraph, lazy and not started, names)
        if new is None:
            break
        started = True
        if new.kind not in ("list", "item", "quote"):
            return
        here = new
    if line.blank():
        if here.children and here.children[-1].open and here.children[-1].kind in ("paragraph", "quote"):
            _close(here.children[-1], names)
        return
    if lazy and not started:
        line.skip(line.indent())
        tip.lines.append((line.rest(), line.byte()))
        return
    paragraph = here.children[-1] if here.children and here.children[-1].open and here.children[-1].kind == "paragraph" else None
    if paragraph is None:
        paragraph = _child(here, Block("paragraph"), names)
    line.skip(line.indent())
    paragraph.lines.append((line.rest(), line.byte()))


def _child(here: Block, block: Block, names: set[str]) -> Block:
    """Puts a new block below ``here``; what is open there is closed."""
    if here.children and here.children[-1].open:
        _close(here.children[-1], names)
    here.children.append(block)
    return block


def _leaf_goes_on(leaf: Block, line: Line, names: set[str]) -> bool:
    if leaf.kind == "fence":
        m = FENCE.match(line.rest().lstrip(" \t"))
        sign = (m[1] or m[3]) if m else ""
        if line.indent() <= 3 and sign[:1] == leaf.mark[:1] and len(sign) >= len(leaf.mark) and not (m[2] or m[4] or "").strip():
            leaf.open = False
        else:
            line.skip(min(leaf.indent, line.indent()))
            leaf.lines.append((line.rest(), line.byte()))
        return True
    if leaf.kind == "code":
        if line.indent() < 4 and not line.blank():
            leaf.open = False
            return False
        line.skip(4)
        leaf.lines.append((line.rest(), line.byte()))
        return True
    if leaf.end is None and line.blank():
        leaf.open = False
        return False
    if leaf.end is not None and leaf.end.search(line.rest()):  # the line that ends a block belongs to none
        leaf.open = False
    else:
        leaf.lines.append((line.rest(), line.byte()))
    return True


def _opened(here: Block, line: Line, paragraph: Block | None, lazy: bool, names: set[str]) -> Block | None:
    """The block that begins here, if any does."""
    indent = line.indent()
    if indent >= 4:
        if paragraph is not None or lazy:
            return None
        line.skip(4)
        block = _child(here, Block("code"), names)
        block.lines.append((line.rest(), line.byte()))
        return block
    rest = line.rest().lstrip(" \t")
    kind, made = None, None
    if rest[0] == ">":
        kind = "quote"
    elif HEADING.match(rest):
        kind = "heading"
    elif FENCE.match(rest):
        kind = "fence"
    elif rest[0] == "<":
        made = next(((e,) for b, e in HTML if b.match(rest)), None) or (((None,) if LONE_TAG.match(rest) and paragraph is None and not lazy else None))
        kind = "html" if made else None
    if kind is None and paragraph is not None and paragraph.lines and UNDERLINE.match(rest):
        _take_definitions(paragraph, names)
        if paragraph.lines:
            paragraph.kind, paragraph.open = "heading", False
            return paragraph
    if kind is None and RULE.match(rest):
        kind = "rule"
    marked = _marker(line, paragraph is not None) if kind is None else None
    if kind is None and marked is None:
        return None
    if marked:
        known = here.children[-1] if here.children and here.children[-1].open and here.children[-1].kind == "list" and here.children[-1].mark == marked[0] else None
        return _item(known or _child(here, Block("list", mark=marked[0]), names), line, marked, names)
    line.skip(indent)
    if kind == "quote":
        line.take(1)
        line.skip(1)
        return _child(here, Block("quote"), names)
    block = _child(here, Block(kind), names)
    if kind == "heading":
        m = HEADING.match(rest)
        block.lines.append((m[2].strip(), line.byte() + len(rest[: m.start(2)].encode("utf-8", "surrogatepass"))))
    elif kind == "fence":
        m = FENCE.match(rest)
        block.mark, block.indent = m[1] or m[3], indent
        return block
    elif kind == "html":
        block.lines.append((rest, line.byte()))
        block.end = made[0]
        block.open = not (block.end and block.end.search(rest))
        return block
    block.open = False
    return block


def _marker(line: Line, interrupts: bool) -> tuple[str, int, int] | None:
    """(kind of list, length of the marker, columns to the content) of a list item that begins here."""
    rest = line.rest().lstrip(" \t")
    m = MARKER.match(rest)
    if not m or rest[m.end() : m.end() + 1] not in ("", " ", "\t"):
        return None
    empty = not rest[m.end() :].strip()
    if interrupts and (empty or (m[2] and int(m[2]) != 1)):
        return None
    return m[1] or m[3], m.end(), line.indent()


def _item(into: Block, line: Line, marked: tuple[str, int, int], names: set[str]) -> Block:
    _, length, indent = marked
    line.skip(indent)
    line.take(length)
    spaces = line.indent()
    inner = 1 if line.blank() or spaces > 4 else spaces
    line.skip(inner)
    return _child(into, Block("item", indent=indent + length + inner), names)


# ---- text

_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_AUTO = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
_RAW = re.compile(rf"{_TAG}|<!--.*?-->|<\?.*?\?>|<![A-Z].*?>", re.S)
_TARGET = re.compile(r"""\(\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\([^\s()]*\))*)(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def inline(text: str, names: set[str]) -> str:
    """A paragraph's text without emphasis marks, link targets, tags and autolinks; code spans without their ticks."""
    out: list[str] = []
    marks: list[list] = []  # sign, place in out, length left, opens, closes, length
    brackets: list[tuple[int, int, bool]] = []  # places in out and marks where a bracket opened, and whether it is an image's
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out.append(text[i : i + 2])
            i += 2
        elif c == "`" and (m := _CODE.match(text, i)):
            inner = m[2].replace("\n", " ")
            out.append(inner[1:-1] if len(inner) > 2 and inner[0] == inner[-1] == " " and inner.strip() else inner)
            i = m.end()
        elif c == "`":
            n = len(text) - i - len(text[i:].lstrip("`"))
            out.append("`" * n)
            i += n
        elif c == "<" and (m := _AUTO.match(text, i) or _RAW.match(text, i)):
            i = m.end()
        elif c in "*_":
            n = len(text) - i - len(text[i:].lstrip(c))
            before, after = text[i - 1 : i] if i else " ", text[i + n : i + n + 1] or " "
            left = not after.isspace() and (after not in _PUNCTUATION or before.isspace() or before in _PUNCTUATION)
            right = not before.isspace() and (before not in _PUNCTUATION or after.isspace() or after in _PUNCTUATION)
            opens = left and (c == "*" or not right or before in _PUNCTUATION)
            closes = right and (c == "*" or not left or after in _PUNCTUATION)
            marks.append([c, len(out), n, opens, closes, n])
            out.append(c * n)
            i += n
        elif c == "[" or text.startswith("![", i):
            brackets.append((len(out), len(marks), c == "!"))
            out.append("![" if c == "!" else "[")
            i += len(out[-1])
        elif c == "]" and brackets:
            place, first, image = brackets.pop()
            end = _link_end(text, i, "".join(out[place + 1 :]), names)
            if end is None:
                out.append("]")
                i += 1
                continue
            _emphasis(marks, first, out)
            out[place] = ""
            if not image:  # no link holds another
                brackets = [b for b in brackets if b[2]]
            i = end
        else:
            out.append(c)
            i += 1
    _emphasis(marks, 0, out)
    return "".join(out)


def _link_end(text: str, at: int, inner: str, names: set[str]) -> int | None:
    """Where a link whose text ends at a bracket ends, or None if it is none."""
    m = _TARGET.match(text, at + 1)
    if m:
        return m.end()
    known = lambda label: " ".join(label.split()).casefold() in names
    m = _LABEL.match(text, at + 1)
    if m and m[1].strip():
        return m.end() if known(m[1]) else None
    if known(inner):
        return m.end() if m else at + 1
    return None


def _emphasis(marks: list[list], first: int, out: list[str]) -> None:
    """Takes away the marks from ``first`` on that open and close emphasis; those left are text."""
    for j in range(first, len(marks)):
        closer = marks[j]
        while closer[2] and closer[4]:
            opener = next((o for o in reversed(marks[first:j]) if o[0] == closer[0] and o[2] and o[3] and not ((o[4] or closer[3]) and (o[5] + closer[5]) % 3 == 0 and (o[5] % 3 or closer[5] % 3))), None)
            if opener is None:
                break
            n = 2 if opener[2] >= 2 and closer[2] >= 2 else 1
            for m in marks[marks.index(opener) + 1 : j]:
                m[3] = False
            for m in (opener, closer):
                m[2] -= n
                out[m[1]] = m[0] * m[2]
    del marks[first:]


class Top(NamedTuple):
    kind: str
    position: int
    text: str


def _text(block: Block, names: set[str]) -> str:
    if block.kind in ("paragraph", "heading"):
        return inline("\n".join(x for x, _ in block.lines).rstrip(), names).replace("\n", " ")
    if block.kind in ("fence", "code"):
        return "".join(f"{x}\n" for x, _ in block.lines)
    return "".join(_text(c, names) for c in block.children)  # a rule or HTML within a container has no text


def _first(block: Block) -> int | None:
    found = [p for _, p in block.lines[:1]] + [p for c in block.children if (p := _first(c)) is not None]
    return min(found, default=None)


def top_blocks(text: str) -> list[Top]:
    """The blocks of a text that stand for themselves and hold any text."""
    document, names = parse(text)
    kinds = {"item": "list", "quote": "blockquote", "paragraph": "paragraph", "heading": "heading", "fence": "code", "code": "code", "html": "html"}
    out = []
    for block in document.children:
        for b in block.children if block.kind == "list" else [block]:
            if b.kind not in kinds:
                continue
            if b.kind in ("fence", "code", "html"):
                found = "\n".join(x for x, _ in b.lines).strip()
            else:
                found = " ".join(_text(b, names).split())
            if found:
                out.append(Top(kinds[b.kind], _first(b) or 0, found))
    return out
