"""Markdown blocks on nested samples, worked out by hand."""

from __future__ import annotations

import random

import pytest

from recollect.functions import markdown


def blocks(text: str) -> list[tuple[str, str]]:
    return [(b.kind, b.text) for b in markdown.top_blocks(text)]


@pytest.mark.parametrize(("text", "want"), [
    ("", []), ("\n \n", []), ("plain", [("paragraph", "plain")]), ("a\nb\n\nc", [("paragraph", "a b"), ("paragraph", "c")]),
    ("# Head #\nnext", [("heading", "Head"), ("paragraph", "next")]), ("#no head", [("paragraph", "#no head")]), ("####### x", [("paragraph", "####### x")]), ("# #", []), ("## a # b ##", [("heading", "a # b")]),
    ("Title\n===\nText\n---\n***\n", [("heading", "Title"), ("heading", "Text")]), ("two\nlines\n---", [("heading", "two lines")]), ("> q\n---", [("blockquote", "q")]), ("> q\n===", [("blockquote", "q ===")]), ("- a\n---", [("list", "a")]),
    ("- a\n- b\n  more\n- c", [("list", "a"), ("list", "b more"), ("list", "c")]), ("- a\nlazy", [("list", "a lazy")]), ("- a\n\nout", [("list", "a"), ("paragraph", "out")]), ("- a\n\n  in\n\n      code", [("list", "aincode")]),
    ("- a\n  - b\n    - c\n- d", [("list", "abc"), ("list", "d")]), ("- a\n  > q\n  lazy", [("list", "aq lazy")]), ("1. a\n2. b\n1) c", [("list", "a"), ("list", "b"), ("list", "c")]), ("text\n2. no item\n1. item", [("paragraph", "text 2. no item"), ("list", "item")]),
    ("text\n-\nmore", [("heading", "text"), ("paragraph", "more")]), ("text\n*\nmore", [("paragraph", "text * more")]), ("-\n\n  gone", [("paragraph", "gone")]), ("-\n  here", [("list", "here")]), ("- a\n* b", [("list", "a"), ("list", "b")]), ("-a", [("paragraph", "-a")]), ("* * *\n- - -", []), ("- * * *\n- b", [("list", "b")]),
    ("> a\n> - b\n>   c\nlazy\n\nout", [("blockquote", "ab c lazy"), ("paragraph", "out")]), ("> a\n\n> b", [("blockquote", "a"), ("blockquote", "b")]), ("> > deep\n> back", [("blockquote", "deep back")]), (">a", [("blockquote", "a")]), ("> ```\n> x\nout", [("blockquote", "x"), ("paragraph", "out")]),
    ("```py\nx = 1\n\n# y\n```\nz", [("code", "x = 1\n\n# y"), ("paragraph", "z")]), ("````\n```\n````", [("code", "```")]), ("```\n~~~\n```", [("code", "~~~")]), ("~~~ a`b\nx\n~~~~", [("code", "x")]), ("``` a`b", [("paragraph", "``` a`b")]), ("```\nnever closed", [("code", "never closed")]), ("  ```\n   x\n  y\n```", [("code", "x\ny")]), ("```\nx\n``` no end", [("code", "x\n``` no end")]),
    ("    code\n\n    more\nout", [("code", "code\n\nmore"), ("paragraph", "out")]), ("text\n    more", [("paragraph", "text more")]), ("\ttab", [("code", "tab")]), ("- a\n\n\t\tcode", [("list", "a code")]), ("1.  a\n\n    b", [("list", "ab")]), ("- x\n\n      y\n     z", [("list", "xy z")]),
    ("<div>\n*a*\n\n*b*", [("html", "<div>\n*a*"), ("paragraph", "b")]), ("text\n<div>x", [("paragraph", "text"), ("html", "<div>x")]), ("<!-- a\n\nb -->\nc", [("html", "<!-- a"), ("paragraph", "c")]), ("<!-- a --> b\nc", [("html", "<!-- a --> b"), ("paragraph", "c")]), ("<x-y a=1>\nt", [("html", "<x-y a=1>\nt")]), ("text\n<x-y>", [("paragraph", "text")]), ("<pre>\n\nx\n</pre>\ny", [("html", "<pre>\n\nx"), ("paragraph", "y")]), ("<b>bold</b> text", [("paragraph", "bold text")]),
    ("**b** *i* __u__ snake_case a*b*c ***x*** **open", [("paragraph", "b i u snake_case abc x **open")]), ("`a *b*` ``c`d`` `open", [("paragraph", "a *b* c`d `open")]), (r"\*no\* \[x](y)", [("paragraph", r"\*no\* \[x](y)")]),
    ("[t](u \"x\") ![alt](i) [a *b*](<c d>) [no] (x)", [("paragraph", "t alt a b [no] (x)")]), ("[x]: http://a \"t\"\n[y]: /b\n\n[see][x], [y] and [z]", [("paragraph", "see, y and [z]")]), ("[x]: /a\ntext", [("paragraph", "text")]), ("<http://a.b> me <a@b.c>", [("paragraph", "me")]), ("a  \nb\\\nc", [("paragraph", "a b\\ c")]),
])
def test_blocks(text, want):
    assert blocks(text) == want


def test_positions_are_bytes_of_the_text():
    text = "é\n\n- ä b\n  c\n\n> ö\n\n# ü\n\n```\n漢\n```\n\n   pära"
    for b in markdown.top_blocks(text):
        assert text.encode()[b.position :].decode().startswith(b.text.split(" ")[0])


def test_every_text_is_read():
    """Any mix of marks ends, in time, and keeps words in order."""
    rng = random.Random(3)
    parts = ["- ", "> ", "1. ", "    ", "\t", "```", "~~~", "# ", "===", "---", "<div>", "<!--", "-->", "[", "](", ")", "*", "_", "`", "\n", "\n\n", "\\", "é", " "]
    for _ in range(2000):
        words = [f"w{i}x" for i in range(rng.randint(0, 12))]
        text = "".join(rng.choice(parts) * rng.randint(0, 2) + w + rng.choice(parts) for w in words)
        found = " ".join(b.text for b in markdown.top_blocks(text))
        kept = [w for w in words if w in found]
        assert [found.index(w) for w in kept] == sorted(found.index(w) for w in kept)


def test_deep_and_long_texts():
    assert len(blocks("> " * 300 + "x")) == 1
    assert len(blocks("- " * 200 + "x")) == 1
    assert len(blocks("- a\n" * 5000)) == 5000
    assert blocks("*" * 3000 + "a") == [("paragraph", "*" * 3000 + "a")]
