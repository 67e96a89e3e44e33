"""The scanner: kinds, tiling and text of blocks."""

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from gapweave.operators.markdown import block_batches, scan

KINDS = [
    ("# T\n\nText.\n\n## S\n\nMore.\n\n- a\n- b\n\n## C\n\nBefore\n\n```go\nx := 1\n```\n\nEnd.\n", "heading paragraph heading paragraph list heading paragraph codeblock paragraph"),
    ("# M\n\nIntro\n\n$$\nE = mc^2\n$$\n\nAfter\n", "heading paragraph math_block paragraph"),
    ("# T\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> quote\nlazy\n\n---\n\nEnd\n", "heading table blockquote thematic_break paragraph"),
    ("Title\n===\n\nSub\n---\ntext\n", "heading heading paragraph"),
    ("    code\n    more\n\ntext\n", "codeblock paragraph"),
    ("<div>\n<p>x</p>\n</div>\n\ntext\n", "html_block paragraph"),
    ("- a\n\n  inside\n- b\n1. other\n", "list list"),
    ("* * *\n- - -\n___\n", "thematic_break thematic_break thematic_break"),
    ("[ref]: http://example.com\n\ntext [ref]\n", "paragraph"),
    ("text\n# not lazy\n", "paragraph heading"),
    ("~~~\n# no heading\n~~~\n", "codeblock"),
    ("text\n2. not an item\n", "paragraph"),
    ("para\n| a | b |\n|---|---|\n| 1 | 2 |\n", "paragraph table"),
    ("", ""),
    ("\n \n\t\n", ""),
]


@pytest.mark.parametrize("source, kinds", KINDS)
def test_kinds(source, kinds):
    assert " ".join(b[1] for b in scan(source.encode())) == kinds


def test_texts_levels_and_titles():
    b = scan("## A *b* `c`\n\nline one  \nline two\n\n- x\n  - y\n".encode())
    assert [(x[2], x[3], x[4]) for x in b] == [("A *b* `c`", "A b c", 2), ("line one\nline two", None, 0), ("x\ny", None, 0)]


def test_crlf_and_tabs():
    assert [(b[1], b[2]) for b in scan(b"# h\r\n\r\ntext\r\n\r\n\tcode\r\n")] == [("heading", "h"), ("paragraph", "text"), ("codeblock", "code")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=list("#-*_>|`~$<a b\n1.é[]:(\t\r"), max_size=120))
def test_blocks_tile_any_source(text):
    raw = text.encode()
    found = scan(raw)
    assert b"".join(raw[b[5] : b[6]] for b in found) == (raw if found else b"")
    assert all(b[5] < b[6] for b in found)


def test_blocks_of_a_large_batch_come_in_small_ones():
    sources = [f"line {k}\n\n".encode() * 6_000 for k in range(100)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(100), pa.int64()), "content": sources})
    found = list(block_batches(iter([batch])))
    assert max(b.nbytes for b in found) < 8 << 20
    assert b"".join(raw for b in found for raw in b.column("raw").to_pylist()) == b"".join(sources)
