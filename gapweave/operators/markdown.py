"""A block-level CommonMark scanner with GFM tables and ``$$`` math, for one document at a time.

Only top-level blocks are told apart; what stands inside lists and quotes belongs to them. Blocks begin at the start
of their first line, the first at byte 0, and each ends where the next begins, so that they tile the source. Link
reference definitions and blank lines make no block and go to the one before them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schema import RAW_BLOCKS

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})(.*)$")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})([.)]))(?=[ \t]|$)([ \t]*)")
DEFINITION = re.compile(r" {0,3}\[[^\]\n]+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
MATH = re.compile(r" {0,3}\$\$")
#: What begins and ends HTML blocks of the first five kinds, and the tag names of the sixth.
HTML_RAW = ((re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)), (re.compile(r"<!--"), re.compile(r"-->")), (re.compile(r"<\?"), re.compile(r"\?>")), (re.compile(r"<![A-Za-z]"), re.compile(r">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")))
HTML_NAMES = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
HTML_BLOCK = re.compile(rf"</?(?:{'|'.join(HTML_NAMES.split())})(?:\s|/?>|$)", re.I)
HTML_TAG = re.compile(r"(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$")
INLINE = ((re.compile(r"`+([^`]+)`+"), r"\1"), (re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"), (re.compile(r"(?<!\w)([*_])(?=\S)(.+?)(?<=\S)\1(?!\w)"), r"\2"), (re.compile(r"</?[A-Za-z][^>]*>"), ""))


def plain(text: str) -> str:
    """A heading's title: its text without emphasis, code, link and tag marks."""
    for pattern, to in INLINE:
        text = pattern.sub(to, text)
    return text.strip()


def cells(row: str) -> int:
    return len(re.split(r"(?<!\\)\|", row.strip().strip("|")))


class Scanner:
    def __init__(self, content: bytes):
        raw = content.split(b"\n")
        self.lines = [line.decode("utf-8", "replace").rstrip("\r").expandtabs(4) if b"\t" in line[:8] else line.decode("utf-8", "replace").rstrip("\r") for line in raw]
        self.size, self.begins, at = len(content), [], 0
        for line in raw:
            self.begins.append(at)
            at += len(line) + 1
        self.found: list[tuple[int, str, str, str | None, int]] = []  # first line, kind, text, title, level

    def blank(self, i: int) -> bool:
        return not self.lines[i].strip()

    def html_end(self, i: int, in_paragraph: bool) -> re.Pattern | str | None:
        """How an HTML block that begins here ends: at a pattern, at a blank line, or None where there is none."""
        body = self.lines[i]
        body = body.lstrip(" ") if len(body) - len(body.lstrip(" ")) <= 3 else ""
        for start, end in HTML_RAW:
            if start.match(body):
                return end
        if HTML_BLOCK.match(body):
            return "blank"
        return "blank" if not in_paragraph and HTML_TAG.match(body) else None

    def interrupts(self, i: int) -> bool:
        """Whether line i ends a paragraph before it."""
        line = self.lines[i]
        item = ITEM.match(line)
        opens_item = item and line[item.end() :].strip() and (item[3] is None or int(item[3]) == 1)
        return bool(self.blank(i) or ATX.match(line) or FENCE.match(line) or RULE.match(line) or QUOTE.match(line) or opens_item or MATH.match(line) or self.html_end(i, True))

    def emit(self, i: int, kind: str, text: str, title: str | None = None, level: int = 0) -> None:
        self.found.append((i, kind, text, title, level))

    def scan(self) -> list[tuple[int, str, str, str | None, int]]:
        i, n = 0, len(self.lines)
        while i < n:
            i = i + 1 if self.blank(i) else self.block(i, n)
        return self.found

    def block(self, i: int, n: int) -> int:
        line = self.lines[i]
        if line.startswith("    "):
            return self.indented(i, n)
        if m := ATX.match(line):
            text = (m[2] or "").strip()
            self.emit(i, "heading", "" if re.fullmatch("#+", text) else text, plain(text), len(m[1]))
            return i + 1
        if m := FENCE.match(line):
            return self.fenced(i, n, m[1])
        if RULE.match(line):
            self.emit(i, "thematic_break", "")
            return i + 1
        if MATH.match(line):
            return self.math(i, n)
        if QUOTE.match(line):
            return self.quote(i, n)
        if m := ITEM.match(line):
            return self.list(i, n, m)
        if end := self.html_end(i, False):
            return self.html(i, n, end)
        return self.paragraph(i, n)

    def indented(self, i: int, n: int) -> int:
        last, j = i, i
        while j < n and (self.blank(j) or self.lines[j].startswith("    ")):
            last, j = (j if not self.blank(j) else last), j + 1
        self.emit(i, "codeblock", "\n".join(self.lines[k][4:] for k in range(i, last + 1)))
        return last + 1

    def fenced(self, i: int, n: int, mark: str) -> int:
        close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
        j = i + 1
        while j < n and not close.match(self.lines[j]):
            j += 1
        self.emit(i, "codeblock", "\n".join(self.lines[i + 1 : j]))
        return j + 1

    def math(self, i: int, n: int) -> int:
        first = self.lines[i].strip()[2:]
        if "$$" in first:
            self.emit(i, "math_block", first.split("$$")[0].strip())
            return i + 1
        j = i + 1
        while j < n and "$$" not in self.lines[j]:
            j += 1
        inner = [first, *self.lines[i + 1 : j], *([self.lines[j].split("$$")[0]] if j < n else [])]
        self.emit(i, "math_block", "\n".join(x for x in inner if x.strip()))
        return j + 1

    def quote(self, i: int, n: int) -> int:
        j, inner, lazy = i, [], False
        while j < n:
            if m := QUOTE.match(self.lines[j]):
                inner.append(self.lines[j][m.end() :])
                lazy = bool(inner[-1].strip()) and not ATX.match(inner[-1]) and not FENCE.match(inner[-1])
            elif lazy and not self.interrupts(j):
                inner.append(self.lines[j].strip())
            else:
                break
            j += 1
        self.emit(i, "blockquote", "\n".join(x.strip() for x in inner if x.strip()))
        return j

    def list(self, i: int, n: int, m: re.Match) -> int:
        kind = m[4] or m[2]
        indent = len(m[0]) if 1 <= len(m[5]) <= 4 and self.lines[i][m.end() :] else len(m[1]) + len(m[2]) + 1
        j, last, inner, lazy, fence = i + 1, i, [self.lines[i][m.end() :]], bool(self.lines[i][m.end() :].strip()), None
        while j < n:
            line = self.lines[j]
            inside = len(line) - len(line.lstrip(" ")) >= indent
            if self.blank(j):
                lazy, j = False, j + 1
                continue
            item = ITEM.match(line)
            if inside:
                inner.append(line[indent:])
                lazy = True
            elif item and (item[4] or item[2]) == kind and not RULE.match(line):
                indent = len(item[0]) if 1 <= len(item[5]) <= 4 and line[item.end() :] else len(item[1]) + len(item[2]) + 1
                inner.append(line[item.end() :])
                lazy = bool(line[item.end() :].strip())
            elif lazy and not self.interrupts(j) and not item:
                inner.append(line.strip())
            else:
                break
            last, j = j, j + 1
        texts = [ITEM.sub("", x.strip(), count=1) if ITEM.match(x.strip()) else x.strip() for x in inner]
        self.emit(i, "list", "\n".join(x for x in texts if x))
        return last + 1

    def html(self, i: int, n: int, end: re.Pattern | str) -> int:
        j = i
        if end == "blank":
            while j < n and not self.blank(j):
                j += 1
        else:
            while j < n and not end.search(self.lines[j]):
                j += 1
            j += 1
        self.emit(i, "html_block", "\n".join(self.lines[i : min(j, n)]))
        return j

    def paragraph(self, i: int, n: int) -> int:
        while i < n and DEFINITION.match(self.lines[i]):
            i += 1
        if i == n or self.interrupts(i):
            return i
        j = i
        while True:
            j += 1
            if j == n or self.blank(j):
                break
            if m := SETEXT.match(self.lines[j]):
                text = "\n".join(x.strip() for x in self.lines[i:j])
                self.emit(i, "heading", text, plain(text.replace("\n", " ")), 1 if m[1][0] == "=" else 2)
                return j + 1
            if DELIMITER.match(self.lines[j]) and "|" in self.lines[j - 1] + self.lines[j] and cells(self.lines[j]) == cells(self.lines[j - 1]):
                return self.table(i, j, n)
            if self.interrupts(j):
                break
        self.emit(i, "paragraph", "\n".join(x.strip() for x in self.lines[i:j]))
        return j

    def table(self, i: int, delimiter: int, n: int) -> int:
        """The row before the delimiter heads the table; earlier lines are a paragraph."""
        head = delimiter - 1
        if head > i:
            self.emit(i, "paragraph", "\n".join(x.strip() for x in self.lines[i:head]))
        j = delimiter + 1
        while j < n and not self.blank(j) and not self.interrupts(j):
            j += 1
        rows = [self.lines[head], *self.lines[delimiter + 1 : j]]
        self.emit(head, "table", "\n".join(" ".join(c.strip() for c in re.split(r"(?<!\\)\|", r.strip().strip("|"))) for r in rows))
        return j


def scan(content: bytes) -> list[tuple[int, str, str, str | None, int, int, int]]:
    """block_idx, kind, text, title, heading_level, start_byte, end_byte of a document's blocks in order."""
    scanner = Scanner(content)
    found = scanner.scan()
    starts = [0, *(scanner.begins[f[0]] for f in found[1:])]
    ends = [*starts[1:], scanner.size]
    return [(k, kind, text, title, level, starts[k], ends[k]) for k, (_, kind, text, title, level) in enumerate(found)]


#: Stands at both ends of each line of a text that is shown as it is, so that no line is blank or begins with a mark.
GUARD = "\ufdd0" * 3
GUARDED = re.compile(rf"^{GUARD}([^\n]*){GUARD}$", re.M)
GUARDED_BYTES = re.compile(rf"^(#+ |){GUARD}([^\n]*){GUARD}$".encode(), re.M)


def as_shown(content: bytes, found: list[tuple]) -> list[tuple]:
    """Blocks with their bytes, without guards: texts, titles and ranges are those of the content before it was guarded."""
    out, at = [], 0
    for k, kind, text, title, level, start, end in found:
        raw, shown = GUARDED_BYTES.sub(rb"\1\2", content[start:end]), GUARDED.sub(r"\1", text)
        out.append((k, kind, shown, title if shown == text else title and shown, level, at, at + len(raw), raw))
        at += len(raw)
    return out


#: Bytes of sources whose blocks are held at once. A block takes some 1,000 bytes more as Python objects.
BATCH_BYTES = 1 << 20


def block_batches(batches: Iterator[pa.RecordBatch], guarded: bool = False) -> Iterator[pa.RecordBatch]:
    """Block rows of batches (doc_id, content), given on after each ``BATCH_BYTES`` of sources; memory is let go after each batch."""
    types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ["doc_id", "block_idx", "kind", "text", "title", "heading_level", "start_byte", "end_byte", "raw"]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        rows, size = [], 0
        for doc_id, value in zip(batch.column(0), batch.column(1)):
            content = value.as_py() or b""
            found = scan(content)
            found = as_shown(content, found) if guarded else [(*b, content[b[-2] : b[-1]]) for b in found]
            rows += [(doc_id.as_py(), *b) for b in found]
            size += len(content)
            if size >= BATCH_BYTES:
                yield as_batch(rows)
                rows, size = [], 0
        yield as_batch(rows)
        batch = rows = found = doc_id = value = content = None  # before the next one is read
        pa.default_memory_pool().release_unused()


def parse(sources: DataFrame, guarded: bool = False) -> DataFrame:
    """Block rows (``RAW_BLOCKS``) of sources (doc_id, content). A null or blank content has none.

    With ``guarded``, lines of the content that stand between ``GUARD`` are plain text, whatever is in them.
    """
    return sources.select("doc_id", "content").mapInArrow(lambda batches: block_batches(batches, guarded), RAW_BLOCKS)
