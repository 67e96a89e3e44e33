"""Column builders for text: estimates, normalisation, slugs, labels, anchors, context headers, token sets.

All stay in Spark expressions but NFC, which Spark lacks and an Arrow batch function provides. Patterns use (?d) line
ends, so that only a newline ends a line.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

SLUG_LENGTH, LABEL_LENGTH, SHORT_LABEL = 50, 60, 30
#: Unicode white space as one pattern.
SPACE = r"[\s\x{85}\p{Z}]+"
HAN_KANA = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
CJK = HAN_KANA + r"\p{IsHangul}\x{3000}-\x{30FF}"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}", ""), f"{SPACE}$", "")


def token_estimate(text: Column) -> Column:
    """A quarter token for an ASCII byte and a third for any other, rounded up; null and empty give 0."""
    ascii_bytes = F.octet_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.coalesce(F.ceil(ascii_bytes / 4.0 + (F.octet_length(text) - ascii_bytes) / 3.0), F.lit(0)).cast("int")


def slice_bytes(content: Column, start: Column, end: Column) -> Column:
    """Bytes start to end, exclusive, of a binary column."""
    return F.substring(content, start + 1, end - start)


def line_estimate(raw: Column) -> Column:
    """Newlines plus one; 1 where there are no bytes."""
    text = raw.cast("string")
    return F.coalesce(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("int")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def strip_markdown(text: Column) -> Column:
    """Content without Markdown marks, by replacements in a fixed order; emphasis with _ keeps words like snake_case."""
    for pattern, to in (
        (r"(?md)^```[a-zA-Z]*[ \t]*$", ""),
        (r"`([^`]+)`", "$1"),
        (r"\*\*([^*]+)\*\*|(?<!\w)__([^_]+)__(?!\w)", "$1$2"),
        (r"\*([^*]+)\*|(?<!\w)_([^_]+)_(?!\w)", "$1$2"),
        (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"(?md)^#{1,6}[ \t]+(.+)$", "$1"),
        (r"(?md)^[-*_]{3,}[ \t]*$", ""),
        (r"(?md)^>[ \t]*", ""),
        (r"(?md)^[ \t]*(?:[-*+]|\d+\.)[ \t]+", ""),
        (r"<[^>]+>", ""),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def compact(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, SPACE, " "))


@dataclass(frozen=True)
class NormalizeConfig:
    nfc: bool = True
    strip_markdown: bool = False
    compact: bool = True
    lower: bool = False


def normalize(text: Column, config: NormalizeConfig = NormalizeConfig()) -> Column:
    """NFC, then marks, white space and case, each as configured."""
    text = nfc(text) if config.nfc else text
    text = strip_markdown(text) if config.strip_markdown else text
    text = compact(text) if config.compact else text
    return F.lower(text) if config.lower else text


def slugify(text: Column) -> Column:
    """Lower-case ASCII words and CJK characters; runs of spaces, marks and symbols are one hyphen, never at the ends."""
    kept = F.regexp_replace(trimmed(text), rf"[^a-zA-Z0-9 \p{{P}}\p{{S}}{CJK}]", "")
    hyphened = F.regexp_replace(kept, rf"[ \p{{P}}\p{{S}}&&[^{CJK}]]+", "-")
    return F.rtrim(F.left(F.btrim(F.lower(hyphened), F.lit("-")), F.lit(SLUG_LENGTH)), F.lit("-"))


def clipped(text: Column, length: int, mark: str) -> Column:
    return F.when(F.char_length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit(mark))).otherwise(text)


def label(title: Column, path: Column) -> Column:
    """A segment's label: its title, after the last path element where that differs; on one line, pipes escaped."""
    parent = F.try_element_at(path, F.lit(-1))
    base = F.when(parent.isNotNull() & (parent != title), F.concat(parent, F.lit(" > "), title)).otherwise(title)
    return clipped(F.replace(compact(base), F.lit("|"), F.lit("\\|")), LABEL_LENGTH, "...")


def short_label(text: Column) -> Column:
    """The part after the last ' > ', clipped and escaped for a graph node."""
    last = clipped(F.element_at(F.split(text, " > "), -1), SHORT_LABEL, "…")
    return F.replace(F.replace(last, F.lit('"'), F.lit("#quot;")), F.lit("`"), F.lit("'"))


def heading_id(title: Column) -> Column:
    """Lower case, spaces as hyphens, and of the rest only ASCII letters, digits, hyphens and underscores."""
    return F.regexp_replace(F.replace(F.lower(title), F.lit(" "), F.lit("-")), "[^a-z0-9_-]", "")


def html_anchors(text: Column) -> Column:
    """Names and ids of <a> tags, in any case, in double quotes."""
    return F.regexp_extract_all(text, F.lit(r'(?i)<a\s+(?:name|id)\s*=\s*"([^"]+)"'), F.lit(1))


def internal_links(text: Column) -> Column:
    """Targets of [..](#ref), in order and with repeats."""
    return F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]\(#([^)]+)\)"), F.lit(2))


def context_header(path: Column, style: str, max_depth: int = 0, exclude: tuple[str, ...] = ()) -> Column:
    """The heading path as a comment, front matter or headings; empty for another style or an empty path.

    ``max_depth`` above 0 keeps the outermost headings; entries that contain one of ``exclude`` are left out.
    """
    for word in exclude:
        path = _without(path, word)
    path = F.slice(path, 1, max_depth) if max_depth > 0 else path
    if style == "comment":
        body = F.concat(F.lit("<!-- context: "), F.array_join(path, " > "), F.lit(" -->\n\n"))
    elif style == "front-matter":
        body = F.concat(F.lit("---\ncontext:\n"), F.array_join(F.transform(path, lambda h: F.concat(F.lit("  - "), h, F.lit("\n"))), ""), F.lit("---\n\n"))
    elif style == "heading":
        body = F.array_join(F.transform(path, lambda h, i: F.concat(F.repeat(F.lit("#"), F.least(i + 1, F.lit(6))), F.lit(" "), h, F.lit("\n\n"))), "")
    else:
        return F.lit("")
    return F.when(F.coalesce(F.size(path), F.lit(0)) > 0, body).otherwise(F.lit(""))


def _without(path: Column, word: str) -> Column:
    return F.filter(path, lambda h: ~F.contains(h, F.lit(word)))


def strip_context(text: Column) -> Column:
    """Without a leading context comment, then without leading context front matter."""
    text = F.regexp_replace(text, r"(?s)^<!--\s*context:.*?-->\s*", "")
    return F.regexp_replace(text, r"^---\ncontext:\n(?:\s+- [^\n]*\n)+---\s*", "")


@dataclass(frozen=True)
class PseudoHeadingConfig:
    max_length: int = 60
    prefixes: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


def is_pseudo_heading(text: Column, config: PseudoHeadingConfig = PseudoHeadingConfig()) -> Column:
    """A prefix pattern, or a short line that ends in a colon or begins like ``1)``; excluded substrings veto both."""
    line = trimmed(text)
    length = config.max_length if config.max_length > 0 else 40
    short = (F.char_length(line) <= length) & (line.rlike("[:：]$") | line.rlike(r"^\d+\)"))
    hit = short
    for pattern in valid_patterns(config.prefixes):
        hit = hit | line.rlike(pattern)
    for word in config.exclude:
        hit = hit & ~F.contains(line, F.lit(word))
    return hit & (line != "")


def valid_patterns(patterns: tuple[str, ...]) -> list[str]:
    """Patterns that compile; the others are skipped."""
    import re

    found = []
    for pattern in patterns:
        try:
            re.compile(pattern)
        except re.error:
            continue
        found.append(pattern)
    return found


def token_set(text: Column) -> Column:
    """Distinct lower-case words; each Han or Kana character is a word of its own."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"[{HAN_KANA}]|[\p{{L}}\p{{Nd}}&&[^{HAN_KANA}]]+"), F.lit(0)))


def char_trigrams(text: Column) -> Column:
    """All three-character runs in order; a shorter text has none."""
    n = F.char_length(text)
    runs = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(n >= 3, runs).otherwise(F.array().cast("array<string>"))


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def auto_max_lines(total: Column) -> Column:
    return F.least(F.lit(2000), F.greatest(F.lit(200), F.floor(total / 10))).cast("int")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between them."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def segment_id(name: Column, start: Column, end: Column, raw: Column) -> Column:
    """SHA-256 of source name, byte range and bytes."""
    head = F.concat(name, F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit(":"))
    return F.sha2(F.concat(head.cast("binary"), raw), 256)
