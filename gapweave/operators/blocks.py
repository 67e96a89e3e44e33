"""Block operators: heading paths, estimates, pseudo-headings, paragraph splitting.

Each works on windows over (doc_id, block_idx); the exchange on doc_id that the first of them needs serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .markdown import parse

PSEUDO_LEVEL = 7


def doc_order(index: str = "block_idx") -> Window:
    return Window.partitionBy("doc_id").orderBy(index)


def with_heading_path(blocks: DataFrame, title: str = "title") -> DataFrame:
    """Adds heading_path: titles of the headings open at each block, a heading's own not among them.

    The stack of open headings in window form: the heading last seen at a level is open if it came after every last
    heading of lower levels.
    """
    upto = doc_order().rowsBetween(Window.unboundedPreceding, 0)
    at_level = lambda level: F.when(F.col("heading_level") == level, F.col("block_idx"))
    named = blocks.withColumns({f"_at{k}": F.max(at_level(k)).over(upto) for k in range(1, PSEUDO_LEVEL + 1)} | {f"_title{k}": F.last(F.when(F.col("heading_level") == k, F.col(title)), ignorenulls=True).over(upto) for k in range(1, PSEUDO_LEVEL + 1)})
    entries = []
    for k in range(1, PSEUDO_LEVEL + 1):
        higher = F.greatest(F.lit(-1), *[F.coalesce(f"_at{j}", F.lit(-1)) for j in range(1, k)]) if k > 1 else F.lit(-1)
        inside = (F.col("kind") != "heading") | (F.col("heading_level") > k)
        entries.append(F.when((F.col(f"_at{k}") > higher) & inside, F.col(f"_title{k}")))
    path = F.array_compact(F.array(*entries))
    return named.withColumn("heading_path", path).drop(*[f"_{n}{k}" for n in ("at", "title") for k in range(1, PSEUDO_LEVEL + 1)])


def with_estimates(blocks: DataFrame) -> DataFrame:
    """Adds tokens and lines, of text and raw."""
    return blocks.withColumns({"tokens": T.token_estimate(F.col("text")), "lines": T.line_estimate(F.col("raw"))})


def blocks_of(sources: DataFrame) -> DataFrame:
    """Parsed blocks with paths and estimates; their bytes (raw) come from the scanner, and sources are read once."""
    return with_estimates(with_heading_path(parse(sources).withColumn("is_pseudo", F.lit(False))))


def detect_pseudo_headings(blocks: DataFrame, config: T.PseudoHeadingConfig = T.PseudoHeadingConfig()) -> DataFrame:
    """Paragraphs that read like headings become headings of level 7, and all paths are built anew from block texts."""
    hit = (F.col("kind") == "paragraph") & T.is_pseudo_heading(F.col("text"), config)
    changed = blocks.withColumns({"is_pseudo": hit, "heading_level": F.when(hit, F.lit(PSEUDO_LEVEL)).otherwise(F.col("heading_level")), "kind": F.when(hit, F.lit("heading")).otherwise(F.col("kind"))})
    return with_heading_path(changed.withColumn("_own", T.trimmed(F.col("text"))), "_own").drop("_own")


def split_paragraphs(blocks: DataFrame, is_break: Column) -> DataFrame:
    """Splits paragraphs of several lines: each line for which ``is_break`` (over ``line``) holds is a block of its own.

    Lines between two such lines stay together. Ranges are those of the lines, the last line keeping what follows it.
    Other blocks, and paragraphs with one run, stay as they are. block_idx and start and end bytes are given anew.
    """
    rows = blocks.select("*", F.posexplode(F.when((F.col("kind") == "paragraph") & F.contains("text", F.lit("\n")), F.split("text", "\n")).otherwise(F.array("text"))).alias("_n", "line"))
    in_block = Window.partitionBy("doc_id", "block_idx").orderBy("_n")
    marked = rows.withColumn("_hit", (F.col("kind") == "paragraph") & F.coalesce(is_break, F.lit(False)))
    new = F.col("_hit") | F.coalesce(F.lag("_hit").over(in_block), F.lit(True))
    marked = marked.withColumns({"_run": F.sum(new.cast("int")).over(in_block), "_offset": F.coalesce(F.sum(F.octet_length("line") + 1).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    others = [c for c in blocks.columns if c not in ("doc_id", "block_idx", "text", "start_byte", "end_byte")]
    runs = marked.groupBy("doc_id", "block_idx", "_run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias("text"),
        (F.first("start_byte") + F.min("_offset")).cast("int").alias("start_byte"),
        F.first("end_byte").alias("end_byte"),
        *[F.first(c).alias(c) for c in others],
    )
    order = Window.partitionBy("doc_id").orderBy("block_idx", "_run")
    within = Window.partitionBy("doc_id", "block_idx").orderBy("_run")
    end = F.coalesce(F.lead("start_byte").over(within), F.col("end_byte"))
    return runs.withColumns({"end_byte": end, "_new": (F.row_number().over(order) - 1).cast("int")}).drop("block_idx", "_run").withColumnRenamed("_new", "block_idx").select(*blocks.columns)


def split_long_paragraphs(blocks: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """A line that a pattern matches is a block of its own, and so is an empty line, in which there is nothing to match."""
    hit = F.lit(False)
    for pattern in T.valid_patterns(patterns):
        hit = hit | F.col("line").rlike(f"(?d){pattern}") | (F.col("line") == "")
    return split_paragraphs(blocks, hit)


def auto_split_paragraphs(blocks: DataFrame, config: T.PseudoHeadingConfig = T.PseudoHeadingConfig()) -> DataFrame:
    return split_paragraphs(blocks, T.is_pseudo_heading(F.col("line"), config))
