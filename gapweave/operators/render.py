"""Rendering, file names, JSON records and merging of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .segments import overlap_blocks

SOURCE_TEXT = "raw"


def ordered_text(value: str, order: str) -> Column:
    """All of a group's texts in order, as an aggregate."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")


def render(segments: DataFrame, assigned: DataFrame, sources: DataFrame, style: str = "comment", max_depth: int = 0, exclude: tuple[str, ...] = (), overlap: int = 0) -> DataFrame:
    """Adds rendered: context header, overlap with the segment before, and the segment's own bytes."""
    header = T.context_header(F.col("heading_path"), style, max_depth, exclude)
    if overlap <= 0:
        return segments.withColumn("rendered", F.concat(header, F.col("raw").cast("string")))
    shown = overlap_blocks(assigned, overlap).join(sources.select("doc_id", "content"), "doc_id")
    shown = shown.withColumn("part", T.slice_bytes(F.col("content"), F.col("start_byte"), F.col("end_byte")).cast("string"))
    shown = shown.groupBy("doc_id", "seg_idx").agg(ordered_text("part", "block_idx").alias("_shown"))
    joined = segments.join(shown, ["doc_id", "seg_idx"], "left")
    return joined.withColumn("rendered", F.concat(header, F.coalesce("_shown", F.lit("")), F.col("raw").cast("string"))).drop("_shown")


def first_titles(assigned: DataFrame) -> DataFrame:
    """doc_id, seg_idx, title: text of the segment's first heading block, null without one."""
    title = F.min_by("text", F.when(F.col("kind") == "heading", F.col("block_idx")))
    return assigned.groupBy("doc_id", "seg_idx").agg(F.when(F.bool_or(F.col("kind") == "heading"), title).alias("title"))


def with_filenames(segments: DataFrame, assigned: DataFrame, prefix: str | None = None) -> DataFrame:
    """Adds filename: number and slug of the first heading or last path element; a slug met again gets -2, -3 and on.

    With ``prefix``, names are the prefix and the number.
    """
    number = F.col("seg_idx") + 1
    if prefix is not None:
        return segments.withColumn("filename", F.concat(F.lit(prefix), number.cast("string"), F.lit(".md")))
    joined = segments.join(first_titles(assigned), ["doc_id", "seg_idx"], "left")
    slug = T.slugify(F.coalesce("title", F.try_element_at("heading_path", F.lit(-1)), F.lit("")))
    joined = joined.withColumn("slug", F.when(slug == "", F.lit("segment")).otherwise(slug))
    nth = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("seg_idx"))
    width = F.greatest(F.lit(2), F.length(F.count(F.lit(1)).over(Window.partitionBy("doc_id")).cast("string")))
    again = F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(F.lit(""))
    return joined.withColumn("filename", F.concat(F.lpad(number.cast("string"), width, F.lit("0")), F.lit("-"), F.col("slug"), again, F.lit(".md"))).drop("title")


def with_glue(rendered: DataFrame, strip: bool = False) -> DataFrame:
    """doc_id, merged: segments in order, a newline between two where the first lacks one; headers off if asked."""
    text = T.strip_context(F.col("rendered")) if strip else F.col("rendered")
    last = F.col("seg_idx") == F.max("seg_idx").over(Window.partitionBy("doc_id"))
    glue = F.when(last | F.endswith(F.col("_t"), F.lit("\n")) | (F.col("_t") == ""), F.lit("")).otherwise(F.lit("\n"))
    rows = rendered.withColumn("_t", text).withColumn("_t", F.concat(F.col("_t"), glue))
    return rows.groupBy("doc_id").agg(ordered_text("_t", "seg_idx").alias("merged"))


def jsonl(segments: DataFrame) -> DataFrame:
    """doc_id, seg_idx, line: one JSON object with content, metadata and, where there, the embedding."""
    some = lambda c: F.when(F.col(c) != "", F.col(c)) if c in segments.columns else F.lit(None).cast("string")
    number = lambda c: F.col(c) if c in segments.columns else F.lit(None).cast("double")
    metadata = F.struct(
        F.col("source_name").alias("source"),
        F.col("seg_idx").alias("segment_index"),
        F.col("filename"),
        F.array("start_byte", "end_byte").alias("byte_range"),
        F.col("heading_path"),
        F.col("token_count"),
        F.col("block_count"),
        some("segment_id").alias("segment_id"),
        some("prev_segment_id").alias("prev_segment_id"),
        some("next_segment_id").alias("next_segment_id"),
        number("coherence").alias("coherence"),
        number("boundary_confidence").alias("boundary_confidence"),
    )
    extra = [F.col("vector").alias("embedding")] if "vector" in segments.columns else []
    return segments.select("doc_id", "seg_idx", F.to_json(F.struct(F.col("rendered").alias("content"), metadata.alias("metadata"), *extra)).alias("line"))


def summary(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """doc_id, segments, total_tokens, boundaries (final, as JSON; [] for none)."""
    sums = segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("token_count").alias("total_tokens"))
    cuts = boundaries.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_set("gap_idx"))).alias("boundaries"))
    return sums.join(cuts, "doc_id", "left").withColumn("boundaries", F.coalesce("boundaries", F.lit("[]")))
