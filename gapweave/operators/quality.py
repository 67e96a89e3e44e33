"""Segment quality: coherence, document metrics, lossless check, mean vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T, vectors as V


#: Blocks whose vectors are gathered in one list.
PART_SIZE = 1024


def part_of() -> Column:
    return F.floor(F.col("block_idx") / PART_SIZE)


def coherence(assigned: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc_id, seg_idx, coherence: mean pairwise cosine of a segment's vectors; 1 for one block.

    The sum over pairs is had from the sum of unit vectors, (|sum|^2 - k) / (n (n - 1)) with k vectors that have a
    direction, so that a segment costs one sum and not a self-join. Blocks without a vector, or one of another size
    than the segment's first, count as without direction. Vectors are summed in parts of ``PART_SIZE``, so that no list grows
    with a segment.
    """
    joined = assigned.select("doc_id", "seg_idx", "block_idx").join(vectors.select("doc_id", "block_idx", "vector"), ["doc_id", "block_idx"], "left")
    size = F.max_by(F.size("vector"), F.when(F.size("vector") > 0, -F.col("block_idx"))).over(Window.partitionBy("doc_id", "seg_idx"))
    rows = joined.withColumn("u", F.when(F.size("vector") == size, V.unit(F.col("vector"))))
    parts = rows.groupBy("doc_id", "seg_idx", part_of()).agg(F.count(F.lit(1)).alias("n"), F.count("u").alias("k"), V.sum_of(F.collect_list("u")).alias("s"))
    sums = parts.groupBy("doc_id", "seg_idx").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), V.sum_of(F.collect_list("s")).alias("s"))
    square = F.coalesce(V.dot(F.col("s"), F.col("s")), F.lit(0.0))
    mean = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise((square - F.col("k")) / (F.col("n") * (F.col("n") - 1)))
    return sums.select("doc_id", "seg_idx", mean.alias("coherence"))


def mean_vectors(assigned: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc_id, seg_idx, vector: element-wise mean of the segment's vectors, missing and empty ones left out.

    An element that only some vectors reach is the mean of those.
    """
    joined = assigned.select("doc_id", "seg_idx", "block_idx").join(vectors.where(F.size("vector") > 0), ["doc_id", "block_idx"])
    parts = joined.groupBy("doc_id", "seg_idx", part_of()).agg(V.sum_of(F.collect_list("vector")).alias("s"), F.collect_list(F.size("vector")).alias("sizes"))
    sums = parts.groupBy("doc_id", "seg_idx").agg(V.sum_of(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("sizes")).alias("sizes"))
    reached = lambda even, i: F.when(even, F.size("sizes")).otherwise(F.size(F.filter("sizes", lambda n: n > i)))
    mean = V.let(F.array_min("sizes") == F.array_max("sizes"), lambda even: F.transform("s", lambda x, i: x / reached(even, i)))
    return sums.select("doc_id", "seg_idx", mean.alias("vector"))


def document_metrics(coherences: DataFrame, confidences: DataFrame) -> DataFrame:
    """doc_id, avg_coherence, min_coherence, avg_confidence (of boundaries, 0 without any), size_score."""
    c = coherences.groupBy("doc_id").agg(F.avg("coherence").alias("avg_coherence"), F.min("coherence").alias("min_coherence"), F.count(F.lit(1)).alias("n"))
    b = confidences.groupBy("doc_id").agg(F.avg("confidence").alias("avg_confidence"))
    score = T.clamp01(1 - F.abs(F.col("n") - 10) / 10)
    return c.join(b, "doc_id", "left").select("doc_id", "avg_coherence", "min_coherence", F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"), score.alias("size_score"))


def tiling_violations(ranges: DataFrame, sources: DataFrame, index: str = "seg_idx") -> DataFrame:
    """Rows of ranges that do not begin where the one before ends, or do not end with the source; none if lossless."""
    order = Window.partitionBy("doc_id").orderBy(index)
    sizes = sources.select("doc_id", F.octet_length("content").alias("size"))
    rows = ranges.join(sizes, "doc_id").withColumns({"expected": F.coalesce(F.lag("end_byte").over(order), F.lit(0)), "_next": F.lead("start_byte").over(order)})
    wrong = (F.col("start_byte") != F.col("expected")) | (F.col("_next").isNull() & (F.col("end_byte") != F.col("size")))
    return rows.where(wrong).select("doc_id", index, "start_byte", "end_byte", "expected", "size")
