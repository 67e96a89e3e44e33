"""Gap operators: gap i stands between blocks i and i+1 of a document. All are windows over (doc_id, index)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T, vectors as V
from .blocks import doc_order


def similarities(vectors: DataFrame, k: int = 1) -> DataFrame:
    """doc_id, gap_idx, similarity: cosine of the mean vectors of up to ``k`` blocks on either side."""
    order = doc_order()
    if k <= 1:
        left, right = F.col("vector"), F.lead("vector").over(order)
    else:
        left = V.mean_of(F.collect_list("vector").over(order.rowsBetween(-(k - 1), 0)))
        right = V.mean_of(F.collect_list("vector").over(order.rowsBetween(1, k)))
    rows = vectors.select("doc_id", F.col("block_idx").alias("gap_idx"), left.alias("l"), right.alias("r"), F.lead("block_idx").over(order).alias("next"))
    return rows.where("next is not null").select("doc_id", "gap_idx", V.cosine(F.col("l"), F.col("r")).alias("similarity"))


def smooth(gaps: DataFrame, width: int, column: str = "similarity") -> DataFrame:
    """Centred moving average over ``width`` gaps on either side, clipped at the ends; 0 or less changes nothing."""
    order = doc_order("gap_idx")
    return gaps if width <= 0 else gaps.withColumn(column, F.avg(column).over(order.rowsBetween(-width, width)))


def with_depth(gaps: DataFrame, column: str = "similarity") -> DataFrame:
    """Adds depth: how far the similarity lies under the peaks to its left and right.

    A peak is what a walk reaches that never goes down; walks to the left end at strict rises and walks to the right
    at strict falls, which number the groups whose maxima are the peaks.
    """
    order = doc_order("gap_idx")
    v = F.col(column)
    rises = F.sum((v > F.lag(column).over(order)).cast("int")).over(order)
    falls = F.sum((v < F.lag(column).over(order)).cast("int")).over(order)
    marked = gaps.withColumns({"_rise": F.coalesce(rises, F.lit(0)), "_fall": F.coalesce(falls, F.lit(0))})
    peak = lambda g: F.max(column).over(Window.partitionBy("doc_id", g))
    return marked.withColumn("depth", peak("_rise") + peak("_fall") - 2 * v).drop("_rise", "_fall")


def with_confidence(gaps: DataFrame) -> DataFrame:
    """Adds confidence: how far depth exceeds the threshold column, as a share of the document's largest depth."""
    largest = F.max("depth").over(Window.partitionBy("doc_id"))
    share = F.when(largest > 0, T.clamp01((F.col("depth") - F.col("threshold")) / largest)).otherwise(F.lit(0.0))
    return gaps.withColumn("confidence", share)
