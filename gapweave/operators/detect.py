"""Boundary detectors: each gives (doc_id, gap_idx) rows, a split after block gap_idx, from blocks or gaps."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window, functions as F

from .gaps import with_depth


class Detector(Protocol):
    """What the pipeline splits by. ``gaps`` has similarities where vectors were made, else it is None."""

    def detect(self, blocks: DataFrame, gaps: DataFrame | None) -> DataFrame: ...


def _last(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("_last", F.max("block_idx").over(Window.partitionBy("doc_id")))


class HeadingSplit:
    """A boundary before every heading but a document's first block."""

    def detect(self, blocks: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
        return blocks.where("kind = 'heading' and block_idx > 0").select("doc_id", (F.col("block_idx") - 1).alias("gap_idx"))


class FixedSplit:
    """A boundary after every ``size`` blocks; none for documents of at most ``size`` blocks or size 0."""

    def __init__(self, size: int):
        self.size = size

    def detect(self, blocks: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
        if self.size <= 0:
            return blocks.where("false").select("doc_id", F.col("block_idx").alias("gap_idx"))
        ends = (F.col("block_idx") + 1) % self.size == 0
        return _last(blocks).where(ends & (F.col("block_idx") < F.col("_last"))).select("doc_id", F.col("block_idx").alias("gap_idx"))


class RandomSplit:
    """``count`` gaps of each document in the order of an MD5 of seed and gap, so that any engine draws the same."""

    def __init__(self, count: int, seed: int = 42):
        self.count, self.seed = count, seed

    def detect(self, blocks: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
        inner = _last(blocks).where(F.col("block_idx") < F.col("_last"))
        order = Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.col("doc_id").cast("string"), F.col("block_idx").cast("string"))), "block_idx")
        return inner.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= self.count).select("doc_id", F.col("block_idx").alias("gap_idx"))


class DepthThreshold:
    """Gaps whose depth exceeds the document's mean depth less half its standard deviation (TextTiling's cutoff)."""

    def scored(self, gaps: DataFrame) -> DataFrame:
        doc = Window.partitionBy("doc_id")
        return with_depth(gaps).withColumn("threshold", F.avg("depth").over(doc) - F.stddev_pop("depth").over(doc) / 2)

    def detect(self, blocks: DataFrame, gaps: DataFrame | None) -> DataFrame:
        if gaps is None:
            raise ValueError("depth needs similarities: give the pipeline an embedder")
        return self.scored(gaps).where((F.col("depth") > F.col("threshold")) & (F.col("depth") > 0)).select("doc_id", "gap_idx")


class TableDetector:
    """Boundaries from a table (doc_id, gap_idx), such as annotations."""

    def __init__(self, boundaries: DataFrame):
        self.boundaries = boundaries

    def detect(self, blocks: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
        return validate(self.boundaries, blocks)


def validate(boundaries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Boundaries inside 0 to n-2, each once."""
    size = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return boundaries.join(size, "doc_id").where((F.col("gap_idx") >= 0) & (F.col("gap_idx") <= F.col("_n") - 2)).select("doc_id", F.col("gap_idx").cast("int").alias("gap_idx")).distinct()


def average_fixed_size(blocks: DataFrame, gold: DataFrame) -> DataFrame:
    """doc_id, size: the whole part of blocks over gold segments, 2 at least."""
    n = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    g = gold.groupBy("doc_id").agg(F.count(F.lit(1)).alias("g"))
    return n.join(g, "doc_id", "left").select("doc_id", F.greatest(F.lit(2), F.floor(F.col("n") / (F.coalesce("g", F.lit(0)) + 1))).cast("int").alias("size"))
