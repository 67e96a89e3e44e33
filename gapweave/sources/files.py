"""Reading and writing documents: Markdown files, gold annotations, segment folders."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..schema import GOLD


def base_name(path: F.Column) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def read_markdown(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id, source_name, content of whole files; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.xxhash64("path").alias("doc_id"), base_name(F.col("path")).alias("source_name"), "content", "path")


def read_gold(spark: SparkSession, *paths: str) -> DataFrame:
    """Gold annotations with sorted boundaries."""
    return spark.read.schema(GOLD).json(list(paths), multiLine=True).withColumn("boundaries", F.array_sort("boundaries"))


def check_gold(gold: DataFrame) -> DataFrame:
    """The annotations, failing the job on a unit other than block."""
    known = F.coalesce("unit", F.lit("")).isin("", "block")
    return gold.withColumn("unit", F.when(known, F.col("unit")).otherwise(F.raise_error(F.concat(F.lit("unknown gold unit: "), F.col("unit"))).cast("string")))


def write_gold(gold: DataFrame, path: str) -> None:
    gold.write.mode("overwrite").json(path)


def segment_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, text of a folder's segments in order: by first link in index.md, or by name, numbers by value.

    Only names that exist count, by base name; files that the index does not name are left out where it names any.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select(base_name(F.col("path")).alias("name"), F.col("content").cast("string").alias("text"))
    index = files.where("name = 'index.md'").select(F.posexplode(F.regexp_extract_all("text", F.lit(r"\]\(([^)#]+\.md)\)"), F.lit(1))).alias("pos", "link"))
    order = index.select(base_name(F.col("link")).alias("name"), "pos").groupBy("name").agg(F.min("pos").alias("pos"))
    rows = files.where("name <> 'index.md'").join(order, "name", "left")
    rows = rows.withColumn("_any", F.max(F.col("pos").isNotNull()).over(Window.partitionBy(F.lit(0))))
    natural = F.transform(F.regexp_extract_all("name", F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p))
    return rows.where("not _any or pos is not null").withColumn("_natural", F.array_join(natural, "")).orderBy(F.coalesce("pos", F.lit(0)), "_natural").select("name", "text")


def safe_path(folder: str, name: str) -> str:
    """The path of ``name`` in ``folder``; an error if it leads out of it."""
    base = os.path.abspath(folder)
    path = os.path.abspath(os.path.join(base, name))
    if os.path.commonpath([base, path]) != base or path == base:
        raise ValueError(f"{name!r} leads out of {folder!r}")
    return path


def write_segments(rendered: DataFrame, folder: str) -> int:
    """Write filename and rendered of each row below ``folder`` (a path all executors share); how many files."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, text in zip(part["filename"], part["rendered"]):
                path = safe_path(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.tmp-{os.getpid()}", "w", encoding="utf-8", newline="") as out:
                    out.write(text)
                os.replace(f"{path}.tmp-{os.getpid()}", path)
            yield pd.DataFrame({"files": [len(part)]})

    return rendered.select("filename", "rendered").mapInPandas(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
