"""A training-data pipeline over ``documents``: language ID, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``. Null texts and null or repeated doc_ids follow the
rules of each stage's operator; an empty table passes through all stages as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gapweave import ship
from gapweave.llm.common import documents, materialise
from gapweave.llm.language_id import UNKNOWN, identify
from gapweave.llm.line_dedup import line_dedup
from gapweave.llm.mixing import mix
from gapweave.llm.near_dedup import near_dedup
from gapweave.llm.packing import pack

#: Documents whose best language has a lower probability are rejected; with four languages chance gives 0.25.
MIN_SCORE = 0.4
#: Likeness of word shingles from which documents are near-duplicates; 30 bands of 5 rows miss 7e-6 of the pairs at it.
NEAR_PERCENT = 80
#: Tokens of a training sequence.
CAPACITY = 2048


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows: not undetermined, and not below ``MIN_SCORE``."""
    ship(spark)
    found = identify(docs)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs, also across blank lines, go; documents left without text go with them. n_chars follows the text."""
    ship(spark)
    found = line_dedup(docs, across_blank=True).where((F.col("n_removed") == 0) | ~F.col("text").rlike(r"^\s*$"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id."""
    ship(spark)
    gone = materialise(near_dedup(docs, percent=NEAR_PERCENT, width=5).where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id")).distinct(), "near-copies")
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col("_gone_id"), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated to equal shares, in global random order."""
    ship(spark)
    return mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of ``CAPACITY`` tokens; copies of a document are packed each."""
    ship(spark)
    return pack(docs, capacity=CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("source_mixing", mixture),
    ("best_fit_packing", packing),
]

#: SQL cannot run the network; tests hold each stage against plain code on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
