"""Mixing sources to target weights by Poisson replication, in DataFrame expressions.

Each source gets a mean repetition rate (its target weight over its share of the corpus, times the wanted size). Each
document draws a uniform number from a hash of seed and doc_id, which is put through the inverse of the Poisson
distribution with that mean; it is exploded by that count, and a second hash deals all copies out and sorts them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import shuffle_partitions

#: Sources that the driver may hold; beyond that the rates are joined as a table.
MAX_SOURCES = 10_000
#: Rates up to which Poisson terms are added up from 0; exp(-rate) is a normal double.
LOW_RATE = 500
#: Copies of a document that are numbered at once.
BLOCK = 10_000


def uniform(seed: int, *columns: str) -> Column:
    """Evenly spread over [0, 1) by the first 52 bits of an MD5 of seed and columns."""
    key = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, scale: float = 1.0) -> DataFrame:
    """source, rate: with target weights (default: all sources alike) of ``scale`` times the corpus's characters.

    A null source is a source of its own, named ''. Sources that ``weights`` leaves out have weight 0; where all
    sources here have weight 0, all rates are 0. A source without characters has nothing to repeat to its target and keeps its documents once.
    """
    stats = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("source")).agg(F.sum(F.char_length(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("chars"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.element_at(table, F.col("source")), F.lit(0.0))
    stats = stats.withColumn("weight", weight)
    whole = stats.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weights"))
    rate = F.when(F.col("chars") > 0, F.lit(float(scale)) * F.try_divide("weight", "all_weights") * F.col("all_chars") / F.col("chars")).otherwise(F.lit(1.0))
    return stats.crossJoin(F.broadcast(whole)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))  # one row of totals


def poisson_count(u: Column, rate: Column) -> Column:
    """The smallest k whose cumulative Poisson probability exceeds u, by adding up terms until it does.

    Up to a rate of ``LOW_RATE`` the sum runs from 0 to 4 * rate + 40. Above, where exp(-rate) nears the least double, it
    runs over the 12 standard deviations on both sides of the rate, from a first term by Stirling's series. Beyond
    either end no 52-bit u lies but 0. One u gives the whole count at every rate, as the SQL has it.
    """
    high = rate > LOW_RATE
    low = F.when(high, F.floor(rate - 12 * F.sqrt(rate))).otherwise(F.lit(0)).cast("int")
    top = F.when(high, F.ceil(rate + 12 * F.sqrt(rate))).otherwise(F.lit(40) + 4 * F.ceil(rate)).cast("int")
    n = F.greatest(low, F.lit(1)).cast("double")
    stirling = n * F.log1p((rate - n) / n) - (rate - n) - F.log(2 * math.pi * n) / 2 - 1 / (12 * n) + 1 / (360 * n * n * n)
    term = F.exp(F.when(high, stirling).otherwise(-rate))
    step = lambda a, k: F.struct(
        (a["term"] * rate / k).alias("term"),
        (a["sum"] + a["term"] * rate / k).alias("sum"),
        F.when(a["sum"] <= u, k).otherwise(a["count"]).alias("count"),
    )
    return F.aggregate(F.sequence(low + 1, top), F.struct(term.alias("term"), term.alias("sum"), low.alias("count")), step, lambda a: a["count"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, scale: float = 1.0, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` with replica (from 0), rate and mix_key, replicated and in global random order.

    Copies of a row that repeats a doc_id are drawn alike. Null or empty texts are documents as any other. An empty
    table gives no rows. Columns of ``docs`` named replica, rate or mix_key are replaced.
    """
    spark, table = docs.sparkSession, rates(docs, weights, scale)
    found = table.limit(MAX_SOURCES + 1).collect()  # bounded by the limit
    docs = docs.drop("replica", "rate", "mix_key")
    source = F.coalesce(F.col("source"), F.lit(""))
    if len(found) <= MAX_SOURCES:
        small = spark.createDataFrame([(r.source, r.rate) for r in found], "_mix_source string, rate double")
        rows = docs.join(F.broadcast(small), source == F.col("_mix_source"), "left").drop("_mix_source")
    else:
        rows = docs.join(table.withColumnRenamed("source", "_mix_source"), source == F.col("_mix_source"), "left").drop("_mix_source")
    rows = rows.withColumn("_mix_count", poisson_count(uniform(seed, "doc_id"), F.col("rate"))).where("_mix_count > 0")
    # in blocks, so that no row holds all numbers of a document of very many copies
    rows = rows.withColumn("_mix_from", F.explode(F.sequence(F.lit(0), F.col("_mix_count") - 1, F.lit(BLOCK))))
    block = F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.col("_mix_count") - F.col("_mix_from")) - 1)
    copies = rows.withColumn("replica", F.explode(block)).withColumn("replica", F.col("_mix_from") + F.col("replica")).drop("_mix_count", "_mix_from")
    keyed = copies.withColumn("mix_key", F.xxhash64(F.lit(seed), "doc_id", "replica"))
    return keyed.repartition(shuffle_partitions(spark), "mix_key").sortWithinPartitions("mix_key")


def expected_share(rate: float, count: int) -> float:
    """Probability of ``count`` copies, for tests."""
    return math.exp(-rate) * rate**count / math.factorial(count)
