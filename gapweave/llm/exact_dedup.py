"""Exact dedup by content sort, in DataFrame expressions alone.

Rows are range-partitioned by sampled splitters over the normalised text's first bytes (a bounded splitter, with a
hash of the whole text to part texts that share a long head), sorted externally by head, hash and whole text, and
compared in full with their neighbours: the window below opens a new group wherever neighbouring texts differ.

A text that alone would fill a good part of a partition is dealt over several runs. Such texts are found by an exact
count over all rows; there can be at most ``HOT_SHARE`` times the partition count of them, so their table is bounded
whatever the data. Runs of one hot text are joined by SHA-256 and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import clean_text, materialise, shuffle_partitions

#: Characters of the sort key's head.
HEAD = 64
#: A text is hot when it has over 1 / (HOT_SHARE * partitions) of all rows.
HOT_SHARE = 4


def exact_dedup(docs: DataFrame, normalise: Column | None = None, keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``normalise`` is the text to compare (default: ``text`` itself); null counts as empty. ``keep`` names which
    doc_id of a group stays, ``smallest`` or ``largest``. Rows that repeat a doc_id and text count each, and only one
    of them is kept. A null doc_id is ordered before all others. An empty table gives no rows; further columns of
    ``docs`` are ignored.
    """
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    text = normalise if normalise is not None else clean_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body")).withColumn("hash", F.xxhash64("body"))
    counts = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    least = max(2, total // (HOT_SHARE * parts))
    hot = counts.where(F.col("n") > least).select("hash", F.ceil(F.col("n") * 2 / least).cast("int").alias("runs"))
    hot = materialise(hot, "hot-texts")  # at most a few times HOT_SHARE * parts rows, as each stands for over `least`
    rows = rows.join(F.broadcast(hot), "hash", "left")
    salt = F.when(F.col("runs").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("runs")).cast("int"))
    rows = rows.select("doc_id", "body", "hash", F.substring("body", 1, HEAD).alias("head"), salt.alias("run"))
    rows = rows.repartitionByRange(parts, "head", "hash", "run")
    group = Window.partitionBy("head", "hash", "run", "body")
    first = F.col("doc_id").asc_nulls_first() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    best = F.first("doc_id").over(group.orderBy(first).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sorted_rows = rows.select(
        "doc_id",
        "run",
        best.alias("best"),
        F.count(F.lit(1)).over(group.orderBy(first).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"),
        F.row_number().over(group.orderBy(first)).alias("place"),
        F.sha2(F.col("body"), 256).alias("sha"),
        F.octet_length("body").alias("bytes"),
    )
    sorted_rows = materialise(sorted_rows, "content-sorted")
    heads = sorted_rows.where((F.col("run") >= 0) & (F.col("place") == 1))
    pick = F.min if keep == "smallest" else F.max
    lowest = F.max(F.col("best").isNull())
    joined = heads.groupBy("sha", "bytes").agg(pick("best").alias("all_best"), lowest.alias("has_null"), F.sum("size").alias("all_size"))
    if keep == "smallest":
        joined = joined.withColumn("all_best", F.when(~F.col("has_null"), F.col("all_best")))
    joined = joined.withColumn("hot", F.lit(True)).drop("has_null")
    out = sorted_rows.withColumn("hot", F.col("run") >= 0).join(F.broadcast(joined), ["sha", "bytes", "hot"], "left")
    keep_id = F.when(F.col("hot"), F.col("all_best")).otherwise(F.col("best"))
    # among repeated rows of the kept doc_id one stays: the first of its run, and a hot doc_id's rows need one run
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.when(F.col("hot"), F.col("all_size")).otherwise(F.col("size")).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("place") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
