"""Incremental runs: unchanged sources leave before any costly stage, and segments are told as added, kept or removed.

A state is a folder of versions ``v-<number>``, each with the table ``state``, the ``changes`` of the run that wrote it
and, written last, a marker file that names the run. The highest version with a marker counts, so that a run that fails
leaves the state as it was, and the same run again finds its own changes.
"""

from __future__ import annotations

import uuid
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.pipeline import Config, run
from ..schema import SOURCES, STATE

CHANGES = "source_name string, segment_id string, change string"
MARKER = "_DONE-"
#: Versions kept, as readers may still be at the one before the last.
KEPT = 2


def source_hash(content: F.Column) -> F.Column:
    return F.sha2(content, 256)


def build_state(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """State rows, kept for each source on its own."""
    hashes = sources.select("doc_id", source_hash(F.col("content")).alias("source_hash"))
    return segments.join(hashes, "doc_id").select("source_name", "source_hash", "segment_id", "seg_idx", "start_byte", "end_byte", F.sha2("raw", 256).alias("hash"))


def _folder(spark: SparkSession, path: str):
    """A Hadoop path, and the store that it is in."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and run of every whole version, in order."""
    folder, store = _folder(spark, path)
    found = []
    for entry in store.listStatus(folder) if store.exists(folder) else ():  # KEPT versions, and what failed runs left
        name = entry.getPath().getName()
        if name.startswith("v-") and name[2:].isdigit():
            runs = [f.getPath().getName() for f in store.listStatus(entry.getPath())]
            found += [(int(name[2:]), r.removeprefix(MARKER)) for r in runs if r.startswith(MARKER)]
    return sorted(found)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The state at a path; no rows where there is none yet."""
    known = versions(spark, path)
    return spark.read.schema(STATE).parquet(f"{path}/v-{known[-1][0]}/state") if known else spark.createDataFrame([], STATE)


def load_changes(spark: SparkSession, path: str) -> DataFrame:
    """The changes of the run that wrote the state at a path."""
    known = versions(spark, path)
    return spark.read.schema(CHANGES).parquet(f"{path}/v-{known[-1][0]}/changes") if known else spark.createDataFrame([], CHANGES)


def save_state(state: DataFrame, path: str, changes: DataFrame | None = None, run_name: str | None = None) -> None:
    """Write a new version, mark it as whole, and delete those before the last ``KEPT``."""
    spark = state.sparkSession
    known = versions(spark, path)
    number = known[-1][0] + 1 if known else 1
    version = f"{path}/v-{number}"
    state.write.mode("overwrite").parquet(f"{version}/state")
    (changes if changes is not None else spark.createDataFrame([], CHANGES)).write.mode("overwrite").parquet(f"{version}/changes")
    marker, store = _folder(spark, f"{version}/{MARKER}{run_name or uuid.uuid4().hex}")
    store.create(marker, True).close()
    for old, _ in known[: 1 - KEPT]:
        store.delete(_folder(spark, f"{path}/v-{old}")[0], True)


def changed_sources(sources: DataFrame, state: DataFrame) -> DataFrame:
    """Sources that are new or whose bytes differ from the state's."""
    known = state.select(F.col("source_name").alias("_name"), F.col("source_hash").alias("_hash")).distinct()
    return sources.join(known, (sources.source_name == F.col("_name")) & (source_hash(sources.content) == F.col("_hash")), "left_anti")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_name, segment_id, change: added, removed, unchanged, or modified (the id kept, the bytes not)."""
    a = old.select("source_name", "segment_id", F.col("hash").alias("old_hash"))
    b = new.select("source_name", "segment_id", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    return a.join(b, ["source_name", "segment_id"], "full_outer").select("source_name", "segment_id", change.alias("change"))


def update(spark: SparkSession, sources: DataFrame, state_path: str, config: Config | None = None, run_name: str | None = None) -> DataFrame:
    """Split what changed, write the new state with its changes, and return these, read from where they were written.

    A run whose name is that of the state's last version has been done, and gives its changes again.
    """
    known = versions(spark, state_path)
    if run_name is None or not known or known[-1][1] != run_name:
        state = load_state(spark, state_path)
        changed = changed_sources(sources, state).cache()
        names = changed.select("source_name").distinct()
        result = run(changed, config)
        fresh = build_state(result.segments, changed).cache()
        changes = diff(state.join(names, "source_name", "left_semi"), fresh)
        save_state(state.join(names, "source_name", "left_anti").unionByName(fresh), state_path, changes, run_name)
        for table in (changed, fresh):
            table.unpersist()
        result.release()
    return load_changes(spark, state_path)


def stream(spark: SparkSession, folder: str, state_path: str, changes_path: str, checkpoint: str, config: Config | None = None):
    """A streaming query that takes in all new Parquet sources of a folder and writes their changes; run it again for more.

    A batch's changes are a folder ``batch=<id>`` of their own, so that a batch run again replaces them by the same.
    """
    incoming = spark.readStream.schema(SOURCES).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        update(df.sparkSession, df, state_path, config, f"{crc32(checkpoint.encode()):08x}-{number}").write.mode("overwrite").parquet(f"{changes_path}/batch={number}")

    return incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
