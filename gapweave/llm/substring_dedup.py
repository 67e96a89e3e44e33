"""Substring dedup over a compacted de Bruijn graph of token k-mers.

An edge is a k-mer of ``window`` words, and a node the ``window - 1`` words that two edges in a row share; an edge is
told by the hashes of its two nodes. The graph is compacted in two steps:

1. Inside minimizer buckets. The ``window - MINIMIZER + 1`` short runs of a k-mer have a least one by hash, which equal
   k-mers share. The consecutive k-mers of a text that share it are one super-k-mer, and distinct super-k-mers are
   counted, not k-mers. A bucket of one document leaves. In a bucket whose super-k-mers all read alike no path branches:
   it is one path, with the first document's copy as its source.
2. Across buckets, by joins. Other super-k-mers are spelled out in k-mers, once each, where their first document has them.
   Equal k-mers of several documents are one edge, with the first place as its source. A node with one edge in and one
   out does not branch, and the edges on both sides of it, which follow each other at the source, are one path.

Each place where a later document walks along a path is a span with source coordinates. The span's words are then held
against the words at these coordinates, in pieces of ``PIECE`` words, and a span that reads otherwise is no copy.
Copies are never expanded into pairs, and a passage in any number of documents is a few rows once it is pre-aggregated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens
from .common import arrow_bytes, discard, materialise
from .shingles import finish, word_hashes

MINIMIZER = 16
#: Words of a text at the source that are compared as one row.
PIECE = 64
#: Odd base of the runs' polynomial hashes modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


class Rolling:
    """Hashes of any run of words from prefix sums."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            power = np.full(len(words) + 1, base, np.uint64)
            power[0] = 1
            self.back = np.full(len(words) + 1, inverse, np.uint64)
            self.back[0] = 1
            np.multiply.accumulate(power, out=power)
            np.multiply.accumulate(self.back, out=self.back)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return finish((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the leftmost place of its least."""
    place, low, step = np.arange(len(values)), values, 1

    def joined(shift: int) -> None:
        nonlocal place, low
        left, right = low[: len(low) - shift], low[shift:]
        place = np.where(left <= right, place[: len(place) - shift], place[shift:])
        low = np.minimum(left, right)

    while step * 2 <= width:
        joined(step)
        step *= 2
    if width > step:
        joined(width - step)
    return place


def paths_of(words: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """owner, edge, path (hashes), first window's place in its text, windows, of all paths of all texts."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sizes = np.maximum(np.diff(offsets) - window + 1, 0)
    if not sizes.sum():
        return empty
    rolling = Rolling(words, BASE)
    at = np.arange(len(words) - MINIMIZER + 1)
    edges = rolling.of(at, at + MINIMIZER)
    least = least_positions(edges, window - MINIMIZER + 1)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(ends[-1]) + np.repeat(offsets[:-1] - (ends - sizes), sizes)
    edge_at = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (edge_at[1:] != edge_at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    begin, final, owner = start[first], start[last], owner[first]
    path = finish(rolling.of(begin, begin + window) ^ (rolling.of(final, final + window) * np.uint64(3) + (final - begin).astype(np.uint64)))
    return owner, edges[edge_at[first]], path, begin - offsets[:-1][owner], final - begin + 1


def read_paths(docs: DataFrame, window: int) -> DataFrame:
    """Per row: doc_id, n_words, whole_sha256 (of the words joined), paths (super-k-mers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                words, offsets = word_hashes(rows.column("text"), lower=False)
                owner, edge, path, begin, count = paths_of(words, offsets, window)
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows.num_rows))]).astype(np.int32)
                sha = [hashlib.sha256(b" ".join(t.encode().split()) if t else b"").hexdigest() for t in rows.column("text").to_pylist()]
                struct = pa.StructArray.from_arrays([pa.array(edge.view(np.int64)), pa.array(path.view(np.int64)), pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32))], names=["edge", "path", "begin", "windows"])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(sha), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct)],
                    names=["doc_id", "n_words", "whole_sha256", "paths"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, whole_sha256 string, paths array<struct<edge: long, path: long, begin: int, windows: int>>")


def spell(texts: DataFrame, window: int) -> DataFrame:
    """tail, head (nodes), doc_id, begin of each k-mer of the super-k-mers (begin, windows) that ``branching`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                words, offsets = word_hashes(rows.column("text"), lower=False)
                owner, (begins, counts) = flat_list(rows.column("branching"), 2)
                ends = np.cumsum(counts)
                begin = np.repeat(begins - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
                owner = np.repeat(owner, counts)
                at, rolling = offsets[:-1][owner] + begin, Rolling(words, BASE)
                tail, head = (rolling.of(at + k, at + k + window - 1).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(tail), pa.array(head), rows.column("doc_id").take(pa.array(owner)), pa.array(begin.astype(np.int32))], names=["tail", "head", "doc_id", "begin"])

    rows = texts.where("branching is not null").select("doc_id", "text", "branching")
    return rows.mapInArrow(run, "tail long, head long, doc_id long, begin int")


def flat_list(lists: pa.ListArray, fields: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The row of each element of a list of structs, and its first fields. A null list has none."""
    flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), tuple(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(fields))


def compact(spelled: DataFrame) -> DataFrame:
    """The paths' edges: tail, head, source, at (the first place), path (where at the source its path begins)."""
    first = F.min(F.struct("doc_id", "begin"))
    edges = spelled.groupBy("tail", "head").agg(first.alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    edges = materialise(edges.select("tail", "head", F.col("first.doc_id").alias("source"), F.col("first.begin").alias("at")), "edges")
    sides = [edges.select(F.col(c).alias("tail"), F.lit(int(c == "head")).alias("into"), F.lit(int(c == "tail")).alias("out")) for c in ("tail", "head")]
    inner = sides[0].unionByName(sides[1]).groupBy("tail").agg(F.sum("into").alias("into"), F.sum("out").alias("out")).where("into = 1 and out = 1").select("tail", F.lit(True).alias("inner"))
    along = Window.partitionBy("source").orderBy("at")  # the rows of one text at most
    begins = ~(F.coalesce("inner", F.lit(False)) & F.coalesce(F.lag("at").over(along) == F.col("at") - 1, F.lit(False)))
    marked = edges.join(inner, "tail", "left").withColumn("begins", begins)
    path = F.max(F.when(F.col("begins"), F.col("at"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    out = materialise(marked.select("tail", "head", "source", "at", path.alias("path")), "graph-paths")
    discard(edges)
    return out


def walks(spelled: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, walks: the spans (begin, windows, source, at) of later documents along the paths."""
    met = spelled.join(paths, ["tail", "head"]).where(F.col("doc_id") > F.col("source"))
    each = met.groupBy("doc_id", "source", "path", (F.col("begin") - F.col("at")).alias("shift")).agg(F.min("begin").alias("low"), F.max("begin").alias("high"), F.collect_list("begin").alias("begins"))
    span = lambda begin, windows: F.struct(begin.alias("begin"), windows.cast("int").alias("windows"), F.col("source"), (begin - F.col("shift")).cast("int").alias("at"))
    whole = F.col("high") - F.col("low") + 1 == F.size("begins")
    spans = F.when(whole, F.array(span(F.col("low"), F.size("begins")))).otherwise(F.transform("begins", lambda b: span(b, F.lit(1))))
    return each.groupBy("doc_id").agg(F.flatten(F.collect_list(spans)).alias("walks"))


SPANS = "array<struct<begin: int, windows: int, source: long, at: int>>"


def chained(rows: DataFrame) -> DataFrame:
    """doc_id, text, spans: those of ``rows`` in order, and as one where one goes on at its source as in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                owner, fields = flat_list(part.column("spans"), 4)
                order = np.lexsort((fields[0], owner))
                owner, (begin, windows, source, at) = owner[order], (f[order] for f in fields)
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (source[1:] != source[:-1]) | (begin[1:] != begin[:-1] + windows[:-1]) | (at[1:] != at[:-1] + windows[:-1])
                first = np.flatnonzero(new)
                sums = np.add.reduceat(windows, first) if len(first) else windows
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=part.num_rows))])
                arrays = [pa.array(begin[first].astype(np.int32)), pa.array(sums.astype(np.int32)), pa.array(source[first]), pa.array(at[first].astype(np.int32))]
                spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(arrays, names=["begin", "windows", "source", "at"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), spans], names=["doc_id", "text", "spans"])

    return rows.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id long, text string, spans {SPANS}")


def pieces(texts: DataFrame) -> DataFrame:
    """source, piece, there: the words of each text in runs of ``PIECE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                ids, numbers, there = [], [], []
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    words = text.encode().split()
                    for k in range(0, len(words), PIECE):
                        ids.append(doc)
                        numbers.append(k // PIECE)
                        there.append(b" ".join(words[k : k + PIECE]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(there, pa.binary()).cast(pa.string())], names=["source", "piece", "there"])

    return texts.select("doc_id", "text").mapInArrow(run, "source long, piece int, there string")


def claims(losing: DataFrame, window: int) -> DataFrame:
    """doc_id, begin (of a span), source, piece, skip, words, here: its words, cut as the source's pieces are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "begin", "source", "piece", "skip", "words", "here"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                out: list[list] = [[] for _ in names]
                for doc, text, spans in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), rows.column("spans").to_pylist()):
                    words = text.encode().split()
                    for s in spans:
                        at, end, shift = s["at"], s["at"] + s["windows"] + window - 1, s["begin"] - s["at"]
                        while at < end:
                            to = min(end, (at // PIECE + 1) * PIECE)
                            for column, value in zip(out, (doc, s["begin"], s["source"], at // PIECE, at % PIECE, to - at, b" ".join(words[at + shift : to + shift]))):
                                column.append(value)
                            at = to
                arrays = [pa.array(column, kind) for column, kind in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].cast(pa.string())], names=names)

    return losing.mapInArrow(run, "doc_id long, begin int, source long, piece int, skip int, words int, here string")


def refuted(losing: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """doc_id, wrong (begins): the spans whose words are not those at their source."""
    both = claims(losing, window).join(pieces(sources), ["source", "piece"], "left")
    part = F.when((F.col("skip") == 0) & (F.col("words") == PIECE), F.col("there")).otherwise(F.array_join(F.slice(F.split("there", " "), F.col("skip") + 1, F.col("words")), " "))
    return both.where(~F.coalesce(F.col("here") == part, F.lit(False))).groupBy("doc_id").agg(F.collect_set("begin").alias("wrong"))


def cut(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, whole_sha256, n_removed, kept_sha256, kept_text after the words under ``spans`` (begin, windows) have gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                whole, kept, removed = [], [], []
                for text, spans in zip(rows.column("text").to_pylist(), rows.column("spans")):
                    words = text.encode().split() if text else []
                    step = np.zeros(len(words) + 1, np.int64)
                    flat = spans.values
                    begin, count = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    np.add.at(step, begin, 1)
                    np.add.at(step, begin + count - 1 + window, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    removed.append(int(gone.sum()))
                    whole.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
                sha = [hashlib.sha256(t).hexdigest() for t in kept]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(whole, pa.string()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array([t.decode() for t in kept], pa.string())], names=["doc_id", "whole_sha256", "n_removed", "kept_sha256", "kept_text"])

    return texts.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, whole_sha256 string, n_removed long, kept_sha256 string, kept_text string")


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing goes).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id. Null
    text has no word. Rows without a doc_id lose nothing and take nothing from others. Of rows that repeat a doc_id
    with different words, the one whose words have the smallest SHA-256 is judged and the others stay whole. An empty
    table gives no rows; other columns are ignored.
    """
    if window < MINIMIZER:
        raise ValueError(f"a window has {MINIMIZER} words at least")
    with arrow_bytes(docs.sparkSession, tokens.BATCH_BYTES):
        return deduplicated(docs, window)


def deduplicated(docs: DataFrame, window: int) -> DataFrame:
    table = materialise(read_paths(docs, window), "paths")
    named = table.where("doc_id is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeats = materialise(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("whole_sha256").alias("judged")).where("rows > 1").drop("rows"), "repeats")
    if not repeats.isEmpty():
        named = named.join(repeats, "doc_id", "left").where("judged is null or judged = whole_sha256").dropDuplicates(["doc_id"])
        own_sha = F.sha2(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), 256)
        texts = texts.join(repeats, "doc_id", "left").where(F.col("judged").isNull() | (F.col("judged") == own_sha)).drop("judged").dropDuplicates(["doc_id"])

    # equal documents are one path from end to end: all but the first go whole
    whole = named.where(F.col("n_words") >= window).groupBy("whole_sha256").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = named.select("doc_id", "n_words", "whole_sha256").join(whole, "whole_sha256").where(F.col("doc_id") > F.col("first"))
    copies = materialise(copies.select("doc_id", "whole_sha256", F.col("n_words").alias("n_removed")), "copies")
    own = named.where(F.size("paths") > 0).select("doc_id", "paths").join(copies.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.inline("paths"))

    # compaction inside minimizer buckets
    classes = own.groupBy("edge", "path").agg(F.min(F.struct("doc_id", "begin", "windows")).alias("first"), F.max("doc_id").alias("last"))
    classes = materialise(classes, "path-classes")
    buckets = classes.groupBy("edge").agg((F.count(F.lit(1)) > 1).alias("branches"), F.min("first.doc_id").alias("low"), F.max("last").alias("high")).where("low < high")
    repeated = materialise(classes.join(buckets.select("edge", "branches"), "edge"), "repeated-classes")
    # where its first document has a super-k-mer more than once, any of these places may lose words to an earlier document
    placed = own.join(repeated.select("edge", "path", "branches", F.col("first.doc_id").alias("source"), F.col("first.begin").alias("at")), ["edge", "path"])
    later, is_first = F.col("doc_id") > F.col("source"), F.col("doc_id") == F.col("source")
    lists = lambda condition, *fields: F.collect_list(F.when(condition, F.struct(*fields)))
    touched = placed.groupBy("doc_id").agg(lists(later, "begin", "windows", "source", "at").alias("spans"), lists(is_first & F.col("branches"), "begin", "windows").alias("branching"), F.max(is_first).alias("is_source"))
    touched = materialise(touched, "touched")
    discard(classes, repeated)
    texts = materialise(texts.join(touched, "doc_id"), "touched-texts")
    discard(touched)

    # compaction across buckets, and the walks of later documents along the paths
    spelled = materialise(spell(texts.where(F.size("branching") > 0), window), "k-mers")
    paths = compact(spelled)
    none = F.array().cast(SPANS)
    spans = F.concat(F.coalesce("spans", none), F.coalesce("walks", none))
    losing = chained(texts.join(walks(spelled, paths), "doc_id", "left").select("doc_id", "text", spans.alias("spans")).where(F.size("spans") > 0))
    losing = materialise(losing, "losing")
    discard(spelled, paths)

    # verification at the source coordinates
    wrong = materialise(refuted(losing, texts.where("is_source"), window), "refuted")
    if not wrong.isEmpty():
        right = F.filter("spans", lambda s: ~F.coalesce(F.array_contains("wrong", s["begin"]), F.lit(False)))
        losing = losing.join(wrong, "doc_id", "left").withColumn("spans", right).drop("wrong")
    gone = copies.select("doc_id", "whole_sha256", "n_removed", F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").alias("kept_text"))
    found = cut(losing, window).unionByName(gone)
    out = table.select("doc_id", "n_words", "whole_sha256").join(found, ["doc_id", "whole_sha256"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        "kept_text",
    )
    discard(texts, repeats)
    return out
