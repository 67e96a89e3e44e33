"""Offline embedders: hashed TF-IDF of character trigrams, and character counts, counted in numpy over Arrow batches.

A document's blocks meet in one task, as their document frequencies need; trigrams never leave it as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..schema import EMBEDDINGS

TFIDF_DIMS, CHARS_DIMS = 256, 128
#: Blocks whose vectors are held at once.
AT_ONCE = 4096


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in a row, and each text's length."""
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    return np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), "<u4").astype(np.int64), lengths


def dense(rows: pa.RecordBatch, block: np.ndarray, bucket: np.ndarray, weight: np.ndarray, dims: int) -> Iterator[pa.RecordBatch]:
    """doc_id, block_idx, vector at length 1 of each row; ``block`` (row numbers in order), bucket and weight are its entries."""
    for first in range(0, rows.num_rows, AT_ONCE):
        part = rows.slice(first, AT_ONCE)
        a, b = np.searchsorted(block, [first, first + part.num_rows])
        sums = np.bincount((block[a:b] - first) * dims + bucket[a:b], weights=weight[a:b], minlength=part.num_rows * dims).reshape(-1, dims)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        values = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * dims, pa.int32()), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("block_idx"), vectors], names=["doc_id", "block_idx", "vector"])


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def tfidf_entries(texts: list[str | None], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """block, bucket, weight: tf * ln(1 + N / (df + 1)) of each block's distinct trigrams; N and df count its document's blocks."""
    codes, lengths = code_points(texts)
    sizes = np.maximum(lengths - 2, 0)
    block = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(sizes.sum()) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(sizes) - sizes), sizes)
    if not len(at):
        return block, block, np.zeros(0)
    gram = codes[at] << 42 | codes[at + 1] << 21 | codes[at + 2]
    order = np.lexsort((gram, block))
    block, gram = block[order], gram[order]
    first = runs(block, gram)
    tf = np.diff(np.append(first, len(gram)))
    block, gram = block[first], gram[first]
    order = np.lexsort((gram, docs[block]))
    start = runs(docs[block][order], gram[order])
    count = np.diff(np.append(start, len(order)))
    df = np.empty(len(order), np.int64)
    df[order] = np.repeat(count, count)
    n = np.bincount(docs)[docs[block]]
    mask = (1 << 21) - 1
    bucket = (961 * (gram >> 42) + 31 * (gram >> 21 & mask) + (gram & mask)) % TFIDF_DIMS
    return block, bucket, tf * np.log(1 + n / (df + 1))


def tfidf(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, vector (256 numbers) of lower-cased trigrams by hash bucket. A block without a trigram has zeros."""

    def whole(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = rows.column("doc_id").to_numpy()
        docs = np.repeat(np.arange(len(first := runs(ids))), np.diff(np.append(first, len(ids))))
        yield from dense(rows, *tfidf_entries(rows.column("text").to_pylist(), docs), TFIDF_DIMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last document, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            last = int(runs(rows.column("doc_id").to_numpy())[-1])
            if last:
                yield from whole(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield from whole(held)

    rows = blocks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("block_idx").cast("int").alias("block_idx"), F.lower("text").alias("text"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, EMBEDDINGS)


def charfreq(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, vector (128 numbers): code points modulo 128, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, lengths = code_points(batch.column("text").to_pylist())
            yield from dense(batch, np.repeat(np.arange(batch.num_rows), lengths), codes % CHARS_DIMS, np.ones(len(codes)), CHARS_DIMS)

    return blocks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("block_idx").cast("int").alias("block_idx"), "text").mapInArrow(run, EMBEDDINGS)
