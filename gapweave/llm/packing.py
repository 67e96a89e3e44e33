"""Best-fit packing of tokenised documents by swap-based local search.

Pieces are dealt into shards of a fixed size by hash; each shard starts from best fit, largest first, and then takes
its emptiest bins apart: items move into gaps, change places one-for-one or two-for-one with smaller items of fuller
bins, always so that the sum of squared fills grows, until a bin is empty or no exchange helps. What stays badly
filled in the shards is packed anew together, so that a shard's last bin costs nothing at any number of shards.
Only lengths travel; a task holds one shard, and one sequence never has pieces of two shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens
from .common import materialise

#: Pieces of a shard.
SHARD = 20_000
#: Bins filled less than this go to the second round.
WELL_FILLED = 0.97
#: Exchanges tried on one bin before the next.
TRIES = 64
PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def tokenise_pieces(docs: DataFrame, capacity: int, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 of each document's pieces; ``row`` tells repeated rows apart."""
    path = tokenizer or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                ids, offsets = encode.encode(rows.column("text"))
                n = rows.num_rows
                ids, offsets = np.insert(ids, offsets[1:], end_id).astype("<u4"), offsets + np.arange(n + 1)
                sizes = np.diff(offsets)
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(n), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = offsets[:-1][owner] + number * capacity
                end = np.minimum(begin + capacity, offsets[1:][owner])
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((begin * 4).tolist(), (end * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(owner)), rows.column("row").take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array(end - begin), pa.array(crc, pa.int64())],
                    names=["doc_id", "row", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(cut, PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, largest first, into the fullest bin that takes it."""
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = some >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = gaps[gap].pop()
            if not gaps[gap]:
                some &= ~(1 << gap)
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        gaps[gap - size].append(b)
        some |= 1 << (gap - size)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, tries: int = TRIES) -> list[list[int]]:
    """Empty the emptiest bins by moves and by one-for-one and two-for-one exchanges that raise the squared fill."""
    fill = np.array([lengths[b].sum() for b in bins], np.int64)
    least = -(-int(fill.sum()) // capacity)
    open_bins = [b for b in np.argsort(fill, kind="stable").tolist() if fill[b] < capacity]
    left = len(bins)
    for d in open_bins:
        if left <= least:
            break
        items = np.array([i for b in open_bins if b != d for i in bins[b]], np.int64)
        where = np.array([b for b in open_bins if b != d for _ in bins[b]], np.int64)
        for _ in range(tries):
            if not bins[d] or not len(items):
                break
            gap = capacity - fill[where]
            best = None
            own = sorted(bins[d], key=lambda i: -lengths[i])
            for i in own:  # a move: into the smallest gap that takes it
                ok = np.flatnonzero(gap >= lengths[i])
                if len(ok):
                    at = ok[np.argmin(gap[ok])]
                    if fill[where[at]] + lengths[i] > fill[d]:
                        best = (int(where[at]), [i], None)
                        break
            if best is None:  # exchanges: what comes in less what goes out is as much of the gap as can be
                gain = 0
                pairs = [(i,) for i in own] + [(i, j) for a, i in enumerate(own[:12]) for j in own[a + 1 : 12]]
                for given in pairs:
                    more = sum(int(lengths[i]) for i in given) - lengths[items]
                    ok = np.flatnonzero((more > gain) & (more <= gap) & (fill[where] + more > fill[d]))
                    if len(ok):
                        at = ok[np.argmax(more[ok])]
                        gain, best = int(more[at]), (int(where[at]), list(given), int(at))
            if best is None:
                break
            target, given, at = best
            for i in given:
                bins[d].remove(i)
                bins[target].append(i)
                fill[d] -= lengths[i]
                fill[target] += lengths[i]
            if at is not None:
                taken = int(items[at])
                bins[target].remove(taken)
                bins[d].append(taken)
                fill[d] += lengths[taken]
                fill[target] -= lengths[taken]
                items, where = np.delete(items, at), np.delete(where, at)
            items, where = np.append(items, given), np.append(where, [target] * len(given))
        left -= not bins[d]
    return [b for b in bins if b]


def pack_shard(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item its bin's number, its place there, and how full that bin is."""
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    bin_of, place, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for k, members in enumerate(bins):
        sizes = lengths[members]
        bin_of[members], place[members], fill[members] = k, np.cumsum(sizes) - sizes, sizes.sum()
    return bin_of, place, fill


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null text is empty and takes its end id's one place. Documents longer than ``capacity`` are cut into pieces of it.
    Rows that repeat a doc_id, or have none, are packed each. An empty table gives no rows; other columns of ``docs``
    are ignored.
    """
    pieces = materialise(tokenise_pieces(docs, capacity, end_id, tokenizer), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("bin", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard))
    out_schema = f"{PIECE}, shard int, bin long, offset long, filled long"

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row", "piece"], kind="stable")
        bin_of, place, fill = pack_shard(pdf["length"].to_numpy(), capacity)
        return pdf.assign(bin=bin_of, offset=place, filled=fill)

    key = F.xxhash64("doc_id", "row", "piece")
    first = materialise(rest.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(packed, out_schema), "packed")
    good = F.col("filled") >= int(capacity * WELL_FILLED)
    loose = first.where(~good)
    if shards > 1:
        again = max(1, -(-loose.count() // shard))
        second = loose.withColumn("shard", F.pmod(key, F.lit(again)).cast("int")).drop("bin", "offset", "filled").groupBy("shard").applyInPandas(packed, out_schema)
        # two ranges of numbers for the two rounds
        done = first.where(good).withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    else:
        done = first.withColumn("round", F.lit(1))
    done = done.withColumn("bin", (F.col("bin") * 2 + (F.col("round") - 1)) * F.lit(1 << 24) + F.col("shard"))
    full = full.withColumn("bin", -1 - F.monotonically_increasing_id())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"]
    return full.select(*columns).unionByName(done.select(*columns))
