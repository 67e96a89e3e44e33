"""Token-id files with Elias-Fano coded document boundaries.

Each range of doc_ids becomes one file: the ids of its documents in a row, then the documents' end positions and the
doc_ids, both as Elias-Fano sequences (n values below U take about n * (2 + log2(U / n)) bits), each with a sampled
select structure. A document's offset comes from its sample, a few words of the upper bits and one low-bits read; no
table of 64-bit offsets exists on disk or in memory.

File: ids (16 or 32 bits, little-endian) | ends | doc_ids less the first | footer (fixed numbers, see ``FOOTER``).
Executors write into the shared folder of ``spark.checkpoint.dir`` under names unique to the attempt; a manifest names
those of attempts that succeeded, so lost executors and speculative tasks leave no trace in the result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from . import tokens
from .common import materialise, new_path, shuffle_partitions

#: Ones between two samples of the select structure.
SAMPLE = 256
#: Ids read at once from a file.
READ_IDS = 4 << 20
#: id width, documents, ids, first doc_id, bytes of the ends, bytes of the doc_ids
FOOTER = struct.Struct("<QQQqQQ")
HEAD = struct.Struct("<QQQQ")


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0 on."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        rest = values & np.uint64((1 << bits) - 1)
        low = np.packbits(((rest[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) >> 3) + 1 if n else 0, np.uint8)
        np.bitwise_or.at(high, ones >> 3, np.left_shift(1, ones & 7).astype(np.uint8))
        return cls(n, bits, low, high, ones[::SAMPLE].astype(np.uint32 if not n or ones[-1] < 1 << 32 else np.uint64))

    def to_bytes(self) -> bytes:
        head = HEAD.pack(self.count, self.low_bits | self.samples.itemsize << 8, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "EliasFano":
        count, bits, lows, highs = HEAD.unpack_from(raw)
        at = HEAD.size
        low, high = np.frombuffer(raw, np.uint8, lows, at), np.frombuffer(raw, np.uint8, highs, at + lows)
        return cls(count, bits & 255, low, high, np.frombuffer(raw, f"<u{bits >> 8}", -1, at + lows + highs))

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else np.zeros(len(i), np.int64)

    def select(self, begin: int, end: int) -> np.ndarray:
        """Values number begin to end, exclusive, by way of the sample before ``begin``."""
        if end <= begin:
            return np.zeros(0, np.int64)
        sample = begin // SAMPLE
        first = int(self.samples[sample]) >> 3
        later = -(-end // SAMPLE)
        last = (int(self.samples[later]) >> 3) + 1 if later < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + first * 8
        ones = ones[ones >= int(self.samples[sample])][begin - sample * SAMPLE : end - sample * SAMPLE]
        place = np.arange(begin, end)
        return ((ones - place) << self.low_bits) | self._low(place)

    def __getitem__(self, i: int) -> int:
        return int(self.select(i, i + 1)[0])


def write_file(uri: str, texts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> tuple[int, int]:
    """Write (doc_ids, ids, offsets of the documents in ids) of batches in order; documents and ids written."""
    store, path = fs.FileSystem.from_uri(uri)
    docs, ends, total = [], [], 0
    with store.open_output_stream(path) as out:
        for doc_ids, ids, offsets in texts:
            out.write(ids.astype(f"<u{width}").tobytes())
            docs.append(doc_ids)
            ends.append(offsets[1:] + total)
            total += int(offsets[-1])
        doc_ids = np.concatenate(docs)
        bounds, names = EliasFano.of(np.concatenate(ends)).to_bytes(), EliasFano.of(doc_ids - doc_ids[0]).to_bytes()
        out.write(bounds + names + FOOTER.pack(width, len(doc_ids), total, int(doc_ids[0]), len(bounds), len(names)))
    return len(doc_ids), total


class TokenFile:
    """A token file open for reading."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.width, self.n_docs, self.n_ids, self.first_id, bounds, names = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        at = size - FOOTER.size - names
        self.names = EliasFano.from_bytes(self.file.read_at(names, at))
        self.ends = EliasFano.from_bytes(self.file.read_at(bounds, at - bounds))

    def doc_ids(self, begin: int, end: int) -> np.ndarray:
        return self.names.select(begin, end) + self.first_id

    def offsets(self, begin: int, end: int) -> np.ndarray:
        """Where documents begin to end start, and where the last of them ends."""
        first = [0] if begin == 0 else [self.ends[begin - 1]]
        return np.concatenate([first, self.ends.select(begin, end)]).astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - begin) * self.width, begin * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        begin, end = self.offsets(i, i + 1)
        return self.ids(int(begin), int(end))


def write_tokens(docs: DataFrame, end_id: int = 1, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write token files in ascending doc_id order; the manifest: part, uri, n_docs, n_ids.

    Null text is empty and gives the end id alone. Rows without a doc_id have no place in the order and are left out.
    Rows that repeat a doc_id are written each, side by side. An empty table writes no file.
    """
    spark = docs.sparkSession
    path, folder = tokenizer or tokens.default_path(), folder or new_path(spark, "tokens")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = tokens.encoder(path), []

        def coded() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for rows in tokens.slices(batch, "text"):
                    seen[:] = [rows.column("part")[0].as_py()]
                    ids, offsets = encode.encode(rows.column("text"))
                    n = rows.num_rows
                    yield rows.column("doc_id").to_numpy(), np.insert(ids, offsets[1:], end_id), offsets + np.arange(n + 1)

        stream = coded()
        first = next(stream, None)
        if first is None:
            return
        store, where = fs.FileSystem.from_uri(folder)
        store.create_dir(where)
        uri = f"{folder}/{seen[0]:08d}-{uuid.uuid4().hex}.tok"
        n_docs, n_ids = write_file(uri, (x for y in ([first], stream) for x in y), encode.dtype().itemsize)
        yield pa.RecordBatch.from_pydict({"part": pa.array(seen, pa.int32()), "uri": [uri], "n_docs": [n_docs], "n_ids": [n_ids]})

    return materialise(rows.mapInArrow(write, "part int, uri string, n_docs long, n_ids long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of a manifest's files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    spark, before, files = manifest.sparkSession, 0, []
    for row in manifest.orderBy("part").collect():  # one small row a file
        files.append((row.uri, before))
        before += row.n_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                file, begin = TokenFile(uri), 0
                while begin < file.n_docs:
                    end = min(file.n_docs, begin + 4096)
                    bounds = file.offsets(begin, end)
                    if bounds[-1] - bounds[0] > READ_IDS:
                        end = begin + max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, "right")) - 1)
                        bounds = bounds[: end - begin + 1]
                    ids = file.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    raw, at = memoryview(ids).cast("B"), (bounds - bounds[0]) * 4
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_pydict({"doc_id": file.doc_ids(begin, end), "start": bounds[:-1] + base, "n_tokens": np.diff(bounds), "ids_crc32": pa.array(crc, pa.int64())})
                    begin = end

    table = spark.createDataFrame(files, "uri string, base long").repartition(min(len(files), 10_000))
    return table.mapInArrow(read, schema)
