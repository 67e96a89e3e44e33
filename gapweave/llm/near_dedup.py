"""MinHash near-dedup with b-bit signatures and exact confirmation.

1. Every text's set of word shingles gives minima under ``PERMUTATIONS`` hash functions, band keys over groups of
   them, and a signature of ``BITS`` low bits of each minimum, packed in one bit plane for each of them. Texts with
   equal sets are one class, of one node.
2. Classes that share a band key are candidates. With 30 bands of 5 rows a pair at a likeness of 0.85 is missed with
   probability (1 - 0.85^5)^30 = 2e-8.
3. Each class is first held against the smallest class among its buckets; the links found give components, and
   buckets whose members are all in one component are done.
4. The other buckets get the sets of their members. Inside a task, bit counts of the signatures, corrected for chance
   collisions, leave the pairs of different components within six standard deviations of the threshold; these are
   counted on the full sets, by a matrix product where they are many, and a union-find keeps the links that join
   components. No pair leaves a task: a bucket gives fewer rows than it has components.

A bucket larger than ``MEMBERS`` classes or ``BYTES`` of sets is a grid of tasks. Every pair of two components has a
member outside the bucket's largest component, so that one side of the grid holds only those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens
from .common import discard, materialise, shuffle_partitions
from .components import relabel
from .shingles import constants, finish, shingle_sets

BANDS, ROWS = 30, 5
PERMUTATIONS = BANDS * ROWS
#: Bits kept of a minimum, and the first of them; words of a bit plane.
BITS, FIRST_BIT = 4, 16
WORDS = -(-PERMUTATIONS // 64)
#: Classes, and bytes of their sets, on one side of a task's grid.
MEMBERS, BYTES = 1024, 16 << 20
#: Of the two sums that tell a set.
SALTS = (5, 77)
#: Pairs of signatures compared at once.
AT_ONCE = 1 << 19
#: Distinct shingles in one matrix product.
COLUMNS = 2048


def minima_of(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """sets x PERMUTATIONS minima of multiply-add hashes; zeros for an empty set."""
    a, b, some = constants(1, PERMUTATIONS), constants(2, PERMUTATIONS), np.flatnonzero(np.diff(offsets))
    minima, values, starts = np.zeros((len(offsets) - 1, PERMUTATIONS), np.uint64), np.empty_like(hashes), offsets[:-1][some]
    for p in range(PERMUTATIONS if len(some) else 0):
        np.multiply(hashes, a[p], out=values)
        values += b[p]
        minima[some, p] = np.minimum.reduceat(values, starts)
    return minima


def sum_of(hashes: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit sum over each set."""
    some = np.flatnonzero(np.diff(offsets))
    sums = np.zeros(len(offsets) - 1, np.uint64)
    if len(some):
        sums[some] = np.add.reduceat(finish(hashes + np.uint64(salt)), offsets[:-1][some])
    return sums.view(np.int64)


def pack(minima: np.ndarray) -> list[bytes]:
    """Signatures: ``BITS`` planes of one bit of each minimum."""
    planes = np.zeros((len(minima), BITS, 64 * WORDS), np.uint8)
    for k in range(BITS):
        planes[:, k, :PERMUTATIONS] = (minima >> np.uint64(FIRST_BIT + k)) & np.uint64(1)
    return [x.tobytes() for x in np.packbits(planes, axis=2).reshape(len(minima), -1)]


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (shingles), s1, s2 (the set's 128-bit sum), bands."""
    factors = constants(3, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                hashes, offsets = shingle_sets(rows.column("text"), width)
                n, minima = np.diff(offsets), minima_of(hashes, offsets)
                bands = finish((finish(minima).reshape(-1, BANDS, ROWS) * factors).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64)))
                sums = [pa.array(sum_of(hashes, offsets, salt)) for salt in SALTS]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), *sums, lists], names=["doc_id", "n", "s1", "s2", "bands"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, s1 (which tells the sets of a repeated doc_id apart), signature, shingles (sorted 64-bit hashes) of the nodes in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                hashes, offsets = shingle_sets(rows.column("text"), width)
                raw, at = hashes.astype("<u8").tobytes(), (8 * offsets).tolist()
                sets, signatures = [raw[x:y] for x, y in zip(at[:-1], at[1:])], pack(minima_of(hashes, offsets))
                yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(sum_of(hashes, offsets, SALTS[0])), pa.array(signatures, pa.binary()), pa.array(sets, pa.binary())], names=["node", "s1", "signature", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(wanted, "node")
    return rows.select("node", "text").mapInArrow(run, "node long, s1 long, signature binary, shingles binary")


class Forest:
    """Union-find over the labels of one group."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def least_equal(percent: int) -> int:
    """Equal signature values from which a pair is looked at: six standard deviations under the threshold, with chance collisions."""
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / PERMUTATIONS) ** 0.5
    return int(np.floor(PERMUTATIONS * (least + (1 - least) / (1 << BITS))))


def likely_pairs(labels: np.ndarray, mine: np.ndarray, n: np.ndarray, planes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and equal values of the pairs, x of ``mine``, that may reach the threshold; the likeliest first."""
    own, out, least = np.flatnonzero(mine), [], least_equal(percent)
    step = max(1, AT_ONCE // len(labels))
    for at in range(0, len(own), step):
        x = own[at : at + step]
        differ = planes[x, None, 0] ^ planes[None, :, 0]
        for k in range(1, BITS):
            differ |= planes[x, None, k] ^ planes[None, :, k]
        equal = PERMUTATIONS - np.bitwise_count(differ).sum(axis=2, dtype=np.int16)
        apart = (labels[x, None] != labels[None, :]) & ~(mine[None, :] & (np.arange(len(labels))[None, :] < x[:, None]))
        sized = (100 * np.minimum(n[x, None], n[None, :])) >= percent * np.maximum(n[x, None], n[None, :])
        i, y = np.nonzero(apart & sized & (equal >= least))
        out.append((x[i], y, equal[i, y]))
    x, y, equal = (np.concatenate(part) for part in zip(*out))
    order = np.argsort(-equal, kind="stable")
    return x[order], y[order], equal[order]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def common_of_all(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intersection sizes of the pairs (x, y) of many sets: a product of matrices over the shingles that two sets or more have."""
    rows, cols = np.unique(x), np.unique(y)
    used = np.unique(np.concatenate([rows, cols]))
    sizes = np.array([len(sets[i]) for i in used])
    _, column, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    owner, column = np.repeat(np.arange(len(used)), sizes)[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left, right = np.searchsorted(used, rows), np.searchsorted(used, cols)
    total = np.zeros((len(rows), len(cols)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        has = np.zeros((len(used), COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        total += has[left] @ has[right].T
    return total[np.searchsorted(rows, x), np.searchsorted(cols, y)].astype(np.int64)


def group_links(labels: np.ndarray, mine: np.ndarray, planes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (label, label) that join the components of one group, fewer than these are."""
    if (labels == labels[0]).all():
        return []
    n = np.array([len(s) for s in sets])
    x, y, _ = likely_pairs(labels, mine, n, planes, percent)
    if not len(x):
        return []
    forest, links = Forest(), []
    one_by_one = len(x) * 3e-5 + (n[x] + n[y]).sum() * 5e-9
    together = n.sum() * 3e-7 + len(np.unique(x)) * len(np.unique(y)) * float(n.sum()) * 1e-10
    both = common_of_all(sets, x, y) if together < one_by_one else None
    if both is not None:
        near = 100 * both >= percent * (n[x] + n[y] - both)
        x, y = x[near], y[near]
    for a, b in zip(x.tolist(), y.tolist()):
        la, lb = int(labels[a]), int(labels[b])
        if forest.root(la) == forest.root(lb):
            continue
        if both is None:
            k = common(sets[a], sets[b])
            if 100 * k < percent * (len(sets[a]) + len(sets[b]) - k):
                continue
        forest.join(la, lb)
        links.append((min(la, lb), max(la, lb)))
    return links


def confirmed(places: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between labels of the groups (key, i, j) that ``places`` (key, i, j, node, s1, label, mine) lists."""

    def links_of(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        labels, mine = rows.column("label").to_numpy(), rows.column("mine").to_numpy(zero_copy_only=False)
        planes = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u8").reshape(-1, BITS, WORDS)
        sets = [np.frombuffer(s.as_buffer(), "<u8") for s in rows.column("shingles")]
        found = [link for a, b in zip(starts[:-1], starts[1:]) for link in group_links(labels[a:b], mine[a:b], planes[a:b], sets[a:b], percent)]
        a, b = (np.array([link[k] for link in found], np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group read, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            names = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")])
            starts = np.concatenate([[0], 1 + np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0))])
            if len(starts) > 1:
                yield from links_of(rows, starts)
            held = rows.slice(int(starts[-1]))
            tokens.give_back()
        if held is not None:
            yield from links_of(held, np.array([0, held.num_rows]))

    rows = places.join(sets, ["node", "s1"]).select("key", "i", "j", "label", "mine", "signature", "shingles")
    dealt = rows.repartition(2 * shuffle_partitions(places.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def chunks(members: F.Column, size: F.Column) -> F.Column:
    """Into how many parts classes go, of which there are ``members`` with ``size`` shingles in all."""
    return F.greatest(F.lit(1), F.ceil(members / MEMBERS), F.ceil(8 * size / BYTES)).cast("int")


def star_places(nodes: DataFrame) -> DataFrame:
    """Groups of the classes (node, s1, n, least) that have one and the same smallest class in their buckets, which all are held against."""
    others = nodes.where("least < node")
    parts = others.groupBy("least").agg(chunks(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    place = lambda df, j, mine: df.select(F.col("least").alias("key"), F.lit(0).alias("i"), j.alias("j"), "node", "s1", F.col("node").alias("label"), F.lit(mine).alias("mine"))
    theirs = place(others.join(parts, "least"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), False)
    own = parts.join(nodes.select(F.col("node").alias("least"), "node", "s1"), "least")
    return theirs.unionByName(place(own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), True))


def bucket_places(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups of the buckets (key, node, s1, n) with members of several components."""
    named = members.join(labels, "node")
    by_label = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("size"))
    largest = F.max(F.struct("members", "size", "label"))
    about = by_label.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("members").alias("members"), F.sum("size").alias("size"), largest.alias("main")).where("labels > 1")
    parts, outside = chunks(F.col("members"), F.col("size")), chunks(F.col("members") - F.col("main.members"), F.col("size") - F.col("main.size"))
    about = about.select("key", F.col("main.label").alias("main"), parts.alias("parts"), outside.alias("outside"))
    rows = named.join(about, "key").withColumns({"own_i": F.pmod(F.xxhash64(F.lit(1), "node"), F.col("outside")).cast("int"), "own_j": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")})
    place = lambda i, j, mine: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(mine).alias("mine"))
    every = lambda n, make: F.transform(F.sequence(F.lit(0), n - 1), make)
    as_other = every(F.col("outside"), lambda i: place(i, F.col("own_j"), False))
    as_mine = F.when(F.col("label") != F.col("main"), every(F.col("parts"), lambda j: place(F.col("own_i"), j, True))).otherwise(F.array().cast("array<struct<i: int, j: int, mine: boolean>>"))
    # a bucket of one task has each class once
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), (F.col("label") != F.col("main")).alias("mine")))
    return rows.select("key", "node", "s1", "label", F.inline(F.when(F.col("parts") == 1, whole).otherwise(F.concat(as_other, as_mine))))


def near_dedup(docs: DataFrame, percent: int = 85, width: int = 5) -> DataFrame:
    """Per row with a doc_id: doc_id, n_shingles, component_id, kept.

    Linked are documents whose sets have 100 * intersection >= ``percent`` * union. Null or empty text, or text
    without a word, has an empty set and is linked with nothing. Rows without a doc_id are left out. Rows that repeat
    a doc_id count as one document that has each of their texts. An empty table gives no rows; other columns are
    ignored. The result is a table in the shared folder; the tables in between are deleted.
    """
    docs = docs.select("doc_id", "text")
    table = materialise(features(docs, width), "features")
    key = ["s1", "s2", "n"]
    classes = materialise(table.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "classes")
    bands = classes.select("node", "s1", "n", F.posexplode("bands").alias("band", "value")).select("node", "s1", "n", F.xxhash64("band", "value").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("least")).where("members > 1").drop("members")
    members = materialise(bands.join(shared, "key").select("key", "node", "s1", "n", "least"), "buckets")
    nodes = materialise(members.groupBy("node", "s1", "n").agg(F.min("least").alias("least")), "nodes")
    names = materialise(nodes.select("node", F.col("node").alias("label")).distinct(), "names")
    sets = materialise(sets_of(docs, names.select("node"), width), "sets")
    star = materialise(confirmed(star_places(nodes), sets, percent), "star-links")
    labels = relabel(names, star)
    places = bucket_places(members.select("key", "node", "s1", "n"), labels)
    links = materialise(confirmed(places, sets, percent), "links")
    final = relabel(labels, links)
    named = classes.select(*key, "node").join(final, "node", "left").select(*key, F.coalesce("label", "node").alias("component"))
    found = table.select("doc_id", *key).join(named, key, "left")
    component = F.coalesce("component", "doc_id")
    out = materialise(found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept")), "near-dedup")
    discard(table, classes, members, nodes, names, sets, star, labels, links, final)
    return out
