"""Near-dedup against brute force on drawn near copies of all likenesses."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from gapweave.llm import near_dedup as near
from gapweave.llm.near_dedup import near_dedup

from .helpers import as_table


def brute(docs, percent=85):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def drawn(seed, groups=12, size=14):
    rng = random.Random(seed)
    docs, n = [], 0
    common = [f"c{rng.randrange(999)}" for _ in range(60)]
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 40, 120, 300]))]
        if g % 3 == 0:
            base = base + common
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            docs.append((n, " ".join(words)))
            n += 1
    rng.shuffle(docs)
    return docs


def test_links_match_brute_force(spark):
    docs = [*drawn(3), (9001, None), (9002, ""), (9003, " \n\t"), (9004, "ONE two"), (9005, "one TWO")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(as_table(spark, docs)).collect()}
    assert got == brute(docs)


def test_empty_table_and_repeated_rows(spark):
    assert near_dedup(as_table(spark, [])).count() == 0
    rows = near_dedup(as_table(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (1, 1), (2, 1)]


def test_grid_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near, "MEMBERS", 7)
    docs = drawn(5, groups=4, size=40)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(as_table(spark, docs), percent=80).collect()}
    assert got == brute(docs, 80)


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    other = list(base)
    for _ in range(300):
        other[rng.randrange(len(other))] = "changed"
    docs = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:30_000])), (4, "x y")]
    clash = {c: F.lit(7) for c in ("key", "node", "label", "n", "s1", "s2", "bands", "least", "i", "j", "mine", "signature", "shingles", "kept", "component")}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(as_table(spark, docs).withColumns(clash)).collect()}
    assert got == brute(docs) and got[2][1] == 1 and got[3][1] == 3


def test_links_of_a_group_are_a_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = []
    for _ in range(120):
        own = base.copy()
        hit = rng.random(400) < rng.choice([0.02, 0.06, 0.1, 0.2])
        own[hit] = rng.integers(0, 1 << 63, hit.sum()).astype(np.uint64)
        sets.append(np.sort(own))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    planes = np.frombuffer(b"".join(near.pack(near.minima_of(np.concatenate(sets), offsets))), "<u8").reshape(-1, near.BITS, near.WORDS)
    labels = np.arange(120)
    x, y = (np.array(k) for k in zip(*[(a, b) for a in range(120) for b in range(a)]))
    both = near.common_of_all(sets, x, y)
    assert both.tolist() == [near.common(sets[a], sets[b]) for a, b in zip(x, y)] == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    want = near.Forest()
    for a, b, k in zip(x.tolist(), y.tolist(), both.tolist()):
        if 100 * k >= 85 * (800 - k):
            want.join(a, b)
    links = near.group_links(labels, np.ones(120, bool), planes, sets, 85)
    got = near.Forest()
    assert all(got.join(a, b) for a, b in links)
    assert [got.root(a) for a in range(120)] == [want.root(a) for a in range(120)]
