"""Cases in which an operator once did less than its whole job."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gapweave.llm import line_dedup, mixing, substring_dedup

from .helpers import as_table
from .test_edges import brute_words
from .test_near import brute


def test_substring_dedup_of_a_document_that_repeats_its_sections(spark):
    rng = random.Random(9)
    new = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    x, y, p, q, a, long = new(70), new(70), new(70), new(70), new(60), new(400)
    rows = [(1, x + a + y), (2, (p + a + q) * 2), (3, (q + a + p) * 3 + a), (4, new(30) + long + x), (5, (p + long + y) * 3), (6, long + p + long)]
    rows = [(i, " ".join(w)) for i, w in rows]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(as_table(spark, rows)).collect()}
    assert got[2][1] == 120 and got == brute_words(rows, 50)


def test_pipeline_links_near_copies_from_80_percent(spark):
    rng = random.Random(80)
    rows = []
    for k in range(60):
        base = [f"u{rng.randrange(10**9)}" for _ in range(300)]
        edited = list(base)
        for at in rng.sample(range(10, 290, 10), 4 + k % 5):  # five shingles each: likeness 0.76 to 0.87
            edited[at] = f"e{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited))]
    kept = {r.doc_id for r in corpus_pipeline.near(spark, as_table(spark, rows), "").collect()}
    want = {i for i, (_, _, keep) in brute(rows, 80).items() if keep}
    assert want != {i for i, (_, _, keep) in brute(rows, 85).items() if keep} and kept == want


@pytest.mark.parametrize("most", [10_000, 1])
def test_mixing_at_high_rates(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MAX_SOURCES", most)
    rows = [(i, "a", "en", "few") for i in range(40)] + [(100, "b" * 400_000, "en", "large")]
    table = as_table(spark, rows)
    for scale in (0.1, 0.16):  # rates of about 500 and 800
        out = mixing.mix(table, scale=scale).where("source = 'few'")
        rate = scale * 400_040 / 2 / 40
        u = {r.doc_id: r.u for r in table.select("doc_id", mixing.uniform(7, "doc_id").alias("u")).collect()}
        got = {r.doc_id: (r.n, r.low, r.high) for r in out.groupBy("doc_id").agg(F.countDistinct("replica").alias("n"), F.min("replica").alias("low"), F.max("replica").alias("high")).collect()}
        want = {}
        for i in range(40):
            total, k = math.exp(-rate), 0
            while total <= u[i]:
                k += 1
                total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            want[i] = (k, 0, k - 1)
        assert got == want and out.count() == sum(n for n, _, _ in want.values())


def test_mixing_numbers_copies_in_blocks(spark):
    rows = [(1, "a", "en", "few"), (2, "b" * 60_000, "en", "large")]
    got = [r.replica for r in mixing.mix(as_table(spark, rows)).where("source = 'few'").select("replica").collect()]
    assert sorted(got) == list(range(len(got))) and abs(len(got) - 30_000) < 12 * 30_000**0.5


def brute_across(rows, least, chars):
    lines = {i: t.split("\n") for i, t in rows}
    full = {i: [k for k, x in enumerate(ls) if x.strip()] for i, ls in lines.items()}
    letters = {i: [lines[i][k] for k in full[i]] for i in lines}
    out = {}
    for i in lines:
        gone = set()
        for m in (1, least):
            for p in range(len(letters[i]) - m + 1):
                window = letters[i][p : p + m]
                if m == 1 < least and len(window[0]) < chars:
                    continue
                if any(letters[j][q : q + m] == window for j in letters for q in range(len(letters[j]) - m + 1) if (j, q) < (i, p)):
                    gone |= set(range(full[i][p], full[i][p + m - 1] + 1))
        out[i] = ("\n".join(x for k, x in enumerate(lines[i]) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_line_runs_across_blank_lines_match_brute_force(spark, least):
    rng = random.Random(least)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " \t", "a long line", "d"]) for _ in range(rng.randrange(1, 14)))) for i in range(30)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(as_table(spark, rows), least, 5, across_blank=True).collect()}
    assert got == brute_across(rows, least, 5)


def test_pipeline_deletes_double_spaced_passages(spark):
    verse = "\n\n".join(f"verse number {k}" for k in range(20))
    rows = [(1, "own one\n" + verse), (2, "own two\n\n" + verse.replace("\n\n", "\n") + "\nend two"), (3, verse), (4, "own four\n" + verse + "\n\nend four")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, as_table(spark, rows), "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("own two\n\nend two", 16), 4: ("own four\n\nend four", 18)}


def test_substring_dedup_gets_long_texts_in_small_batches(spark):
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(80)]
    rows = [(i, " ".join([f"u{rng.randrange(10**9)}" for _ in range(3000)] + shared)) for i in range(400)]

    def small(batches):  # 400 rows of 32 KB
        for batch in batches:
            if batch.num_rows > 1 and batch.nbytes > 3 << 20:
                raise ValueError(f"a batch of {batch.nbytes} bytes")
            yield batch

    table = as_table(spark, rows).coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(table.mapInArrow(small, table.schema)).collect()}
    assert got == {i: (3080, 80 if i else 0) for i, _ in rows} and spark.conf.get(key) == before
