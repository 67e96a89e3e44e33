"""Operators on small cases with known results, and folds against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from gapweave.functions import text as T, vectors as V
from gapweave.operators import blocks as B, detect as D, evaluate as E, gaps as G, quality as Q, segments as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def blocks(spark, docs):
    """Blocks from {doc_id: [(kind, level, text, tokens, lines)]}."""
    rows = [(d, i, k, t, t, lv, i * 10, i * 10 + 10, n, ls, False) for d, bs in docs.items() for i, (k, lv, t, n, ls) in enumerate(bs)]
    schema = "doc_id long, block_idx int, kind string, text string, title string, heading_level int, start_byte int, end_byte int, tokens int, lines int, is_pseudo boolean"
    return B.with_heading_path(spark.createDataFrame(rows, schema))


def cuts(spark, docs):
    return spark.createDataFrame([(d, g) for d, gs in docs.items() for g in gs] or [], "doc_id long, gap_idx int")


def gathered(df, column="gap_idx"):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r[column])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("text, tokens", [("hello world", 3), ("日本語", 3), ("Hello日本語", 5), ("", 0), (None, 0)])
def test_token_estimate(spark, text, tokens):
    assert value(spark, T.token_estimate(F.lit(text).cast("string"))) == tokens


@pytest.mark.parametrize("text, slug", [("Hello World", "hello-world"), ("C++ Programming", "c-programming"), ("foo@bar#baz", "foo-bar-baz"), ("---", ""), ("タスク管理API", "タスク管理api"), ("Hello 世界", "hello-世界"), ("  é x ", "x"), ("a" * 60, "a" * 50), ("", "")])
def test_slugify(spark, text, slug):
    assert value(spark, T.slugify(F.lit(text))) == slug


@pytest.mark.parametrize("text, plain", [("# Hello\n## World", "Hello\nWorld"), ("![alt](image.png)", "alt"), ("text\n---\nmore", "text\n\nmore"), ("1. first\n2. second", "first\nsecond"), ("**b** and *i* and __u__", "b and i and u"), ("snake_case_name", "snake_case_name"), ("```go\nx\n```", "\nx\n"), ("> q <b>x</b>", "q x")])
def test_strip_markdown(spark, text, plain):
    assert value(spark, T.strip_markdown(F.lit(text))) == plain


def test_normalize(spark):
    whole = T.NormalizeConfig(strip_markdown=True, lower=True)
    assert value(spark, T.normalize(F.lit("# Café\n\n**Bold**  and   *italic*"), whole)) == "café bold and italic"


def test_context_round_trip(spark):
    path = F.array(F.lit("A"), F.lit("B"))
    assert value(spark, T.context_header(path, "comment")) == "<!-- context: A > B -->\n\n"
    assert value(spark, T.context_header(path, "front-matter")) == "---\ncontext:\n  - A\n  - B\n---\n\n"
    assert value(spark, T.context_header(path, "heading", max_depth=1)) == "# A\n\n"
    assert value(spark, T.context_header(path, "other")) == "" == value(spark, T.context_header(F.array().cast("array<string>"), "comment"))
    for style in ("comment", "front-matter"):
        assert value(spark, T.strip_context(F.concat(T.context_header(path, style), F.lit("body\n")))) == "body\n"


def test_cosine_of_odd_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x]).cast("array<double>")
    assert value(spark, V.cosine(v(1, 0), v(1, 0))) == 1.0
    for a, b in ((v(1, 0), v(0, 1)), (v(0, 0), v(1, 1)), (v(1), v(1, 2)), (v(), v()), (v("nan"), v(1)), (v("inf"), v(1)), (F.lit(None).cast("array<double>"), v(1))):
        assert value(spark, V.cosine(a, b)) == 0.0


P, H = ("paragraph", 0, "p", 1, 1), ("heading", 1, "h", 1, 1)


def test_heading_snap(spark):
    cases = {1: ([P, H, P], [1]), 2: ([P, H, H, P], [2]), 3: ([H, H, H, P, P], [2]), 4: ([P, H, H, P, H, P], [2, 4]), 5: ([P, H, H, P], [1, 2]), 6: ([P, P, P], [1])}
    got = gathered(S.adjust_heading_boundaries(blocks(spark, {d: c[0] for d, c in cases.items()}), cuts(spark, {d: c[1] for d, c in cases.items()})))
    assert got == {1: [0], 2: [0], 3: [0], 4: [0, 3], 5: [0], 6: [1]}


def test_flat_snap(spark):
    word = lambda t: ("paragraph", 0, t, 1, 1)
    docs = {1: [word("alpha one"), word("alpha two"), word("zeta label"), word("zeta label three"), word("zeta label four")], 2: [word("a"), word("b")]}
    assert gathered(S.adjust_flat_boundaries(blocks(spark, docs), cuts(spark, {1: [2], 2: [0]}))) == {1: [1], 2: [0]}


def test_flat_snap_makes_no_row_of_a_token_and_leaves_what_it_does_not_move(spark):
    word = lambda t: ("paragraph", 0, t, 1, 1)
    docs = {1: [word("alpha"), word("beta"), word("gamma one"), word("gamma two")], 2: [H, word("alpha"), word("zeta"), word("zeta")], 3: [word("a"), word(None), word("b")]}
    moved = S.adjust_flat_boundaries(blocks(spark, docs), cuts(spark, {1: [1, 2, 2, 9], 2: [2], 3: [1], 4: [3]}))
    assert gathered(moved) == {1: [1, 9], 2: [2], 3: [1], 4: [3]}
    assert "explode" not in moved._jdf.queryExecution().toString()


def test_depth_score_by_walk(spark):
    rng = random.Random(5)
    series = {d: [rng.randrange(6) / 5 for _ in range(rng.randrange(1, 15))] for d in range(40)}
    rows = spark.createDataFrame([(d, i, v) for d, s in series.items() for i, v in enumerate(s)], "doc_id long, gap_idx int, similarity double")
    got = {(r.doc_id, r.gap_idx): r.depth for r in G.with_depth(rows).collect()}
    for d, s in series.items():
        for i, v in enumerate(s):
            left = right = v
            for x in reversed(s[:i]):
                if x < left:
                    break
                left = x
            for x in s[i + 1 :]:
                if x < right:
                    break
                right = x
            assert got[d, i] == pytest.approx(left + right - 2 * v)


def segs(assigned, column="tokens"):
    out = {}
    for r in assigned.groupBy("doc_id", "seg_idx").agg(F.sum(column).alias("s")).orderBy("doc_id", "seg_idx").collect():
        out.setdefault(r.doc_id, []).append(r.s)
    return out


def sized(spark, docs):
    """Blocks of the given token counts, and a segmentation with one block each."""
    b = blocks(spark, {d: [("paragraph", 0, "x", n, n) for n in ns] for d, ns in docs.items()})
    return S.split_at(b, cuts(spark, {d: range(len(ns) - 1) for d, ns in docs.items()}))


def test_merge_undersized_is_the_restarting_scan(spark):
    rng = random.Random(9)
    docs = {d: [rng.randrange(1, 60) for _ in range(rng.randrange(1, 12))] for d in range(40)}

    def plain(ns):
        ns = list(ns)
        while len(ns) > 1 and any(n < 30 for n in ns):
            i = next(i for i, n in enumerate(ns) if n < 30)
            at = 0 if i == 0 else i - 1 if i == len(ns) - 1 or ns[i - 1] <= ns[i + 1] else i
            ns[at : at + 2] = [ns[at] + ns[at + 1]]
        return ns

    assert segs(S.merge_undersized(sized(spark, docs), 30)) == {d: plain(ns) for d, ns in docs.items()}


def test_pack_and_barrier(spark):
    assert segs(S.pack_segments(sized(spark, {1: [10] * 5, 2: [20] * 4}), 0, 30)) == {1: [30, 20], 2: [20] * 4}
    assert segs(S.pack_segments(sized(spark, {1: [10] * 3}), 0, 0)) == {1: [10] * 3}
    b = blocks(spark, {1: [("paragraph", 0, "x", 5, 1), ("heading", 2, "h", 5, 1), ("heading", 3, "h", 5, 1)]})
    apart = S.split_at(b, cuts(spark, {1: [0, 1]}))
    assert segs(S.pack_segments(apart, 100, 0, barrier=2)) == {1: [5, 10]}


def test_split_oversized(spark):
    one = S.split_at(blocks(spark, {1: [("paragraph", 0, "x", 200, 1)] * 10}), cuts(spark, {}))
    got = segs(S.split_oversized(one, None, 800, 0))[1]
    assert len(got) >= 2 and max(got) <= 800 and sum(got) == 2000
    depths = spark.createDataFrame([(1, g, 1.0 if g == 6 else 0.1) for g in range(9)], "doc_id long, gap_idx int, depth double")
    assert segs(S.split_oversized(one, depths, 1400, 0))[1] == [1400, 600]


def test_metrics_by_hand(spark):
    size = lambda n: spark.createDataFrame([(1, n)], "doc_id long, n int")
    run = lambda n, ref, hyp, **kw: E.evaluate(size(n), cuts(spark, {1: ref}), cuts(spark, {1: hyp}), "m", **kw).first()
    assert run(6, [2], [3], k=1).pk == pytest.approx(0.4)
    assert run(6, [2], [3], k=2).window_diff == pytest.approx(0.5)
    r = run(12, [2, 5, 8], [2, 7], tolerance=0)
    assert (r.precision, r.recall) == (pytest.approx(1 / 2), pytest.approx(1 / 3))
    r = run(9, [2, 5], [3, 6], tolerance=1)
    assert (r.precision, r.recall, r.f1, r.num_segments) == (1.0, 1.0, 1.0, 3)
    r = run(9, [], [])
    assert (r.precision, r.recall, r.f1, r.pk) == (1.0, 1.0, 1.0, 0.0)
    assert run(1, [], []).window_diff == 0.0


def test_greedy_matching_is_plain_greedy(spark):
    rng = random.Random(2)
    draw = lambda: sorted(rng.sample(range(20), rng.randrange(0, 9)))
    ref, hyp = {d: draw() for d in range(40)}, {d: draw() for d in range(40)}
    sizes = spark.createDataFrame([(d, 21) for d in range(40)], "doc_id long, n int")
    got = {r.doc_id: (r.precision, r.recall) for r in E.boundary_prf(sizes, cuts(spark, ref), cuts(spark, hyp), 2).collect()}
    for d in range(40):
        free, tp = list(ref[d]), 0
        for h in hyp[d]:
            near = min((g for g in free if abs(g - h) <= 2), key=lambda g: (abs(g - h), g), default=None)
            if near is not None:
                free.remove(near)
                tp += 1
        both = not ref[d] and not hyp[d]
        assert got[d] == (1.0 if both else tp / len(hyp[d]) if hyp[d] else 0.0, 1.0 if both else tp / len(ref[d]) if ref[d] else 0.0)


def test_auto_k_and_max_lines(spark):
    assert value(spark, E.auto_k(F.lit(10), F.lit(1))) == 2 and value(spark, E.auto_k(F.lit(10), F.lit(0))) == 5
    assert [value(spark, T.auto_max_lines(F.lit(n))) for n in (500, 3000, 10000, 50000, 0)] == [200, 300, 1000, 2000, 200]


def test_coherence_cases(spark):
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 0, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 0, [1.0, 1.0]), (4, 0, [0.0, 0.0]), (4, 1, [1.0, 0.0])], "doc_id long, block_idx int, vector array<double>")
    assigned = vectors.select("doc_id", "block_idx", F.lit(0).alias("seg_idx"))
    assert {r.doc_id: round(r.coherence, 9) for r in Q.coherence(assigned, vectors).collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0}


def test_pseudo_headings(spark):
    config = T.PseudoHeadingConfig(prefixes=("^Step", "("), exclude=("http",))
    check = lambda t: value(spark, T.is_pseudo_heading(F.lit(t), config))
    assert check("Short:") and check("1) item") and check("Step " + "x" * 90) and check("題名：")
    assert not check("plain") and not check("x" * 61 + ":") and not check("http: ") and not check("")


def test_detector_bounds(spark):
    b = blocks(spark, {1: [P] * 7, 2: [P] * 3, 3: [P]})
    assert gathered(D.FixedSplit(3).detect(b)) == {1: [2, 5]}
    assert D.FixedSplit(0).detect(b).count() == 0
    assert {k: len(v) for k, v in gathered(D.RandomSplit(4).detect(b)).items()} == {1: 4, 2: 2}
    assert gathered(D.validate(cuts(spark, {1: [-1, 0, 0, 5, 6], 3: [0]}), b)) == {1: [0, 5]}


def test_strict_boundaries_fail(spark):
    sizes = spark.createDataFrame([(1, 5)], "doc_id long, n long")
    assert E.strict(cuts(spark, {1: [0, 3]}), sizes).count() == 2
    for wrong in ([4], [-1], [1, 1]):
        with pytest.raises(Exception, match="out of range or repeated"):
            E.strict(cuts(spark, {1: wrong}), sizes).collect()
