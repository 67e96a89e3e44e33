"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gapweave.llm import binary_tokens, fingerprints, language_id, line_dedup, mixing, packing, pii, substring_dedup, tokens
from gapweave.llm.exact_dedup import exact_dedup

from .helpers import as_table

LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(30_000))
ROWS = [
    (1, "the same text of some words here"), (2, "the same text of some words here"), (2, "the same text of some words here"), (3, None), (4, ""), (5, None), (6, " \n\t "),
    (7, LONG), (8, LONG + " tail"), (9, "é ü 日本語 😀 a@b.cc 4111 1111 1111 1111"), (None, "no id at all in this row"), (10, "x"), (11, "12345 !!! ..."),
    (12, "a line of text that repeats and is long enough\nnext\nlast"), (13, "a line of text that repeats and is long enough\nnext\nlast"), (14, "own\nnext\nlast\nnext\nlast"),
]
CLASH = ("hash", "run", "head", "body", "row", "node", "key", "n", "label", "runs", "longest", "base", "candidates", "bucket", "place", "guest", "rate", "replica", "mix_key", "score", "lang_pred", "kept", "spans", "paths", "first", "part")


@pytest.fixture(scope="module")
def docs(spark):
    return as_table(spark, ROWS).withColumns({c: F.lit(7) for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return as_table(spark, [])


def test_exact_dedup(docs, empty):
    got = exact_dedup(docs, keep="largest").collect()
    assert len(got) == len(ROWS) and exact_dedup(empty).count() == 0
    texts = {}
    for i, t in ROWS:
        texts.setdefault(t or "", []).append(i)
    for t, ids in texts.items():
        sha = hashlib.sha256(t.encode()).hexdigest()
        rows = [r for r in got if r.text_sha256 == sha]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rows)
        assert {(r.keep_id, r.group_size) for r in rows} == {(keep, len(ids))} and sum(r.kept for r in rows) == 1


def test_exact_dedup_of_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(600)]
    got = exact_dedup(as_table(spark, rows)).collect()
    for r in got:
        same = [i for i, t in rows if t == rows[r.doc_id][1]]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), r.doc_id == min(same))


def test_fingerprints(spark, docs, empty):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(ROWS) and fingerprints.fingerprints(empty).count() == 0
    order = sorted(ROWS, key=lambda r: (-(1 << 63) if r[0] is None else r[0]))
    for k, (i, t) in enumerate(order):
        if i in (2, None) or order[(k + 1) % len(order)][0] == 2:
            continue
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        r = next(x for x in got if x.doc_id == i)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 4] + following[: len(t) // 4]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[7].near_next > 0.95
    one = fingerprints.fingerprints(as_table(spark, [(1, "a b c d e f")])).first()
    assert one.near_next == 1.0


def test_likeness_follows_jaccard(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(0, 60, 2):
        a = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        b = a[: (n := rng.randrange(300))] + [f"v{rng.randrange(10**6)}" for _ in range(300 - n)]
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
        sets = [{tuple(w[k : k + 5]) for k in range(296)} for w in (a, b)]
        want[i] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    got = {r.doc_id: r.near_next for r in fingerprints.fingerprints(as_table(spark, rows)).collect()}
    errors = [got[i] - w for i, w in want.items()]
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.15


def token_ids(text):
    return Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbZé É'sß1½<|>\tİΣ́日 .,!😀\xa0\x85", max_size=40), max_size=6))
def test_encoder_is_the_tokenizer(texts):
    ids, offsets = tokens.encoder(tokens.default_path()).encode(pa.array([*texts, "<|startoftext|> don't"], pa.string()))
    for k, t in enumerate([*texts, "<|startoftext|> don't"]):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == token_ids(t)


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=256, shard=5).collect()
    assert packing.pack(empty).count() == 0
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    for i in {r[0] for r in ROWS}:
        of = [t for j, t in ROWS if j == i]
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        ids = [*token_ids(of[0]), 0]
        assert pieces == sorted((s, len(ids[s : s + 256]), crc(ids[s : s + 256])) for s in range(0, len(ids), 256) for _ in of)
    assert len(places) <= -(-sum(r.length for r in got) // 256) + 3


def test_local_search_fills_bins():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2048, 3000)
    loose = [[i] for i in range(200)]
    tight = packing.local_search([list(b) for b in loose], lengths[:200], 2048)
    assert sorted(i for b in tight for i in b) == list(range(200)) and len(tight) < 130
    assert all(lengths[b].sum() <= 2048 for b in tight)
    whole = packing.pack_shard(lengths, 2048)[0].max() + 1
    assert whole <= max(-(-lengths.sum() // 2048), (lengths > 1024).sum()) * 1.01 + 1


def test_token_files(docs, empty):
    manifest = binary_tokens.write_tokens(docs)
    got = sorted(binary_tokens.read_tokens(manifest).collect())
    assert binary_tokens.read_tokens(binary_tokens.write_tokens(empty)).count() == 0
    start, want = 0, []
    for i, t in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        ids = [*token_ids(t), 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert [tuple(r) for r in got] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=700))
def test_elias_fano_round_trip(values):
    values = np.sort(np.array(values, np.int64))
    raw = binary_tokens.EliasFano.of(values).to_bytes()
    again = binary_tokens.EliasFano.from_bytes(raw)
    assert again.select(0, len(values)).tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert again[i] == values[i]
    if len(values) > 600:
        assert len(raw) < len(values) * 8


def test_line_dedup(docs, empty):
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect() if r.doc_id != 2}
    assert line_dedup.line_dedup(empty).count() == 0
    assert got[13].text == "" and got[13].n_removed == 3 and got[12].n_removed == 0
    assert got[14].text == "own" and got[14].n_removed == 4 and got[3].text is None and got[None].text == "no id at all in this row"
    assert got[1].runs == 7 and got[1].longest == 7


def brute_lines(rows, least, chars):
    lines = {i: (t or "").split("\n") for i, t in rows}
    out = {}
    for i in lines:
        gone = set()
        for m in (1, least):
            for p in range(len(lines[i]) - m + 1):
                window = lines[i][p : p + m]
                if any(not x.strip() for x in window) or (m == 1 < least and len(window[0]) < chars):
                    continue
                if any(lines[j][q : q + m] == window for j in lines for q in range(len(lines[j]) - m + 1) if (j, q) < (i, p)):
                    gone |= set(range(p, p + m))
        out[i] = "\n".join(x for k, x in enumerate(lines[i]) if k not in gone)
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup_matches_brute_force(spark, least):
    rng = random.Random(least)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "a long line", "d"]) for _ in range(rng.randrange(1, 14)))) for i in range(30)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(as_table(spark, rows), least, 5).collect()}
    assert got == brute_lines(rows, least, 5)


def brute_words(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup_matches_brute_force(spark, docs, empty):
    rng = random.Random(4)
    passages = [[f"p{rng.randrange(30)}" for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 20))]
            p = rng.choice(passages)
            words += p[rng.randrange(0, 10) : rng.choice([len(p), len(p) - 5])]
        rows.append((i, " ".join(words)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, "")]
    run = lambda t, w: {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(t, w).collect()}
    assert run(as_table(spark, rows), 20) == brute_words(rows, 20)
    assert substring_dedup.substring_dedup(empty).count() == 0 and substring_dedup.substring_dedup(docs).count() == len(ROWS)
    own = [r for r in ROWS if r[0] not in (2, None)]
    got = run(docs, 50)
    assert {i: got[i] for i, _ in own} == brute_words(own, 50)


def test_substring_dedup_of_passages_twice_in_a_document(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    shared = [fresh(rng.randrange(60, 160)) for _ in range(5)]
    a, p, q = fresh(60), fresh(70), fresh(70)
    rows = [(1, " ".join(fresh(70) + a + fresh(70))), (2, " ".join(p + a + q + p + a + q)), (3, " ".join(q + p + a))]
    for i in range(10, 60):
        words = fresh(rng.randrange(30))
        for _ in range(rng.randrange(1, 4)):
            passage = rng.choice(shared)
            words += passage[rng.randrange(30) : rng.choice([len(passage), len(passage) - 9])] + fresh(rng.randrange(3))
        rows.append((i, " ".join(words + (words[-130:] if i % 2 else []))))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(as_table(spark, rows), 50).collect()}
    assert got == brute_words(rows, 50) and got[2][1] == 120


def test_spans_that_read_otherwise_are_refuted(spark):
    texts = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(200)))], "doc_id long, text string")
    copy, other = [f"a{i}" for i in range(30, 190)], [f"a{i}" for i in range(30, 190)]
    other[100] = "b"
    spans = lambda at: [(0, 111, 1, at)]
    losing = spark.createDataFrame([(2, " ".join(copy), spans(30)), (3, " ".join(other), spans(30)), (4, " ".join(copy), spans(31))], f"doc_id long, text string, spans {substring_dedup.SPANS}")
    assert sorted((r.doc_id, r.wrong) for r in substring_dedup.refuted(losing, texts, 50).collect()) == [(3, [0]), (4, [0])]


def test_personal_data(docs, empty):
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert pii.personal_data(empty).count() == 0
    assert got[9].spans == "email:10:16,card:17:36" and (got[9].n_email, got[9].n_card) == (1, 1)
    assert got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(digits):
        twice = [d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))]
        return sum(twice) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if "0" <= c <= "9"]
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out)]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["4111 1111 1111 1111", "4111-1111", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "a.b@c.d", "@x.y", "a@b", "+1 (017) 555-7713", "+", "(", ")", "é", "😀", " ", "-", ".", "@", "7", "00", "x", "+49 30 1234567", "5500005555555559", "\n", "..", "a_b%c@d-e.f-g.h"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))) for i in range(1500)]
    got = {r.doc_id: r for r in pii.personal_data(as_table(spark, rows)).collect()}
    for i, text in rows:
        want = plain_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s.startswith(k) for s in want) for k in PLAIN]


def test_precision_and_recall_of_learned_spans(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abdelmnorst", k=rng.randrange(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    secret = lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([32, 40, 64])))
    surname = lambda: word().capitalize()
    made = [
        lambda: ("secret", rng.choice(['token = "', "api key: ", 'password="', "secret="]), secret()),
        lambda: ("id", rng.choice(["ssn: ", "social security number ", "SSN no. "]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: ("person", rng.choice(["Dr. ", "Mrs ", "name: ", "signed by "]), f"{rng.choice(pii.GIVEN_NAMES)} {surname()}"),
        lambda: ("", "part ", digits(14)), lambda: ("", "", digits(8)), lambda: ("", "", f"{surname()} {surname()}"), lambda: ("", "see ", f"chapter-{digits(3)}-of-the-{word()}"),
    ]
    rows, want = [], {}
    for i in range(700):
        kind, before, value = rng.choice(made)()
        head = prose(5) + " " + before
        rows.append((i, head + value + rng.choice([" ", ", ", '" ', "; "]) + prose(4)))
        if kind:
            want[i] = f"{kind}:{len(head)}:{len(head) + len(value)}"
    got = {r.doc_id: [s for s in r.spans.split(",") if s.split(":")[0] in pii.ADDED] for r in pii.personal_data(as_table(spark, rows)).collect()}
    hits = sum(want.get(i) in spans for i, spans in got.items())
    said = sum(len(spans) for spans in got.values())
    assert hits >= 0.9 * len(want) and hits >= 0.95 * said, (hits, len(want), said)


def test_no_span_is_learned_where_labelers_never_agree(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Abc Def", "1234567", "a1b2c3d4e5f6g7h8", "x", "Ghi Jkl, mno"]) for _ in range(9))) for i in range(300)]
    assert {r.spans for r in pii.personal_data(as_table(spark, rows)).collect()} == {""}


def test_language_id(spark, docs, empty):
    rng = random.Random(0)
    syllables = {"en": ["the", "ing", "and", "wh"], "fr": ["é", "que", "ou", "aux"], "de": ["sch", "ung", "ß", "ein"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[g], k=3)) for _ in range(40)), g) for i in range(300) for g in [rng.choice(list(syllables))]]
    rows += [(900, None, "en"), (901, "123 !!", "fr"), (902, "the ing", None)]
    table = as_table(spark, rows)
    got = {r.doc_id: r for r in language_id.identify(table).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred in syllables
    tested = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(empty).count() == 0
    assert language_id.identify(docs).count() == len(ROWS)
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_stretches_give_what_a_plain_loop_over_positions_gives():
    m = language_id.BiGru.fresh(["a", "b", "c"], 2)
    sign = lambda v: v / (1 + np.abs(v))

    def walk(raw, k):
        h, out, size = np.zeros(language_id.HIDDEN), {}, language_id.HIDDEN
        for at, byte in raw:
            pre, rec = m.inputs[k][byte], h @ m.recurrent[k]
            z, r = (0.5 + 0.5 * sign(pre[s] + rec[s]) for s in (slice(0, size), slice(size, 2 * size)))
            n = sign(pre[2 * size :] + r * rec[2 * size :])
            h = (1 - z) * n + z * h
            out[at] = h
        return out

    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 5, 300, 256, 900)]
    got = language_id.text_sums(m, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for text, sums in zip(texts, got):
        want = np.zeros(3)
        for b in range(0, len(text), language_id.STRIDE):
            e, full = min(b + language_id.STRIDE, len(text)), list(enumerate(text))
            around = full[max(0, b - language_id.OVERLAP) : e + language_id.OVERLAP]
            ahead, behind = walk(around, 0), walk(around[::-1], 1)
            for at in range(b, e):
                logits = np.concatenate([ahead[at], behind[at]]) @ m.out + m.bias
                want += np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert sums == pytest.approx(want, rel=1e-4)


def test_gradient_is_the_slope():
    m = language_id.BiGru.fresh(["a", "b", "c"], 1)
    m.inputs, m.recurrent = [w.astype(np.float64) for w in m.inputs], [w.astype(np.float64) for w in m.recurrent]
    m.out, m.bias = m.out.astype(np.float64), m.bias.astype(np.float64)
    x, y = np.random.default_rng(0).integers(0, 256, (5, 4)), np.array([0, 1, 2, 0, 1])
    x[1, 2:] = x[4, 3:] = language_id.PAD
    _, grads = language_id.gradients(m, x, y)
    for w, g in zip(m.weights(), grads):
        at = np.unravel_index(np.argmax(np.abs(g)), w.shape)
        was, slope = w[at], 0.0
        for sign in (1, -1):
            w[at] = was + sign * 1e-3
            slope += sign * language_id.gradients(m, x, y)[0] / 2e-3
        w[at] = was
        assert g[at] == pytest.approx(slope, rel=0.02, abs=1e-4)


def test_mixing(spark, docs, empty):
    assert mixing.mix(empty).count() == 0
    rows = [(i, "abcd" * (1 + i % 3), "en", "big" if i % 3 else "small") for i in range(3000)]
    table = as_table(spark, rows)
    out = mixing.mix(table, {"big": 1.0, "small": 3.0}, scale=2.0).cache()
    size = {r.source: r.c for r in out.groupBy("source").agg(F.sum(F.char_length("text")).alias("c")).collect()}
    total = sum(len(r[1]) for r in rows)
    assert size["small"] == pytest.approx(2 * total * 0.75, rel=0.05) and size["big"] == pytest.approx(2 * total * 0.25, rel=0.12)
    again = mixing.mix(table, {"big": 1.0, "small": 3.0}, scale=2.0)
    assert sorted(map(tuple, out.select("doc_id", "replica").collect())) == sorted(map(tuple, again.select("doc_id", "replica").collect()))
    rate = {r.source: r.rate for r in mixing.rates(table, {"big": 1.0, "small": 3.0}, 2.0).collect()}["small"]
    copies = out.where("source = 'small'").groupBy("doc_id").count().groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect()
    for r in copies:
        if (want := 1000 * mixing.expected_share(rate, r["count"])) > 50:
            assert r.n == pytest.approx(want, rel=0.35)
    for weights in ({"other": 1.0}, {}, {"s": 0.0}):
        assert mixing.mix(docs, weights).count() == 0
    assert mixing.mix(docs).count() > 0


def test_mixing_of_a_source_of_one_character(spark):
    table = as_table(spark, [(0, "x", "en", "tiny"), *((i, "abcd" * 100, "en", "big") for i in range(1, 21))])
    rate = {r.source: r.rate for r in mixing.rates(table).collect()}
    assert rate["tiny"] == pytest.approx(4000.5)
    got = mixing.mix(table).groupBy("source").count().collect()
    assert abs(next(r["count"] for r in got if r.source == "tiny") - rate["tiny"]) < 6 * rate["tiny"] ** 0.5


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    word = lambda g: "".join(rng.choices({"en": ["the", "ing", "and", "wh"], "fr": ["é", "que", "ou", "aux"]}[g], k=4))
    rows = [(i, "\n".join(" ".join(word(g) for _ in range(15)) for _ in range(4)), g, f"s{i % 4}") for i in range(120) for g in ["en" if i % 3 else "fr"]]
    rows += [(500, rows[0][1] + "\nand then wh", "fr", "s0"), (501, "1234 !!!", "en", "s1"), (502, None, "en", "s1"), (503, "", "en", "s2")]
    as_table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = [r.doc_id for r in out.select("doc_id").collect()]
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            docs = out
    assert set(seen["language_id"]) == set(range(120)) | {500}
    assert set(seen["line_dedup"]) == set(seen["language_id"]) and set(seen["near_dedup"]) <= set(seen["line_dedup"])
    assert set(seen["best_fit_packing"]) == set(seen["source_mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["best_fit_packing"])
