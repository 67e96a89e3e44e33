"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a document's bytes from both ends, white space and all, labels every byte position with language
probabilities, and the mean over all positions of the whole text gives the document's. Texts are read in stretches of
``STRIDE`` bytes, many at once. Each direction begins ``OVERLAP`` bytes outside its stretch, so that every position is
labelled with what stands around it, and only the stretch's own positions count.

Its gates and states use x / (1 + |x|) where others use the logistic function and tanh: in numpy that takes a sixth of
the time.

Training takes a bounded sample of labelled rows (``ROWS_PER_LANGUAGE`` rows, ``CHARS_PER_ROW`` characters each, of every
language there is) to the driver and fits crops of ``CROP`` bytes by backpropagation through time with Adam. Prediction
sees the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import tokens

HIDDEN = 8
#: Bytes of a stretch, those read before it on either side, and stretches run at once.
STRIDE, OVERLAP, AT_ONCE = 256, 16, 512
#: Bytes of a training crop.
CROP = 48
#: Bounds of the training sample, and batches of crops fitted for each language.
ROWS_PER_LANGUAGE, CHARS_PER_ROW, BATCHES = 600, 2000, 240
#: Stands outside a text; it keeps the state as it is.
PAD = 256
UNKNOWN = "und"
FOLDS = 5


@dataclass
class BiGru:
    """Weights of both directions: what each byte adds to the gates, the recurrence, and the position classifier."""

    languages: list[str]
    inputs: list[np.ndarray]  # of each direction, 256 x 3 * HIDDEN
    recurrent: list[np.ndarray]  # of each direction, HIDDEN x 3 * HIDDEN
    out: np.ndarray  # 2 * HIDDEN x languages
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 0) -> "BiGru":
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(languages, [normal(256, 3 * HIDDEN, scale=0.3) for _ in "fb"], [normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5) for _ in "fb"], normal(2 * HIDDEN, len(languages), scale=0.3), np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.out, self.bias]


def padded(table: np.ndarray) -> np.ndarray:
    """The input table with a row for ``PAD``: its update gate is 1."""
    row = np.zeros((1, table.shape[1]), table.dtype)
    row[0, :HIDDEN] = 1e30
    return np.concatenate([table, row])


def _sign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _read(x: np.ndarray, table: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """States (positions x rows x HIDDEN) of one direction over rows of bytes, and what each step needs to go back."""
    h, states, steps = np.zeros((len(x), HIDDEN), table.dtype), np.empty((x.shape[1], len(x), HIDDEN), table.dtype), []
    for t in range(x.shape[1]):
        pre, rec = table[x[:, t]], h @ u
        gates = 0.5 + 0.5 * _sign(pre[:, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN])
        z, r, own = gates[:, :HIDDEN], gates[:, HIDDEN:], rec[:, 2 * HIDDEN :]
        n = _sign(pre[:, 2 * HIDDEN :] + r * own)
        steps.append((h, z, r, n, own))
        h = n + z * (h - n)
        states[t] = h
    return states, steps


def _slope(gate: np.ndarray) -> np.ndarray:
    """Of a gate by its value."""
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def states_of(model: BiGru, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States (positions x rows x HIDDEN) ahead of and behind each position, both directions in one go."""
    rows, length = x.shape
    both = np.ascontiguousarray(np.concatenate([x.T, x.T[::-1] + np.int32(PAD + 1)], axis=1))
    # the update gate's, the reset gate's and the candidate's tables and arrays, each in one piece
    parts = [slice(k * HIDDEN, (k + 1) * HIDDEN) for k in range(3)]
    tables = [np.ascontiguousarray(np.concatenate([padded(t) for t in model.inputs])[:, p]) for p in parts]
    turns = [np.ascontiguousarray(np.stack(model.recurrent)[:, :, p]) for p in parts]
    states = np.empty((length, 2 * rows, HIDDEN), np.float32)
    z, r, n, rec, size = (np.empty((2 * rows, HIDDEN), np.float32) for _ in range(5))
    h = np.zeros((2 * rows, HIDDEN), np.float32)

    def turned(k: int) -> np.ndarray:
        np.matmul(h.reshape(2, rows, HIDDEN), turns[k], out=rec.reshape(2, rows, HIDDEN))
        return rec

    def signed(a: np.ndarray) -> None:
        np.abs(a, out=size)
        np.add(size, 1, out=size)
        np.divide(a, size, out=a)

    for t in range(length):
        for gate, k in ((z, 0), (r, 1)):
            np.take(tables[k], both[t], axis=0, out=gate, mode="clip")
            gate += turned(k)
            signed(gate)
            gate += 1
            gate *= 0.5
        np.take(tables[2], both[t], axis=0, out=n, mode="clip")
        r *= turned(2)
        n += r
        signed(n)
        h -= n
        h *= z
        h += n
        states[t] = h
    return states[:, :rows], states[::-1, rows:]


def position_probabilities(model: BiGru, x: np.ndarray) -> np.ndarray:
    """positions x rows x languages."""
    ahead, behind = states_of(model, x)
    return _softmax(ahead @ model.out[:HIDDEN] + behind @ model.out[HIDDEN:] + model.bias)


def gradients(model: BiGru, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions that are no ``PAD``, and its gradient by backpropagation through time."""
    x = x.astype(np.int32)
    sides = [_read(x, padded(model.inputs[0]), model.recurrent[0]), _read(x[:, ::-1], padded(model.inputs[1]), model.recurrent[1])]
    both = np.concatenate([sides[0][0], sides[1][0][::-1]], axis=2)
    p = _softmax(both @ model.out + model.bias)
    rows, inside = np.arange(len(x)), x.T != PAD
    loss = -float((np.log(p[:, rows, y] + 1e-9) * inside).sum() / inside.sum())
    p[:, rows, y] -= 1
    p *= inside[:, :, None] / p.dtype.type(inside.sum())
    flat = p.reshape(-1, p.shape[2])
    d_out, d_bias = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
    d_both = p @ model.out.T
    d_inputs, d_recurrent = [], []
    for k, (d_states, order) in enumerate(((d_both[:, :, :HIDDEN], x), (d_both[::-1, :, HIDDEN:], x[:, ::-1]))):
        u, d_pre, d_u = model.recurrent[k], np.empty((x.shape[1], len(x), 3 * HIDDEN), p.dtype), np.zeros_like(model.recurrent[k])
        later = np.zeros((len(x), HIDDEN), p.dtype)
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, r, n, own = sides[k][1][t]
            d = d_states[t] + later
            d_n = d * (1 - z) * (1 - np.abs(n)) ** 2
            d_pre[t, :, :HIDDEN], d_pre[t, :, 2 * HIDDEN :] = d * (h - n) * _slope(z), d_n
            d_pre[t, :, HIDDEN : 2 * HIDDEN] = d_n * own * _slope(r)
            d_rec = d_pre[t].copy()
            d_rec[:, 2 * HIDDEN :] *= r
            d_u += h.T @ d_rec
            later = d * z + d_rec @ u.T
        read, d_pre = order.T.ravel(), d_pre.reshape(-1, 3 * HIDDEN)
        d_inputs.append(np.stack([np.bincount(read, weights=column, minlength=PAD + 1)[:PAD] for column in d_pre.T], axis=1).astype(p.dtype))
        d_recurrent.append(d_u)
    return loss, [*d_inputs, *d_recurrent, d_out, d_bias]


def stretches(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in a row: text, first byte and end of each stretch."""
    counts = -(-np.diff(offsets) // STRIDE)
    owner = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][owner] + nth * STRIDE
    return owner, begin, np.minimum(begin + STRIDE, offsets[1:][owner])


def text_sums(model: BiGru, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the position probabilities of each text; ``raw`` has all texts' bytes in a row."""
    owner, begin, end = stretches(raw, offsets)
    sums, window = np.zeros((len(offsets) - 1, len(model.languages))), np.arange(-OVERLAP, STRIDE + OVERLAP)
    for k in range(0, len(owner), AT_ONCE):
        of, b, e = owner[k : k + AT_ONCE], begin[k : k + AT_ONCE], end[k : k + AT_ONCE]
        at = b[:, None] + window[: OVERLAP + int((e - b).max()) + OVERLAP]
        inside = (at >= offsets[of][:, None]) & (at < offsets[of + 1][:, None])
        x = np.where(inside, raw[np.clip(at, 0, len(raw) - 1)].astype(np.int32), np.int32(PAD))
        p = position_probabilities(model, x)
        p *= ((at >= b[:, None]) & (at < e[:, None])).T[:, :, None]
        np.add.at(sums, of, p.sum(axis=0))
    return sums


def crops(texts: list[bytes], n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` crops of 4 to ``CROP`` bytes from starts of words, drawn evenly over all bytes; the rest of a row is ``PAD``.

    Short crops teach the network to label where little stands around, as in short texts.
    """
    out = np.full((n, CROP), PAD, np.int32)
    sizes = np.array([len(t) for t in texts])
    lengths = np.exp(rng.uniform(np.log(4), np.log(CROP + 1), n)).astype(int)
    for row, i, length in zip(out, rng.choice(len(texts), n, p=sizes / sizes.sum()), lengths):
        at = rng.integers(0, sizes[i])
        at = max(texts[i].rfind(b" ", 0, at), texts[i].rfind(b"\n", 0, at)) + 1
        found = np.frombuffer(texts[i], np.uint8)[at : at + length]
        row[: len(found)] = found
    return out


def train(samples: list[tuple[str, str]], batches: int = BATCHES, batch: int = 128, seed: int = 0) -> BiGru | None:
    """A model of (text, language) samples, or None without any; ``batches`` of crops are fitted for each language."""
    languages = sorted({language for _, language in samples})
    if not languages:
        return None
    rng, model = np.random.default_rng(seed), BiGru.fresh(languages, seed)
    texts: dict[int, list[bytes]] = {k: [] for k in range(len(languages))}
    for text, language in samples:
        if raw := text.encode().lower():
            texts[languages.index(language)].append(raw)
    if not any(texts.values()):
        return model
    drawn = [(crops(own, batches * batch, rng), k) for k, own in texts.items() if own]
    x, y = np.concatenate([c for c, _ in drawn]), np.concatenate([np.full(len(c), k) for c, k in drawn])
    moments, lengths = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()], (x != PAD).sum(axis=1)
    parts = np.array_split(np.lexsort((rng.random(len(x)), lengths)), len(x) // batch)  # crops of like length together
    for step, k in enumerate(rng.permutation(len(parts)), 1):
        rows = parts[k]
        _, grads = gradients(model, x[rows, : lengths[rows].max()], y[rows])
        rate = 0.02 * 0.05 ** (step / len(parts))
        for w, g, (m, v) in zip(model.weights(), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def held_out(name: str = "doc_id", folds: int = FOLDS) -> F.Column:
    return F.coalesce(F.crc32(F.col(name).cast("string")) % folds == 0, F.lit(False))


def fit(docs: DataFrame) -> BiGru | None:
    """Train on rows with a language and a doc_id outside the held-out fold."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = usable.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, ROWS_PER_LANGUAGE / r["count"]))])
    drawn = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000
    rows = usable.where(drawn).select("doc_id", F.substring("text", 1, CHARS_PER_ROW).alias("text"), "lang").limit(2 * ROWS_PER_LANGUAGE * len(counts)).collect()
    return train([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.text, r.lang))])


def predict(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (the document probability of that language).

    ``und`` with score 0 where the text is null or has no letter, or nothing could be learned. Columns of ``docs``
    named lang_pred or score are replaced. An empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    fields = [f"`{n}` {t}" for n, t in docs.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                n = rows.num_rows
                texts = pc.fill_null(rows.column("text").cast(pa.string()), "")
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                names, scores = np.full(n, UNKNOWN, object), np.zeros(n)
                if model is not None:
                    lower = pc.ascii_lower(texts).cast(pa.large_binary())
                    at = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + n + 1]
                    raw = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
                    pooled = text_sums(model, raw, at - at[0])
                    pooled = pooled / np.maximum(pooled.sum(axis=1, keepdims=True), 1e-12)
                    best = pooled.argmax(axis=1)
                    names = np.where(letters, np.array(model.languages, object)[best], UNKNOWN)
                    scores = np.where(letters, np.clip(pooled[np.arange(n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*rows.schema.names, "lang_pred", "score"])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def identify(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """``predict`` with a model fitted on ``training`` (default: ``docs``)."""
    return predict(docs, fit(training if training is not None else docs))
