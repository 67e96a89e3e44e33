"""Word hashes of Arrow text columns, for operators on word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)


def finish(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * _MIX
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


def constants(seed: int, n: int) -> np.ndarray:
    """Fixed odd multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def split_words(texts: pa.Array, lower: bool) -> tuple[pa.ListArray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` as a list array (with empty strings at some ends), and its flat values."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    return lists, lists.flatten()


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word in a row, and each text's offsets in them. Null has no word."""
    lists, flat = split_words(texts, lower)
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    some = np.fromiter(map(len, words), np.int64, len(words))[codes] > 0 if len(words) else np.zeros(0, bool)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    ends = np.concatenate([[0], np.cumsum(some)])[bounds]
    return (hashes[codes[some]] if len(words) else hashes), ends


def window_hashes(words: np.ndarray, offsets: np.ndarray, width: int, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside each text, and each text's offsets in them."""
    sizes = np.maximum(np.diff(offsets) - width + 1, 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if not ends[-1]:
        return np.zeros(0, np.uint64), ends
    begin = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], sizes)
    total = np.zeros(len(begin), np.uint64)
    for k in range(width):
        total += words[begin + k] * factors[k]
    return finish(total), ends


def shingle_sets(texts: pa.Array, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and offsets. A shorter text is one shingle, none has none."""
    words, offsets = word_hashes(texts, lower)
    factors = constants(41, width)
    inside, ends = window_hashes(words, offsets, width, factors)
    sizes, lengths = np.diff(ends), np.diff(offsets)
    short = (lengths > 0) & (sizes == 0)
    bounds = np.concatenate([[0], np.cumsum(np.where(short, 1, sizes))])
    hashes = np.empty(bounds[-1], np.uint64)
    hashes[np.repeat(~short, np.where(short, 1, sizes))] = inside
    few = np.flatnonzero(short)
    if len(few):  # fewer words than a shingle: the sequence as one, its length told apart
        own = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            has = lengths[few] > k
            own[has] += words[offsets[few[has]] + k] * factors[k]
        hashes[bounds[few]] = finish((own + lengths[few].astype(np.uint64)) * factors[-1])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[bounds]
