"""Exact token ids of the word BPE tokenizer over Arrow columns, each distinct word encoded once.

The tokenizer normalises to NFC, lower-cases, and cuts at white space, letters, digits and marks before BPE, so that
no token, composition or special string crosses ASCII white space. The ids of a text are therefore the ids of its
white-space-separated words in a row, and encoding each distinct word of a batch once gives the same result as encoding whole texts.
"""

from __future__ import annotations

import ctypes
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Bytes of text handled at once.
BATCH_BYTES = 2 << 20
#: Fixed value: special tokens in this tokenizer begin so; such texts go to the tokenizer as they are.
SPECIAL = "<|"
#: Code points from here on, and apostrophes and spaces beyond ASCII, are left to the tokenizer library.
PLAIN = 0x250
LETTER, NUMBER, MARK, HARD = 0, 1, 2, 3
NO_RANK = np.int32(2**31 - 1)

_encoders: dict[str, "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the rest, in order, from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def _classes() -> np.ndarray:
    """The pre-tokenizer's class of each plain code point: letter runs, single numbers, runs of the rest."""
    found = np.full(PLAIN, MARK, np.uint8)
    for c in range(PLAIN):
        kind = unicodedata.category(chr(c))[0]
        found[c] = HARD if chr(c).isspace() or c == ord("'") else {"L": LETTER, "N": NUMBER}.get(kind, MARK)
    return found


class PairTable:
    """Ranks of merges, looked up for arrays of pairs in two hash tables: the second holds what collided in the first."""

    BITS = 20

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys, ranks = self._key(left, right), np.arange(len(left), dtype=np.int32)
        self.tables = []
        for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
            slots, held, value = self._slot(keys, salt), np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, NO_RANK)
            _, first = np.unique(slots, return_index=True)
            held[slots[first]], value[slots[first]] = keys[first], ranks[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
            self.tables.append((salt, held, value))
        self.rest = dict(zip(keys.tolist(), ranks.tolist()))  # in neither table: a handful at most

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray, salt: np.uint64) -> np.ndarray:
        return ((keys * salt) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        found = np.full(len(keys), NO_RANK)
        for salt, held, value in self.tables:
            slots = self._slot(keys, salt)
            np.copyto(found, value[slots], where=held[slots] == keys)
        for key, rank in self.rest.items():
            found[keys == np.uint64(key)] = rank
        return found


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        letters = _byte_letters()
        self.inner, self.last = (np.array([vocab[c + s] for c in letters], np.int32) for s in ("", end))
        self.pairs = PairTable(*(np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1)))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.classes = _classes()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-cased words in a row, and how many each has."""
        plain = [w if w.isascii() else unicodedata.normalize("NFC", w).lower() for w in words]
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        points = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
        kinds = self.classes[np.minimum(points, PLAIN - 1)]
        kinds[points >= PLAIN] = HARD
        owner = np.repeat(np.arange(len(plain)), lengths)
        hard = np.unique(owner[kinds == HARD])
        if len(hard):
            own = {int(i): self._whole(words[i]) for i in hard}
            easy = [i for i in range(len(words)) if i not in own]
            ids, counts = self.words([words[i] for i in easy]) if easy else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
            ends = np.cumsum(counts)
            own |= {i: ids[e - n : e] for i, e, n in zip(easy, ends.tolist(), counts.tolist())}
            return np.concatenate([own[i] for i in range(len(words))]), np.array([len(own[i]) for i in range(len(words))])
        if not len(points):
            return np.zeros(0, self.dtype), np.zeros(len(words), np.int64)
        begins = np.ones(len(points), bool)
        begins[1:] = (owner[1:] != owner[:-1]) | (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        raw = np.frombuffer("".join(plain).encode(), np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)[begins]
        symbols = self.inner[raw]
        ends = np.append(starts[1:], len(raw)) - 1
        symbols[ends] = self.last[raw[ends]]
        ids, counts = self._merge(symbols, starts)
        return ids.astype(self.dtype), np.bincount(owner[begins], weights=counts, minlength=len(words)).astype(np.int64)

    def _merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of all pieces at once: each round merges every piece's first pair of lowest rank."""
        n = len(starts)
        lengths, names, done = np.diff(np.append(starts, len(symbols))), np.arange(n), []
        ranks = np.full(len(symbols), NO_RANK)
        ranks[:-1] = self.pairs.ranks(symbols[:-1], symbols[1:])
        ranks[starts[1:] - 1] = NO_RANK
        while len(names):
            least = np.minimum.reduceat(ranks, starts)
            over = least == NO_RANK
            if over.any():
                gone = np.repeat(over, lengths)
                done.append((names[over], lengths[over], symbols[gone]))
                symbols, ranks = symbols[~gone], ranks[~gone]
                names, lengths, least = names[~over], lengths[~over], least[~over]
                starts = np.cumsum(lengths) - lengths
                if not len(names):
                    break
            piece = np.repeat(np.arange(len(names)), lengths)
            at = np.flatnonzero(ranks == least[piece])
            at = at[np.append(True, piece[at[1:]] != piece[at[:-1]])]
            symbols[at] = self.merged[least]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            final = at + 1 == starts + lengths - 1
            symbols, ranks = symbols[keep], ranks[keep]
            lengths = lengths - 1
            first = at == starts
            starts, at = starts - np.arange(len(starts)), at - np.arange(len(at))
            ranks[at[final]] = NO_RANK
            right, left = at[~final], at[~first]
            found = self.pairs.ranks(symbols[np.concatenate([right, left - 1])], symbols[np.concatenate([right + 1, left])])
            ranks[right], ranks[left - 1] = found[: len(right)], found[len(right) :]
        counts = np.zeros(n, np.int64)
        for name, length, _ in done:
            counts[name] = length
        begin, out = np.cumsum(counts) - counts, np.empty(counts.sum(), np.int32)
        for name, length, ids in done:
            out[np.repeat(begin[name] - (np.cumsum(length) - length), length) + np.arange(len(ids))] = ids
        return out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of each text's ids (one more than texts). Null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = pc.match_substring(texts, SPECIAL)
        if pc.any(special).as_py():
            parts = [self._whole(t.as_py()) if s.as_py() else self.encode(pa.array([t.as_py()]))[0] for t, s in zip(texts, special)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = lists.flatten().dictionary_encode()
        table, lengths = self.words(flat.dictionary.to_pylist())
        begins = np.cumsum(lengths) - lengths
        codes = flat.indices.to_numpy(zero_copy_only=False)
        each = lengths[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(begins[codes] - ends[:-1], each) + np.arange(ends[-1]) if len(codes) else np.zeros(0, np.int64)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return table[at], ends[bounds]


def encoder(path: str) -> WordEncoder:
    """One encoder for a worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def give_back() -> None:
    """Return freed memory to the system: Spark uses a Python worker again, with what its last task has left unused."""
    pa.default_memory_pool().release_unused()
    if os.name == "posix" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()
