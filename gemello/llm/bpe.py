"""Byte-level BPE by batched NumPy merge rounds.

A piece of a batch is cut into words by the classes of its code points. The words that aren't known yet lie in one flat
array of symbols. In each round the rank of every pair of neighbours is looked up by binary search over the sorted keys
of all merges, each word merges its lowest-ranked pair wherever that stands, and the array is packed again, until no
word has a pair with a rank. The ids of known words come from a cache of bounded size, by the word's bytes; within a
piece, equal words are found by hash and compared byte by byte. Ids, their decimal text and the decoded bytes are
gathered from flat tables.

Defined results: null and empty texts have no tokens and decode to the empty text; texts of any length are encoded whole;
equal texts have equal tokens; special tokens of the vocabulary file are matched in the text as its library does by
default; an empty table gives an empty table; other columns pass unchanged, one named as an output is replaced.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gemello.llm.text import appended, flat, hashes

CACHE_WORDS = 100_000
CACHE_IDS = 1 << 19
CACHE_BYTES = 64  # longer words aren't kept
NONE = np.iinfo(np.int64).max
#: Classes of code points.
WHITE, LETTER, NUMBER, OTHER = range(4)
#: Endings that stand alone after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    points = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "." for i in range(0x110000))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, points):
            table[m.start() : m.end()] = kind
    return table


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all words of UTF-8 texts, and the range of each text's words.

    A word is a run of letters, numbers or other marks with the one blank before it; of white space before such a run,
    the last character stands apart; an ending after an apostrophe that begins a word is a word.
    """
    n = len(data)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    edge = np.zeros(len(points) + 1, bool)
    edge[np.searchsorted(at, offsets)] = True
    edge[-1] = True
    kind = classes()[points]
    white = kind == WHITE
    begins = edge[:-1].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    last_white = white.copy()
    last_white[:-1] &= ~white[1:] & ~edge[1:-1]
    if n:
        last_white[-1] = False
    joined = np.zeros(len(points), bool)
    joined[1:] = (points[:-1] == 0x20) & ~edge[1:-1]
    start = np.where(white, begins | last_white, begins & ~joined)
    marks = np.flatnonzero((points == 0x27) & start)
    for ending in ENDINGS:
        k = len(ending)
        own = marks[marks + k < len(points)]
        for i, c in enumerate(ending):
            own = own[(points[own + 1 + i] == ord(c)) & ~edge[own + 1 + i]]
        start[own + 1] = False
        after = own[own + 1 + k < len(points)] + 1 + k
        start[after] = True
    firsts = at[start]
    return firsts, np.searchsorted(firsts, offsets)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of a vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array([vocab["".join(p)] for p in pairs], np.int64)
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.token_ends = np.cumsum([len(x) for x in raw]).astype(np.int64)
        self.token_starts = self.token_ends - np.array([len(x) for x in raw], np.int64)
        decimal = [f"{i},".encode() for i in range(size)]
        self.decimal = np.frombuffer(b"".join(decimal), np.uint8)
        self.decimal_ends = np.cumsum([len(x) for x in decimal]).astype(np.int64)
        self.decimal_starts = self.decimal_ends - np.array([len(x) for x in decimal], np.int64)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.special_bytes = [s.encode() for s in self.special]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.store = np.zeros(1 << 16, np.int64)
        self.stored = 0
        self.begin = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that lie one after another, in one array, and the number of each word's ids."""
        symbols = self.first[data]
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_ids, done_word = [], []
        while len(symbols):
            same = word[1:] == word[:-1]
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == keys), self.ranks[at], NONE)
            rank = np.append(rank, NONE)
            begins = np.flatnonzero(np.append(True, ~same))
            lowest = np.minimum.reduceat(rank, begins)
            counts = np.diff(np.append(begins, len(symbols)))
            least = np.repeat(lowest, counts)
            over = least == NONE
            hit = (rank == least) & ~over
            # in a run of overlapping hits (a a a) every second one merges, from the left
            after = np.append(False, hit[:-1])
            begin = np.flatnonzero(hit & ~after)
            position = np.arange(len(hit))
            run = np.zeros(len(hit), np.int64)
            run[begin] = begin
            run = np.maximum.accumulate(run)
            hit &= ((position - run) & 1) == 0
            symbols = np.where(hit, self.merged[np.where(hit, rank, 0)], symbols)
            keep = ~np.append(False, hit[:-1])
            done = over & keep
            if done.any():
                done_ids.append(symbols[done])
                done_word.append(word[done])
            keep &= ~over
            symbols, word = symbols[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        ids, own = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(own, kind="stable")
        return ids[order], np.bincount(own, minlength=len(lengths))

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The places in the store of different words; new words are merged and stored."""
        if self.held + len(starts) > CACHE_WORDS or self.stored > CACHE_IDS:
            self.forget()
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        place = np.fromiter((self.known.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            lengths = ends[new] - starts[new]
            ids, counts = self.merge(data[ranges(starts[new], lengths)], lengths)
            have = self.held
            place[new] = np.arange(have, have + len(new))
            self.store = _room(self.store, self.stored + len(ids))
            self.begin, self.count = _room(self.begin, have + len(new)), _room(self.count, have + len(new))
            self.store[self.stored : self.stored + len(ids)] = ids
            self.begin[have : have + len(new)] = self.stored + np.cumsum(counts) - counts
            self.count[have : have + len(new)] = counts
            self.stored += len(ids)
            self.held += len(new)
            self.known.update((k, p) for i, p in zip(new.tolist(), place[new].tolist(), strict=True) if len(k := keys[i]) <= CACHE_BYTES)
        return place

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array and each text's offsets in it; special tokens count as text."""
        firsts, words = cut(data, offsets)
        if not len(firsts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        ends = np.append(firsts[1:], len(data))
        first, inverse = different(data, firsts, ends)
        place = self.learn(data, firsts[first], ends[first])[inverse]
        counts = self.count[place]
        ids = self.store[ranges(self.begin[place], counts)]
        return ids, np.append(0, np.cumsum(counts))[words]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a string column in one array, and each text's offsets in it."""
        data, offsets = flat(col)
        raw = data.tobytes()
        if not any(s in raw for s in self.special_bytes):
            return self.encode_flat(data, offsets)
        parts, owner = [], []
        for i, text in enumerate(col.to_pylist()):
            for part in self.split(text or ""):
                parts.append(part)
                owner.append(i)
        plain, at = self.encode_flat(*flat(pa.array(["" if p in self.special else p for p in parts], pa.string())))
        ids, sizes = [], np.zeros(len(col), np.int64)
        for k, (part, i) in enumerate(zip(parts, owner, strict=True)):
            own = np.array([self.special[part]], np.int64) if part in self.special else plain[at[k] : at[k + 1]]
            ids.append(own)
            sizes[i] += len(own)
        return np.concatenate(ids), np.append(0, np.cumsum(sizes))

    def bytes_of(self, ids: np.ndarray, at: np.ndarray) -> tuple[memoryview, list[int]]:
        """The bytes of all ids, and where those of each text begin."""
        sizes = self.token_ends[ids] - self.token_starts[ids]
        return memoryview(self.token_bytes[ranges(self.token_starts[ids], sizes)]), np.append(0, np.cumsum(sizes))[at].tolist()

    def decimals(self, ids: np.ndarray, at: np.ndarray) -> tuple[memoryview, list[int]]:
        """All ids in decimal, each followed by a comma, and where those of each text begin."""
        sizes = self.decimal_ends[ids] - self.decimal_starts[ids]
        return memoryview(self.decimal[ranges(self.decimal_starts[ids], sizes)]), np.append(0, np.cumsum(sizes))[at].tolist()

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The text of each range of ids; bytes that aren't UTF-8 become U+FFFD."""
        raw, cuts = self.bytes_of(ids, at)
        return [bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def different(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each different word, and for each word the index of its equal among these; words lie one after another."""
    _, first, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    same = first[inverse]
    size = ends - starts
    if np.array_equal(size, size[same]) and np.array_equal(data[starts[0] : ends[-1]], data[ranges(starts[same], size)]):
        return first, inverse
    raw = data.tobytes()  # two words share a hash: tell all apart by their bytes
    known: dict[bytes, int] = {}
    inverse = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.unique(inverse, return_index=True)[1], inverse


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


@cache
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encoded(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with `ids` (array<int>) and `decoded` (the text they decode to)."""

    def work(cols: list[pa.Array]) -> list:
        bpe = loaded(path)
        ids, at = bpe.encode(cols[0])
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), bpe.decode(ids, at)]

    return appended(df, [text], [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], work)


DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def digests(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df[keep] with the number of ids, the digest of the ids in decimal and the digest of the decoded text."""

    def work(cols: list[pa.Array]) -> list:
        bpe = loaded(path)
        ids, at = bpe.encode(cols[0])
        decimal, cuts = bpe.decimals(ids, at)
        shown = [hashlib.sha256(decimal[a : max(a, b - 1)]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [np.diff(at), shown, [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode(ids, at)]]

    return appended(df, [text], DIGEST, work, keep)
