"""Numeric kernels with wrap-around 64-bit arithmetic, as Arrow UDFs over numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1
# Fixed values of the hash families and the encoder.
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
DIMENSION = 256
STOP_WORDS = frozenset("and are but for from have not only that the then this was were what when where with you your".split())
WORD_WIDTH, PREFIX_WIDTH, PAIR_WIDTH = (16, 1.0), (6, 0.45), (8, 0.65)


def mix(x: int) -> int:
    x = (x ^ (x >> 30)) * MIX_A & MASK
    x = (x ^ (x >> 27)) * MIX_B & MASK
    return x ^ (x >> 31)


def fnv(data: bytes, h: int = FNV_START) -> int:
    for b in data:
        h = (h ^ b) * FNV_PRIME & MASK
    return h


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def feature_places(feature: int, width: int) -> list[tuple[int, bool]]:
    """(dimension, positive) of a feature: a chain of mixes."""
    out, state = [], mix(feature)
    for i in range(width):
        state = mix((state + i + GOLDEN) & MASK)
        out.append((state & (DIMENSION - 1), bool(state & 0x100)))
    return out


def holo_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and underscores, lower-cased, in pieces of at most 47 bytes: a
    longer run ends there and the byte that would follow is lost."""
    return re.findall(rb"([a-z0-9_]{1,47})[a-z0-9_]?", text.lower())


def holo_vector(text: str) -> np.ndarray:
    """Hypervector of a text: signed places of words, of their prefixes of 4 to 6 bytes and of
    neighbouring words, scaled to length 1."""
    v, last = np.zeros(DIMENSION, np.float32), None

    def add(feature, kind):
        for at, up in feature_places(feature, kind[0]):
            v[at] += np.float32(kind[1] if up else -kind[1])

    for w in holo_words(text.encode("utf-8", "surrogatepass")):
        if len(w) < 3 or w.decode() in STOP_WORDS:
            continue
        h = fnv(w)
        add(h, WORD_WIDTH)
        for n in (4, 5, 6):
            if n < len(w):
                add(fnv(w[:n]), PREFIX_WIDTH)
        if last is not None:
            add(mix(last ^ (h << 1 & MASK)), PAIR_WIDTH)
        last = h
    length = np.sqrt(np.dot(v, v), dtype=np.float32)
    return v / length if length > 0 else v


def _mixed(v: np.ndarray) -> np.ndarray:
    """The finaliser of unsigned longs."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(MIX_A)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(MIX_B)
    return v ^ (v >> np.uint64(31))


def _signed_places(features: np.ndarray, kind: tuple[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`feature_places` of many features: places and signed weights, a row for each."""
    state, places, weights = _mixed(features), np.empty((len(features), kind[0]), np.int32), np.empty((len(features), kind[0]), np.float32)
    for i in range(kind[0]):
        state = _mixed(state + np.uint64((i + GOLDEN) & MASK))
        places[:, i] = state & np.uint64(DIMENSION - 1)
        weights[:, i] = np.where(state & np.uint64(0x100), np.float32(kind[1]), np.float32(-kind[1]))
    return places, weights


#: Columns of a word's features: its own, those of three prefixes, and those with the word before it.
_OWN, _PREFIXES = WORD_WIDTH[0], 3 * PREFIX_WIDTH[0]
_ALL = _OWN + _PREFIXES + PAIR_WIDTH[0]
#: Words whose features a task keeps, about, words that are summed and characters that are read at once.
KEPT_WORDS, WORDS_AT_ONCE, TEXT_AT_ONCE = 1 << 18, 1 << 12, 1 << 20


class HoloEncoder:
    """:func:`holo_vector` of many texts. The features of a word are made once; those of all words
    of some texts are added in the order of the texts, so every sum is that of a text by itself."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        """Word 0 stands for words without features."""
        self.ids: dict[bytes, int] = {w.encode(): 0 for w in STOP_WORDS}
        self.hashes, self.places, self.weights = np.zeros(1, np.uint64), np.zeros((1, _OWN + _PREFIXES), np.int32), np.zeros((1, _OWN + _PREFIXES), np.float32)
        self.known = 1

    def learn(self, words: list[bytes]) -> None:
        """Features of words that are not known yet."""
        n = self.known + len(words)
        while len(self.hashes) < n:
            self.hashes, self.places, self.weights = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.places, self.weights))
        here = slice(self.known, n)
        hashes = self.hashes[here] = np.array([fnv(w) for w in words], np.uint64)
        places, weights = self.places[here], self.weights[here]
        weights[:] = 0
        places[:, :_OWN], weights[:, :_OWN] = _signed_places(hashes, WORD_WIDTH)
        for j, size in enumerate((4, 5, 6)):
            at = np.array([i for i, w in enumerate(words) if size < len(w)], np.int64)
            lo = _OWN + j * PREFIX_WIDTH[0]
            places[at, lo : lo + PREFIX_WIDTH[0]], weights[at, lo : lo + PREFIX_WIDTH[0]] = _signed_places(np.array([fnv(words[i][:size]) for i in at], np.uint64), PREFIX_WIDTH)
        self.ids.update(zip(words, range(self.known, n)))
        self.known = n

    def add(self, sums: np.ndarray, row: np.ndarray, ids: np.ndarray, before: np.ndarray) -> None:
        """Add the features of words to the rows of ``sums``; ``before`` is the word before, or 0."""
        h = self.hashes[ids]
        places, weights = np.empty((len(ids), _ALL), np.int32), np.empty((len(ids), _ALL), np.float32)
        places[:, : -PAIR_WIDTH[0]], weights[:, : -PAIR_WIDTH[0]] = self.places[ids], self.weights[ids]
        places[:, -PAIR_WIDTH[0] :], weights[:, -PAIR_WIDTH[0] :] = _signed_places(_mixed(self.hashes[before] ^ (h << np.uint64(1))), PAIR_WIDTH)
        weights[before == 0, -PAIR_WIDTH[0] :] = 0
        np.add.at(sums.reshape(-1), (row[:, None] * DIMENSION + places).ravel(), weights.ravel())

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text."""
        sums, lo = np.zeros((len(texts), DIMENSION), np.float32), 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < TEXT_AT_ONCE:
                size += len(texts[hi] or "")
                hi += 1
            self.encode_some(texts[lo:hi], sums[lo:hi])
            lo = hi
        for v in sums:
            length = np.sqrt(np.dot(v, v), dtype=np.float32)
            if length > 0:
                v /= length
        return sums

    def encode_some(self, texts: list[str | None], sums: np.ndarray) -> None:
        """Add the features of some texts to their rows."""
        found = [[w for w in holo_words(t.encode("utf-8", "surrogatepass")) if len(w) > 2] if t else [] for t in texts]
        words = set().union(*found)
        if new := words - self.ids.keys():
            if len(self.ids) + len(new) > KEPT_WORDS:
                self.forget()
                new = words - self.ids.keys()
            self.learn(list(new))
        row = np.repeat(np.arange(len(texts)), [len(w) for w in found])
        ids = np.fromiter((self.ids[w] for t in found for w in t), np.int64, len(row))
        row, ids = row[ids > 0], ids[ids > 0]
        before = np.where(np.diff(row, prepend=-1) == 0, np.r_[0, ids[:-1]][: len(ids)], 0)
        for lo in range(0, len(ids), WORDS_AT_ONCE):
            some = slice(lo, lo + WORDS_AT_ONCE)
            self.add(sums, row[some], ids[some], before[some])


@F.arrow_udf(T.ArrayType(T.FloatType()))
def holo_encode(x: Iterator[pa.Array]) -> Iterator[pa.Array]:
    encoder = HoloEncoder()
    for some in x:
        texts = some.to_pylist()
        ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * DIMENSION)
        yield pa.ListArray.from_arrays(ends, pa.array(encoder.encode(texts).ravel()), mask=pa.array([t is None for t in texts], pa.bool_()))


@F.arrow_udf(T.LongType())
def sign_vector(x: pa.Array) -> pa.Array:
    """FNV-1a over the native float bytes of a vector, as a signed long."""
    return pa.array([None if v is None else _signed(fnv(np.asarray(v, np.float32).tobytes())) for v in x.to_pylist()], pa.int64())


@F.arrow_udf(T.LongType())
def fnv1a(x: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _signed(fnv(t.encode())) for t in x.to_pylist()], pa.int64())


@F.arrow_udf(T.LongType())
def mix64(x: pa.Array) -> pa.Array:
    return pa.array(_mixed(x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).view(np.int64))


@F.arrow_udf(T.LongType())
def xorshift64(x: pa.Array) -> pa.Array:
    """One step of the 13, 7, 17 xorshift generator."""
    v = x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    v = v ^ (v << np.uint64(13))
    v = v ^ (v >> np.uint64(7))
    return pa.array((v ^ (v << np.uint64(17))).view(np.int64))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def feature_signs(x: pa.Array, width: pa.Array) -> pa.Array:
    """Places of features (see :func:`feature_places`), counted from 1 and negative where the sign is."""
    n = width[0].as_py() if len(width) else 0
    state, out = _mixed(x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), np.zeros((len(x), n), np.int32)
    for i in range(n):
        state = _mixed(state + np.uint64(i) + np.uint64(GOLDEN))
        place = (state & np.uint64(DIMENSION - 1)).astype(np.int32) + 1
        out[:, i] = np.where(state & np.uint64(0x100), place, -place)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(out.ravel()))
