"""Byte-pair merges over token streams: learning, encoding, decoding, and the byte alphabet.

A file is the stream of its texts, each closed by a line feed. Every adjacent pair of the stream
counts; pairs with a line feed are never merged, so a stream may be cut at its line feeds and
texts are encoded where they lie. Merges are applied to a batch of texts at once, as arrays.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

BASE, FEED = 128, 10
#: Merges after which the encoded texts are written, so that a round applies at most as many.
SAVE_EVERY = 8
#: Bytes of a stream that are counted at once, and characters after which a task starts another.
AT_ONCE, STREAM = 1 << 18, 1 << 22
#: Streams, places in each and ids at a place from which merges are guessed; files counted at once.
GUESS_FROM, FILES = (64, 16, 2048), 64


def merged(ids: np.ndarray, left: int, right: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with the pair replaced, greedily from the left, and which of the old places stay."""
    hit = np.zeros(len(ids), bool)
    hit[:-1] = (ids[:-1] == left) & (ids[1:] == right)
    if left == right and hit.any():  # in a run of hits every other one counts
        at = np.flatnonzero(hit)
        first = np.r_[True, np.diff(at) > 1]
        start = at[first][np.cumsum(first) - 1]
        hit[at[(at - start) % 2 == 1]] = False
    stay = np.ones(len(ids), bool)
    stay[1:] = ~hit[:-1]
    out = ids.copy()
    out[hit] = new
    return out[stay], stay


def _width(merges: int) -> int:
    """Bytes of an id: one as long as all ids of so many merges fit."""
    return 1 if BASE + merges <= 256 else 4


def _stream(texts, width: int) -> bytes:
    """Ids of texts, each closed by a line feed; characters beyond ASCII are question marks."""
    raw = "".join(f"{t or ''}\n" for t in texts).encode("ascii", "replace")
    return raw if width == 1 else np.frombuffer(raw, np.uint8).astype(np.int32).tobytes()


def _replaced(stream: bytes, left: int, right: int, new: int) -> bytes:
    """A stream of bytes with the pair replaced, greedily from the left."""
    if left == right:  # a search takes hits from the left and lets none overlap
        return stream.replace(bytes((left, right)), bytes((new,)))
    out, lo = [], 0
    while lo < len(stream):  # in pieces that stay in a core's cache and end where no pair is merged
        hi = stream.find(FEED, lo + AT_ONCE) + 1 or len(stream)
        ids = np.frombuffer(stream, np.uint8, hi - lo, lo)
        at = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right))
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        ids = ids[stay]
        ids[at - np.arange(len(at))] = new
        out.append(ids.tobytes())
        lo = hi
    return b"".join(out)


def _apply(stream: bytes, merges, first: int, width: int) -> bytes:
    """A stream after merges numbered from ``first``, as :func:`merged` replaces each pair."""
    if width == 1:
        for i, (a, b) in enumerate(merges):
            stream = _replaced(stream, a, b, BASE + first + i)
        return stream
    ids = np.frombuffer(stream, np.int32)
    for i, (a, b) in enumerate(merges):
        ids = merged(ids, a, b, BASE + first + i)[0]
    return ids.tobytes()


def _pairs(stream: bytes, size: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Adjacent pairs within texts (left, right, how many) and the length of a stream."""
    if width == 1:  # two bytes are one little-endian number, from even places and from odd ones
        n = np.zeros(1 << 16, np.int64)
        for lo in range(0, len(stream) - 1, AT_ONCE):
            part = stream[lo : lo + AT_ONCE + 1]
            for at in (0, 1):
                n += np.bincount(np.frombuffer(part, "<u2", (len(part) - at) // 2, at), minlength=1 << 16)
        n = n.reshape(256, 256).T
    else:
        ids = np.frombuffer(stream, np.int32)
        n = np.bincount(ids[:-1].astype(np.int64) * size + ids[1:], minlength=size * size).reshape(size, size)
    n = n.copy()
    n[FEED], n[:, FEED] = 0, 0
    left, right = np.nonzero(n)
    return left, right, n[left, right], len(stream) // width


_STATE = "file string, ids binary"
_COUNTS = "file string, stage int, a int, b int, n long, length long"


def _start(width: int, reduce=None):
    """Texts to streams, one for each file of a batch, each text after ``reduce``."""

    def run(batches):
        def made(files, streams):
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array([_stream(t, width) for t in streams], pa.binary())], ["file", "ids"])

        for b in batches:
            of: dict[str | None, list] = {}
            size: dict[str | None, int] = {}
            for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of.setdefault(f, []).append(reduce(t) if reduce else t)
                size[f] = size.get(f, 0) + len(t or "")
                if size[f] > STREAM:
                    yield made([f], [of.pop(f)])
                    del size[f]
            yield made(list(of), of.values())

    return run


def _encoded(merges, first: int, width: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_apply(x.as_py(), merges, first, width) for x in b.column(1)], pa.binary())], ["file", "ids"])

    return run


def _counted(merges, first: int, width: int, guess=()):
    """Pair counts and lengths of a task's streams by file: a row per pair of the alphabet so far.
    Stage 0 counts after ``merges``, stage i after i guessed ones more, as differences from the
    stage before."""
    size = BASE + first + len(merges) + len(guess)

    def rows(f, n, length):
        for stage in range(len(n)):
            more = n[stage] - n[stage - 1] if stage else n[0]
            at = np.flatnonzero(more)
            columns = [f] * (len(at) + 1), [stage] * (len(at) + 1), np.append(at // size, 0), np.append(at % size, 0), np.append(more[at], 0), np.append(np.zeros_like(at), length[stage] - (length[stage - 1] if stage else 0))
            whole = np.arange(len(at) + 1) == len(at)  # the last row is of no pair
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t, mask=whole if i in (2, 3) else None) for i, (c, t) in enumerate(zip(columns, kinds))], ["file", "stage", "a", "b", "n", "length"])

    def run(batches):
        found: dict[str | None, tuple] = {}
        for b in batches:
            for f, x in zip(b.column(0).to_pylist(), b.column(1)):
                if f not in found and len(found) == FILES:
                    for k in list(found):
                        yield from rows(k, *found.pop(k))
                n, length = found.setdefault(f, (np.zeros((len(guess) + 1, size * size), np.int64), np.zeros(len(guess) + 1, np.int64)))
                stream = _apply(x.as_py(), merges, first, width)
                for stage in range(len(guess) + 1):
                    if stage:
                        stream = _apply(stream, guess[stage - 1 : stage], first + len(merges) + stage - 1, width)
                    left, right, some, ids = _pairs(stream, size, width)
                    n[stage][left * size + right] += some
                    length[stage] += ids
        for k, held in found.items():
            yield from rows(k, *held)

    return run


def _guess(state: DataFrame, merges, first: int, width: int, more: int) -> list[tuple[int, int]]:
    """Merges that probably follow ``merges``, learnt from places of a few streams. They only save
    passes: each is held against the counts of all texts before it is taken."""
    streams, places, ids = GUESS_FROM
    feed = F.lit(_stream([""], width))
    at = [(F.floor(F.octet_length("ids") / width * i / places) * width + 1).cast("int") for i in range(places)]
    cut = F.concat(*(c for p in at for c in (F.substr("ids", p, F.lit(ids * width)), feed)))
    cut = F.when(F.octet_length("ids") > places * ids * width, cut).otherwise(F.col("ids"))
    of: dict[str | None, bytes] = {}
    for f, x in state.select("file", cut).limit(streams).collect():
        of[f] = of.get(f, b"") + bytes(x)
    of = {f: _apply(x, merges, first, width) for f, x in of.items()}
    out: list[tuple[int, int]] = []
    while len(out) < more:
        score, total = Counter(), Counter()
        for x in of.values():
            left, right, n, length = _pairs(x, BASE + first + len(merges) + len(out), width)
            pairs = list(zip(left.tolist(), right.tolist()))
            score.update(dict(zip(pairs, (n / max(1, length - 1)).tolist())))
            total.update(dict(zip(pairs, n.tolist())))
        if not score:
            break
        out.append(max(score, key=lambda p: (round(score[p], 12), total[p], -p[0], -p[1])))
        of = {f: _apply(x, out[-1:], first + len(merges) + len(out) - 1, width) for f, x in of.items()}
    return out


def pair_scores(counts: DataFrame, least: int = 2) -> DataFrame:
    """(stage, a, b, score, total): a pair scores the sum over files of its count by the file's pairs."""
    per = counts.groupBy("file", "stage", "a", "b").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    # over the pairs of an alphabet; a join with the rows of lengths would go through the texts twice
    per = per.withColumn("__len", F.sum("length").over(Window.partitionBy("file", "stage"))).filter("a is not null")
    out = per.groupBy("stage", "a", "b").agg(F.round(F.sum(F.col("n") / (F.col("__len") - 1)), 12).alias("score"), F.sum("n").alias("total"))
    return out.filter(F.col("total") >= least)


def _stages(counts: DataFrame, last: int) -> DataFrame:
    """Counts of every stage from the differences: a row counts for its stage and all that follow."""
    some = counts.groupBy("file", "stage", "a", "b").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    return some.withColumn("stage", F.explode(F.sequence("stage", F.lit(last))))


def first_scores(docs: DataFrame, file: str, text: str) -> DataFrame:
    """Scores of all pairs of bytes, before any merge."""
    state = docs.select(F.col(file).cast("string").alias("file"), text).mapInArrow(_start(1), _STATE)
    return pair_scores(state.mapInArrow(_counted([], 0, 1), _COUNTS)).drop("stage")


def learn_merges(docs: DataFrame, file: str, text: str, merges: int, reduce=None) -> list[tuple[int, int]]:
    """Merges in order: the best score each time, ties to the higher total, then the smaller pair.

    A round is one pass over the encoded texts and an aggregation of a row per pair; texts are
    never shuffled and the driver sees the winners alone. Texts lie in streams of ids, a byte each
    while the alphabet has at most 256, so merging and counting run over whole batches. A round
    counts all texts before and after each of the merges guessed to come next; those up to the
    first wrong guess are found at once, and that guess is replaced by what the counts say.
    ``reduce`` is applied to each text where streams are made, so no worker more is needed for it.
    """
    spark = docs.sparkSession
    width = _width(merges)

    def save(state):
        path = scratch_path(spark, "streams")
        state.write.parquet(path)
        return spark.read.schema(_STATE).parquet(path)

    state = save(docs.select(F.col(file).cast("string").alias("file"), text).mapInArrow(_start(width, reduce), _STATE))
    learnt: list[tuple[int, int]] = []
    saved = 0
    while len(learnt) < merges:
        done = learnt[saved:]
        guess = _guess(state, done, saved, width, min(SAVE_EVERY - len(done), merges - len(learnt)) - 1)
        counts = _stages(state.mapInArrow(_counted(done, saved, width, guess), _COUNTS), len(guess))
        best = F.max_by(F.struct("a", "b"), F.struct("score", "total", -F.col("a"), -F.col("b")))
        top = {r.stage: (r.top.a, r.top.b) for r in pair_scores(counts).groupBy("stage").agg(best.alias("top")).collect()}
        for stage in range(len(guess) + 1):
            if stage not in top:
                return learnt
            learnt.append(top[stage])
            if guess[stage : stage + 1] != [top[stage]]:
                break
        if len(learnt) - saved == SAVE_EVERY and len(learnt) < merges:
            state, saved = save(state.mapInArrow(_encoded(learnt[saved:], saved, width), _STATE)), len(learnt)
    return learnt


def expand(merges: list[tuple[int, int]]) -> list[str]:
    """Text of each id."""
    out = [chr(i) for i in range(BASE)]
    for a, b in merges:
        out.append(out[a] + out[b])
    return out


def encode(text: Column, merges: list[tuple[int, int]]) -> Column:
    """Ids of a text, merges in the order learnt; characters beyond ASCII are ``?``."""
    width = _width(len(merges))
    kind = np.uint8 if width == 1 else np.int32

    def run(x: pa.Array) -> pa.Array:
        texts = x.to_pylist()
        # a text's own line feeds stay ids: each text is a stream of its own, without the closing one
        parts = [np.zeros(0, kind) if t is None else np.frombuffer(_apply(_stream([t], width), merges, 0, width), kind)[:-1] for t in texts]
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        ids = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=pa.array([t is None for t in texts], pa.bool_()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(text)


def decode(ids: Column, merges: list[tuple[int, int]]) -> Column:
    """Text of ids, by a table of pre-expanded pieces."""
    pieces = F.array(*(F.lit(p) for p in expand(merges)))
    return F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")


def merges_frame(spark, merges: list[tuple[int, int]]) -> DataFrame:
    text = expand(merges)
    return spark.createDataFrame([(i, a, b, text[BASE + i]) for i, (a, b) in enumerate(merges)], "rank int, left int, right int, piece string")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin characters for themselves, all
    others from code point 256 up, in order."""
    shown = [b for b in range(33, 256) if b not in range(127, 161) and b != 173]
    place = {b: chr(b) for b in shown}
    for b in range(256):
        place.setdefault(b, chr(256 + len(place) - len(shown)))
    return [place[b] for b in range(256)]


def to_alphabet(raw: Column) -> Column:
    """Bytes as characters of the alphabet. Latin-1 reads one character a byte, without Python."""
    shown = byte_alphabet()
    moved = [b for b in range(256) if shown[b] != chr(b)]
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, moved)), "".join(shown[b] for b in moved))


def from_alphabet(text: Column) -> Column:
    """Bytes of a text in the alphabet; null if a character is not of it."""
    shown = byte_alphabet()
    moved = [b for b in range(256) if shown[b] != chr(b)]
    # a byte that is written otherwise may not stand for itself
    legal = text.rlike("^[" + "".join(f"\\x{{{ord(c):x}}}" for c in shown) + "]*$")
    back = F.translate(text, "".join(shown[b] for b in moved if b), "".join(chr(b) for b in moved if b))
    return F.when(legal, F.encode(F.replace(back, F.lit(shown[0]), F.lit("\0")), "ISO-8859-1"))  # translate takes NUL as "drop"
