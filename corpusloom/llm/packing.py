"""Mixture-controlled packing.

Every source is a queue of 64-token packets cut from the stream of its documents. Deficit
round-robin serves the queues: each round (one window's worth of tokens) credits a queue
with its share of the window, whole packets are served while the credit lasts, and what is
left of the credit is carried into the next round. The served packets, end to end, are cut
into windows.

Serving is a closed form: after ``t`` rounds with all queues at work, one has served
``floor(t * window * weight / weights / packet)`` packets. So any task computes the place of any
packet from the per-source totals alone, deficits cross windows and partitions without a
sequential pass, and the only shuffle is the per-(task, source) sum.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small

#: Sums per (task, source) up to this many (about 20 MB) are broadcast; more are joined by shuffle.
SUM_ROWS = 500_000
#: Rounds by queues that a task looks at together.
CELLS = 2_000_000


#: Line feed and the visible ASCII characters.
_PLAIN = bytes([10, *range(32, 127)])


class TextEncoder:
    """Token ids of whole texts, as bytes of little-endian unsigned 32-bit or 16-bit ids.

    Equal to ``tokenizers`` with ``add_special_tokens=False``. A byte-level BPE file whose
    merges are in id order is also run by a rank-based encoder of the same vocabulary, which
    takes a sixth of the time and cuts plain texts alike (tests compare them); all other texts (odd
    white space, characters beyond Latin, special strings) go to the library.
    """

    _made: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(True) <= 65536 else "<u4")
        self.fast = self._ranks(path)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        #: Characters beyond those that both encoders are known to cut alike.
        self.odd_char = re.compile("[^\n -~¡-ɏ‐-‧‰-⁞]").search

    def odd(self, text: str) -> bool:
        """Whether a text has white space other than spaces and line feeds, an unusual character, or
        a special string."""
        if text.isascii():
            if text.encode("ascii").translate(None, _PLAIN):
                return True
        elif self.odd_char(text):
            return True
        return any(s in text for s in self.specials)

    @classmethod
    def of(cls, path: str) -> "TextEncoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _ranks(self, path):
        """The same vocabulary for the rank-based encoder, or None where the two could differ."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type", "BPE") != "BPE":
            return None
        added = {t["content"] for t in spec.get("added_tokens", [])}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = model["vocab"]
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            return None
        # fixed value: the byte-level pre-tokenisation pattern of the vocabulary's family
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.fast or self.odd(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()


def _tokenise(path: str, eos: int, schema: pa.Schema):
    def run(batches):
        enc = TextEncoder.of(path)
        tail, size = np.array([eos], enc.dtype).tobytes(), enc.dtype.itemsize
        part, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                ids = [enc.encode(t.as_py() or "") + tail for t in b.column(2)]
                starts, counts = [], []
                for s, x in zip(b.column(1).to_pylist(), ids):
                    n = len(x) // size
                    starts.append(sums.get(s, 0))
                    counts.append(n)
                    sums[s] = starts[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([part] * b.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], schema=schema
                )

    return run


def _muldiv(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """floor(a * b / c), exact though a * b may not fit 64 bits: a float quotient, right to one for
    quotients below 2**50, and its remainder modulo 2**64, which fits while c is below 2**60."""
    if b.dtype == object or c.dtype == object:
        return (a.astype(object) * b // c).astype(np.int64)
    q = np.floor(a.astype(float) * b / c).astype(np.int64)
    return q + (a * b - q * c) // c


def _ceil_ratio(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """ceil(a * b / c), exact like :func:`_muldiv`."""
    return -_muldiv(-np.asarray(a), b, c)


def exact_weights(weights: list) -> list[int]:
    """Whole numbers in the proportions of ``weights``; a float counts as the decimal it prints."""
    parts = [Fraction(str(w)) for w in weights]
    if any(p <= 0 for p in parts):
        raise ValueError("weights must be above 0")
    unit = math.lcm(*(p.denominator for p in parts))
    whole = [int(p * unit) for p in parts]
    return [w // math.gcd(*whole) for w in whole]


class Schedule:
    """Deficit round-robin over queues of known totals, as closed forms.

    Each round hands out one window of credit, to the queues that are not yet dry in proportion to
    their weights; where one runs dry within the round, the rest of the round's credit goes to the
    others. So a queue's credit is its weight times one common level ``V``, until it reaches its
    total: queues run dry in the order of total by weight, and between two such events (a phase)
    ``V = (rounds * window - tokens of dry queues) / weights of the others``. Sorting the events
    and two running sums are all that is kept. A queue has served whole packets of its credit, or
    all that it has once its credit is its total; what is left of the credit is carried on.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int, packet: int):
        self.window, self.packet, self.totals = window, packet, np.array(totals, np.int64)
        big = window * max(sum(weights), 1) >= 2**60 or sum(totals) >= 2**49
        self.kind = object if big else np.int64
        self.weights = np.array(weights, self.kind)
        order = sorted((s for s, t in enumerate(totals) if t), key=lambda s: (Fraction(totals[s], weights[s]), s))
        dry, left = 0, sum(weights[s] for s in order)
        gone, active, first, total, weight = [], [], [], [], []  # by phase, and of the queue that ends it
        for s in order:
            t, w = totals[s], weights[s]
            if not gone or t * weight[-1] != total[-1] * w:  # else they run dry together
                end = (dry * w + left * t, w * window)  # this phase's end in rounds, as a fraction
                gone.append(dry)
                active.append(left)
                first.append(-(-end[0] // end[1]))
                total.append(t)
                weight.append(w)
            dry += t
            left -= w
        self.gone, self.active = np.array(gone, self.kind), np.array(active, self.kind)
        self.over = np.array(first, np.int64)  # the first round by whose end the phase is over
        self.total, self.weight = np.array(total, self.kind), np.array(weight, self.kind)
        self.rounds = first[-1] if first else 0

    def after(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue has served when so many rounds are over: (rounds, queues)."""
        p = np.searchsorted(self.over, rounds, "right")
        done, p = p >= len(self.over), np.minimum(p, len(self.over) - 1)
        level = rounds.astype(self.kind) * self.window - self.gone[p]
        credit = _muldiv(np.maximum(level, 0)[:, None], self.weights, self.active[p][:, None])
        return np.where(done[:, None] | (credit >= self.totals), self.totals, credit // self.packet * self.packet)

    def round_of(self, queue: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Round (from 1) in which the packet that ends at ``end`` of its queue is served."""
        w, end = self.weights[queue], np.asarray(end)
        p, high = np.zeros(len(queue), np.int64), np.full(len(queue), max(0, len(self.over) - 1))
        while (p < high).any():  # the first phase whose end's level reaches end / w
            mid = (p + high) // 2
            short = self._below(self.total[mid], self.weight[mid], end, w)
            p, high = np.where(short, np.minimum(mid + 1, high), p), np.where(short, high, mid)
        need = _ceil_ratio(end, self.active[p], w)  # level * weights of the active queues, rounded up
        return np.maximum(1, -(-(self.gone[p] + need) // self.window)).astype(np.int64)

    def _below(self, t, wt, end, w) -> np.ndarray:
        """Whether t / wt < end / w, exactly."""
        if self.kind is object:
            return np.asarray(t * w < end.astype(object) * wt, bool)
        near = end.astype(float) * wt / w
        far = near > 2.0**50
        return np.where(far, True, _ceil_ratio(np.where(far, 0, end), wt, w) > t)

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray):
        """Cut stretches of queues into pieces that lie in one window each.

        Returns (index of the stretch, start in it, length, place in the output).
        """
        k0, k1 = start // self.packet, (start + length - 1) // self.packet
        n = k1 - k0 + 1
        doc = np.repeat(np.arange(len(queue)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + k0[doc]
        q, lo = queue[doc], np.maximum(k * self.packet, start[doc])
        hi = np.minimum((k + 1) * self.packet, (start + length)[doc])
        r = self.round_of(q, np.minimum((k + 1) * self.packet, self.totals[q]))
        ru, inv = np.unique(r, return_inverse=True)
        place, step = np.zeros(len(q), np.int64), max(1, CELLS // len(self.totals))
        by_round = np.argsort(inv, kind="stable")
        bounds = np.searchsorted(inv[by_round], np.arange(0, len(ru) + step, step))
        for c, (a, b) in enumerate(zip(bounds, bounds[1:])):  # so many rounds at once that rounds by queues stay small
            at = by_round[a:b]
            rounds, i = ru[c * step : (c + 1) * step], inv[at] - c * step
            before, done = self.after(rounds - 1), self.after(rounds)
            ahead = before.sum(1)[:, None] + np.cumsum(done - before, axis=1) - (done - before)
            place[at] = ahead[i, q[at]] + lo[at] - before[i, q[at]]
        # cut at window bounds, then join what is contiguous in both the text and the window
        w0, w1 = place // self.window, (place + hi - lo - 1) // self.window
        m = w1 - w0 + 1
        i = np.repeat(np.arange(len(doc)), m)
        w = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + w0[i]
        a = np.maximum(place[i], w * self.window)
        b = np.minimum((place + hi - lo)[i], (w + 1) * self.window)
        doc, s, n = doc[i], (lo[i] - start[doc[i]]) + (a - place[i]), b - a
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (a[1:] != a[:-1] + n[:-1]) | (s[1:] != s[:-1] + n[:-1]) | (a[1:] // self.window != a[:-1] // self.window)
        at = np.flatnonzero(new)
        return doc[at], s[at], np.add.reduceat(n, at) if len(at) else n, a[at]


def _emit(held, schema: pa.Schema, with_ids: bool):
    """Pieces by the schedule that ``held`` broadcasts."""

    def run(batches):
        schedule = held.value
        window = schedule.window
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                queue, start, count = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
                doc, s, n, place = schedule.pieces(queue, start, count)
                raw = [x.as_py() for x in b.column(4)]
                ids = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4") for x, n in zip(raw, count.tolist())]
                cut = [ids[d][x : x + y].tobytes() for d, x, y in zip(doc.tolist(), s.tolist(), n.tolist())]
                out = [b.column(0).take(pa.array(doc)), pa.array(s), pa.array(n), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(count[doc]), pa.array(place // window), pa.array(place % window), pa.array(queue[doc].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out + [pa.array(cut, pa.binary())] * with_ids, schema=schema)

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, doc_id="doc_id", text="text", source="source", window=1024, packet=64, eos_id=0, weights: dict | None = None, with_ids=True) -> DataFrame:
    """Pack every document into windows of ``window`` tokens at target token proportions.

    ``weights`` maps sources to target weights, and raises where a source has none; None takes each
    source's share of all tokens, so that all queues end together. Every id of every document lies in exactly one
    piece; all windows are full but the last.

    Returns one row per piece: doc_id, start (its document's ids before it), length,
    ids_crc32, doc_tokens (ids of the document with the closing id), sequence_id, offset
    (place in the sequence), source_rank, and ids (little-endian unsigned 32-bit) if
    ``with_ids``.

    Null or empty texts are the closing id alone; very long texts run over as many windows as they
    need; a null source is a queue of its own (the
    last); repeated rows are separate documents; other columns are ignored; no rows give no
    pieces. The driver holds one row per source, nothing per document.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType
    fields = T.StructType([T.StructField("doc_id", kind), T.StructField("source", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    tokens = materialize(src.mapInArrow(_tokenise(tokenizer_path, eos_id, to_arrow_schema(fields)), fields), "tokens")
    sums = tokens.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n"))
    base = materialize(sums.withColumn("base", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")), "token-sums")
    per_source = base.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    names, totals = [r.source for r in per_source], [r.n for r in per_source]
    out = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("source_rank", T.IntegerType())] + [T.StructField("ids", T.BinaryType())] * with_ids)
    if not names:
        return spark.createDataFrame([], out)
    if weights is not None and (without := [n for n in names if n not in weights]):
        raise ValueError(f"{len(without)} sources have no weight, as {without[:5]}")
    schedule = Schedule(totals, totals if weights is None else exact_weights([weights[n] for n in names]), window, packet)
    held = spark.sparkContext.broadcast(schedule)  # a few numbers for each source
    ranks = spark.createDataFrame(list(zip(names, range(len(names)))), "source string, rank int")
    n_base = base.count()
    base = base.join(small(ranks, len(names), SUM_ROWS), base["source"].eqNullSafe(ranks["source"])).select(base["source"], "part", "base", "rank")
    placed = tokens.join(small(base, n_base, SUM_ROWS), tokens["source"].eqNullSafe(base["source"]) & (tokens["part"] == base["part"])).select("doc_id", "rank", (F.col("base") + F.col("local")).alias("at"), "doc_tokens", "ids")
    return placed.mapInArrow(_emit(held, to_arrow_schema(out), with_ids), out)
