"""Language identification with error-correcting output codes.

Each language gets a codeword. One binary classifier per bit, linear in character n-gram
counts, predicts whether the bit is set; its margin is the mean log-odds of the text's
n-grams. Decoding is loss-weighted: a codeword costs the sum, over bits, of the bit's weight
times a logistic loss of the margin taken with the codeword's sign; the cheapest codeword
wins, and a text whose two cheapest are close is flagged ambiguous.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize

#: Labelled texts that fit the model, per language, in expectation (the fit's documented bound).
SAMPLE_ROWS = 400
DIMS = 1 << 15
SPREAD = np.uint32(2654435761)
#: Places that are looked up at once; longer texts are summed block by block.
BLOCK = 1 << 15
LETTER = regex.compile(r"[^\W\d_]")
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower-cased words of a whole text in UTF-8, with a space around each."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" "


def features(norm: bytes):
    """Hashed n-grams of 1 to 4 bytes, as arrays of places below DIMS, one array per block."""
    raw = np.frombuffer(norm, np.uint8)
    for lo in range(0, len(raw), BLOCK):
        a = raw[lo : lo + BLOCK + 3].astype(np.uint32)
        m = min(BLOCK, len(raw) - lo)
        value, out = np.zeros(len(a), np.uint32), []
        for n in range(1, 5):
            value = (value[: len(a) - n + 1] << np.uint32(8)) | a[n - 1 :]
            out.append(((value[:m] + np.uint32(n)) * SPREAD) >> np.uint32(17))
        yield np.concatenate(out)


def codebook(k: int, seed: int = 7) -> np.ndarray:
    """(k, bits) of -1 and 1: the exhaustive code up to 5 languages, else the best of some
    random codes by the distance of their closest rows."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        cols = [[1] + [1 if c >> i & 1 else -1 for i in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(cols).T
    bits, rng, best, far = 15 * math.ceil(math.log2(k)), random.Random(seed), None, -1
    for _ in range(200 if k <= 64 else 3):
        m = np.array([[rng.choice((-1, 1)) for _ in range(bits)] for _ in range(k)])
        m = m[:, np.abs(m.sum(axis=0)) < k]  # a bit that all share teaches nothing
        d = int(((m.shape[1] - m @ m.T) // 2 + 10**6 * np.eye(k, dtype=int)).min())
        if d > far:
            best, far = m, d
    return best


class Model:
    """Languages, their codewords, the bits' n-gram weights, offsets, scales and weights."""

    def __init__(self, langs, code, table, scale, bit_weight):
        self.langs, self.code, self.table, self.scale, self.bit_weight = langs, code, table, scale, bit_weight

    def margins(self, norm: bytes) -> np.ndarray:
        """Mean log-odds of the text's n-grams, per bit."""
        total, n = np.zeros(self.table.shape[1]), 0
        for f in features(norm):
            if len(f) < 512:
                total += self.table[f].sum(0, dtype=np.float64)
            else:
                total += np.bincount(f, minlength=DIMS).astype(np.float32) @ self.table
            n += len(f)
        return total / max(1, n)

    def predict(self, text: str | None):
        """(language, score, ambiguous, margins' signs as a bit string)."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, True, ""
        m = self.margins(normal(text)) * self.scale
        loss = (self.bit_weight * np.logaddexp(0, -self.code * m)).sum(1)
        p = np.exp(-(loss - loss.min()))
        p /= p.sum()
        order = np.argsort(loss, kind="stable")
        close = len(order) > 1 and p[order[1]] > 0.5 * p[order[0]]
        return self.langs[order[0]], float(p[order[0]]), bool(close), "".join("1" if x > 0 else "0" for x in m)


def in_fold(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("h", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def _count(batches):
    """Sparse n-gram counts of whole texts: at most DIMS places each, whatever the text."""
    schema = to_arrow_schema(_COUNTS)
    for batch in batches:
        for lang, text, h in zip(*(batch.column(i) for i in range(3))):
            text = text.as_py()
            if not LETTER.search(text):
                continue
            total = np.zeros(DIMS, np.int64)
            for f in features(normal(text)):
                total += np.bincount(f, minlength=DIMS)
            at = np.flatnonzero(total)
            row = (lang.as_py(), h.as_py(), at.astype("<u2").tobytes(), total[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)


def fit(labelled: DataFrame, *, text="text", lang="lang", rows=SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample: about ``rows`` different texts per language, at most twice that
    many, chosen by a hash of the text. So no id has a say, a null one neither, and a text that is
    repeated, however often, teaches as much as any other.

    Sampled texts are read whole. Their n-gram counts are summed on the executors; the driver gets
    one row of sums per language, and each sampled text's margins. Rows without text, letters or
    language teach nothing; without any that do, no language is known.
    """
    spark = labelled.sparkSession
    d = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang is not null and text is not null")
    d = d.withColumn("h", F.xxhash64("text", F.lit("langid")))
    counts = {r.lang: r.n for r in d.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], codebook(0), np.zeros((DIMS, 1), np.float32), np.ones(1), np.ones(1))
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, rows / max(1, counts[k])))))
    picked = d.filter(F.pmod("h", F.lit(1 << 40)) < share[F.col("lang")] * (1 << 40)).dropDuplicates(["lang", "h"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = picked.mapInArrow(_count, _COUNTS).withColumn("nth", first).filter(F.col("nth") <= 2 * rows).drop("nth")
    sample = materialize(sample, "langid-sample")
    n = np.zeros((len(langs), DIMS))
    for r in sample.groupBy("lang").applyInArrow(_sum, "lang string, total binary").collect():
        n[langs.index(r.lang)] = np.frombuffer(r.total)
    code = codebook(len(langs))
    p = (n + 0.02 * n.mean() + 1e-9) / (n.sum(1, keepdims=True) + (0.02 * n.mean() + 1e-9) * DIMS)
    bits = code.shape[1]
    table = np.zeros((DIMS, bits), np.float32)
    for b in range(bits):
        on, off = code[:, b] > 0, code[:, b] < 0
        if on.any() and off.any():
            table[:, b] = np.log(p[on].mean(0)) - np.log(p[off].mean(0))
    scale, weight = np.ones(bits), np.ones(bits)
    held = spark.sparkContext.broadcast(table)
    if texts := sample.mapInArrow(_margins(held), "lang string, margins binary").collect():
        m = np.array([np.frombuffer(r.margins) for r in texts])
        signed = m * code[[langs.index(r.lang) for r in texts]]
        scale = 4 / np.maximum(np.median(np.abs(m), axis=0), 1e-6)
        weight = np.maximum(0.05, 2 * (signed > 0).mean(0) - 1)  # a bit counts as it is reliable
    return Model(langs, code, table, scale, weight / weight.sum() * min(bits, 8))


def _sparse(places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(places, "<u2").astype(np.intp), np.frombuffer(counts, "<u4").astype(float)


def _sum(key, t):
    """A language's n-gram shares, summed over its sampled texts."""
    total = np.zeros(DIMS)
    for r in t.sort_by("h").select(["places", "counts"]).to_pylist():
        at, f = _sparse(r["places"], r["counts"])
        total[at] += f / f.sum()
    return pa.table({"lang": [key[0].as_py()], "total": pa.array([total.tobytes()], pa.binary())})


def _margins(held):
    def run(batches):
        for b in batches:
            out = []
            for places, counts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                at, f = _sparse(places, counts)
                out.append(((f @ held.value[at]) / f.sum()).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["lang", "margins"])

    return run


def _free(name: str, taken: set) -> str:
    while name.lower() in taken:
        name = "_" + name
    return name


def identify(docs: DataFrame, model: Model, *, doc_id="doc_id", text="text", keep: bool = False) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score, ambiguous, bits; with
    ``keep`` all columns of ``docs`` and these last (with underscores before a name that
    ``docs`` has itself).

    A text that is null or has no letter gets ``und`` and score 0; of languages that cost the same,
    the first by code point is taken. Very long texts are summed block by block. Repeated rows get
    the same answer each; no rows give no rows. The text is the prediction's only input.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x bits floats, whatever the data
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("bits", T.StringType())])
    src = docs if keep else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    at = src.columns.index(text if keep else "text")
    taken = {c.lower() for c in src.columns} if keep else set()
    new = [T.StructField(_free(f.name, taken), f.dataType) for f in schema]
    out = T.StructType((src.schema.fields if keep else [src.schema["doc_id"]]) + new)
    arrow = to_arrow_schema(out)

    def run(batches):
        m = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                rows = [m.predict(t) for t in b.column(at).to_pylist()]
                cols = list(zip(*rows)) if rows else [[]] * 4
                front = list(b.columns) if keep else [b.column(0)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(front, arrow)] + [pa.array(c, f.type) for c, f in zip(cols, list(arrow)[len(front) :])], schema=arrow)

    return src.mapInArrow(run, out)
