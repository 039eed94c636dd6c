"""Hard negatives by bit-sliced integer products.

Components become whole numbers in two's complement, and a block of rows is kept as bit-planes:
plane ``j`` holds bit ``j`` of every component, 64 components to a word. The product of an anchor
with plane ``j`` is a sum of population counts of ANDed words, so a score grows plane by plane,
the most significant first. What the planes still to come can add lies between the sums of the
anchor's negative and of its positive components, times ``2**j - 1``; that bounds every score from
both sides. A row is dropped as soon as its interval cannot qualify: for positives when its upper
bound is below the ``k``-th largest lower bound, for negatives when the interval misses every band
of the anchor, or when enough rows that surely lie in the band are surely higher.

Anchors meet all rows in a grid of cells of bounded size (so many rows by so many anchors); each
cell returns its best few of every anchor, and cells merge by anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Rows of a block and anchors of a group, at most, and components of either.
ROW_BLOCK, ANCHOR_BLOCK, COMPONENTS = 131_072, 32_768, 1 << 23


def sliced(q: np.ndarray, bits: int) -> np.ndarray:
    """(bits, rows, words): the bit-planes of whole numbers in two's complement of ``bits`` bits."""
    n, d = q.shape
    out = np.zeros((bits, n, -(-d // 64)), np.uint64)
    for j in range(bits):
        packed = np.packbits((q >> j & 1).astype(np.uint8), axis=1, bitorder="little")
        out[j].view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def plane_products(words: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of one anchor (bits, words) with one plane of some rows (rows, words)."""
    total, top = np.zeros(len(words), np.int64), len(anchor) - 1
    for i, a in enumerate(anchor):
        if a.any():
            count = np.bitwise_count(words & a)
            count = count[:, 0].astype(np.int64) if words.shape[1] == 1 else count.sum(1, dtype=np.int64)
            total += -(count << i) if i == top else count << i
    return total


def scores(planes: np.ndarray, anchor: np.ndarray, a: np.ndarray, at: np.ndarray, qualify):
    """(places, scores) of the rows ``at`` that may still qualify when all planes are added.

    ``qualify(lo, hi)`` tells from bounds of the scores which rows to keep; it must keep every row
    that could qualify for some score within its bounds.
    """
    top = len(planes) - 1
    low, high = int(a[a < 0].sum()), int(a[a > 0].sum())
    part = np.zeros(len(at), np.int64)
    for j in range(top, -1, -1):
        if not len(at):
            break
        p = plane_products(planes[j][at], anchor)
        part += -(p << j) if j == top else p << j
        rest = (1 << j) - 1
        keep = qualify(part + rest * low, part + rest * high)
        if not keep.all():
            at, part = at[keep], part[keep]
    return at, part


def highest(k: int):
    """Keeps rows that may be among the ``k`` highest, ties included."""

    def qualify(lo, hi):
        return hi >= np.partition(lo, len(lo) - k)[len(lo) - k] if len(lo) > k else np.ones(len(lo), bool)

    return qualify


def in_bands(positive: list[int], k: int, low: int, high: int):
    """Keeps rows that may be among the ``k`` highest with ``low * p <= 100 * score <= high * p``
    for some positive score ``p``, ties included."""

    def qualify(lo, hi):
        keep = np.zeros(len(lo), bool)
        for p in positive:
            may = (100 * hi >= low * p) & (100 * lo <= high * p)
            surely = lo[(100 * lo >= low * p) & (100 * hi <= high * p)]
            if len(surely) > k:
                may &= hi >= np.partition(surely, len(surely) - k)[len(surely) - k]
            keep |= may
        return keep

    return qualify


def _first(score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((row, vec_id, -score))[:k]


def clean(vectors: DataFrame, *, vec_id="vec_id", embedding="embedding", label="label", scale=256) -> DataFrame:
    """Rows that take part: row (tells repeated rows apart), vec_id, label, q (whole components)."""
    e = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), e.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("q"))


def _grid(rows: DataFrame, anchors: DataFrame, n: int, m: int, d: int, run, schema: T.StructType) -> DataFrame:
    """``run(rows, anchors)`` on every cell of blocks of rows by groups of anchors."""
    most = lambda k: max(1, min(k, COMPONENTS // d))
    blocks = max(1, -(-n // most(ROW_BLOCK)), min(-(-n // 512), 2 * rows.sparkSession.sparkContext.defaultParallelism))
    groups = max(1, -(-m // most(ANCHOR_BLOCK)))
    spread = lambda c, k: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumn("b", spread("row", blocks)).withColumn("g", each(groups)).groupBy("b", "g")
    right = anchors.withColumn("g", spread("row", groups)).withColumn("b", each(blocks)).groupBy("b", "g")
    return left.cogroup(right).applyInArrow(run, schema)


def _matrix(t: pa.Table, d: int) -> np.ndarray:
    """Components, with zeros where a vector is shorter than ``d``."""
    lists = t.column("q").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), d), np.int64)
    out[np.arange(d) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def hard_negatives(vectors: DataFrame, *, vec_id="vec_id", embedding="embedding", label="label", every=100, positives=5, negatives=10, low=30, high=90, scale=256) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``.

    A component ``x`` counts as ``floor(scale * x)``; the score of a row is its integer inner
    product with the anchor; higher scores come first, ties by the smaller id. For an anchor and
    each of its first ``positives`` other rows of the same label, the first ``negatives`` rows of
    another label with ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    Rows with a null id, label or vector, or with a null or non-finite component, take no part. An
    empty vector scores 0; of vectors of unlike lengths the shorter counts as followed by zeros.
    Repeated rows are rows each: a repeated anchor is another row to its copies and has results of
    its own; between equal scores and ids any order gives the same rows. Other columns are ignored;
    no anchors or no rows give no rows. Components so large that scores could leave 62 bits raise.
    """
    spark = vectors.sparkSession
    rows = materialize(clean(vectors, vec_id=vec_id, embedding=embedding, label=label, scale=scale), "mine-rows")
    absolute = F.array_max(F.transform("q", lambda x: F.abs(x)))
    n, m, most, d = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.max(absolute), F.max(F.size("q"))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not m:
        return spark.createDataFrame([], out)
    most, d = most or 0, max(1, d)
    if 100 * max(abs(low), abs(high), 1) * d * (most + 1) ** 2 >= 2**62:
        raise ValueError(f"components up to {most} leave 62 bits in a product of {d}")
    bits = int(most).bit_length() + 1
    anchors = rows.filter(F.col("vec_id") % every == 0)

    def cell(left: pa.Table):
        """The block's rows, sorted by label, as bit-planes."""
        left = left.sort_by("label")
        return left, *(left.column(c).to_numpy() for c in ("vec_id", "row", "label")), sliced(_matrix(left, d), bits)

    def same(left, right):
        found = []
        if len(left) and len(right):
            left, ids, row, labels, planes = cell(left)
            q = _matrix(right, d)
            cut = sliced(q, bits)
            for i, (r, y) in enumerate(zip(right.column("row").to_pylist(), right.column("label").to_pylist())):
                at = np.arange(*np.searchsorted(labels, [y, y + 1]))
                at, score = scores(planes, cut[:, i], q[i], at[row[at] != r], highest(positives))
                best = _first(score, ids[at], row[at], positives)
                found.append((np.full(len(best), r), ids[at[best]], row[at[best]], score[best]))
        return _table(found, near)

    near = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "positive_id", "positive_row", "positive_score")])
    first = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    held = _grid(rows, anchors, n, m, d, same, near).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= positives)
    held = held.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("held"))
    asked = materialize(anchors.join(held, "row"), "mine-anchors")  # with their few positives

    def other(left, right):
        found = []
        if len(left) and len(right):
            left, ids, row, labels, planes = cell(left)
            q = _matrix(right, d)
            cut = sliced(q, bits)
            for i, (r, v, y, ps) in enumerate(zip(*(right.column(c).to_pylist() for c in ("row", "vec_id", "label", "held")))):
                lo, hi = np.searchsorted(labels, [y, y + 1])
                at = np.concatenate([np.arange(lo), np.arange(hi, len(row))])
                at, score = scores(planes, cut[:, i], q[i], at, in_bands(sorted({p["positive_score"] for p in ps}), negatives, low, high))
                for p in ps:
                    s = p["positive_score"]
                    ok = np.flatnonzero((100 * score >= low * s) & (100 * score <= high * s))
                    best = ok[_first(score[ok], ids[at[ok]], row[at[ok]], negatives)]
                    k = len(best)
                    found.append((np.full(k, r), np.full(k, p["nth"]), np.full(k, v), np.full(k, p["positive_id"]), np.full(k, s), ids[at[best]], row[at[best]], score[best]))
        return _table(found, far)

    far = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "nth", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_row", "negative_score")])
    last = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    mined = _grid(rows, asked, n, m, d, other, far).withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= negatives)
    return mined.select(*(c.split()[0] for c in out.split(", ")))


def _table(found: list, schema: T.StructType) -> pa.Table:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(schema)
    return pa.table(dict(zip(schema.names, columns)))
