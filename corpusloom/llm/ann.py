"""Nearest neighbours by inner product, with multi-index hashing.

Vectors are turned by learned rotations (iterative quantisation) and each coordinate's sign
is a bit. Codes are split into substrings and each substring position has its own table of
posting lists. A query probes every table with all values within ``reach`` bits of its own;
what the posting lists hold is all that it ever looks at. By the pigeonhole principle they
hold every code within ``tables * (reach + 1) - 1`` bits, and of the codes beyond they hold
those that come near in one substring at least. Those within a learned radius over the whole
code are reranked by exact inner products.

Substrings are about as long as the logarithm of the rows, so a posting list holds about one
row however many there are; tables and reach are the cheapest that find a sample's true
neighbours. Inner products are made angular by one more coordinate that lifts every vector to
the largest norm. Index rows and queries meet block by block, in a grid of tasks of bounded
size; each cell returns its best ``k`` and cells merge by query.
"""

from __future__ import annotations

import warnings
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Vectors that the rotations are learned on, and queries whose true neighbours teach tables and radius, at most.
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 256
#: Substrings (tables) of a code, at most, and bits that probing may change in one.
TABLES, REACH = 96, 4
#: Rows of the index in a block, at least (but for small tables) and at most, and queries in a group.
LEAST_BLOCK, INDEX_BLOCK, QUERY_BLOCK = 16_384, 131_072, 32_768
#: Share of the sample's true neighbours that probing must find, and that the radius must keep.
FIND, COVER = 0.96, 0.99
#: Vectors that are reranked at once.
AT_ONCE = 32_768


def rotations(x: np.ndarray, bits: int, seed: int = 11, steps: int = 15) -> np.ndarray:
    """(dims, bits): orthogonal blocks, each turned until signs of the turned sample fit it best."""
    d, rng, out = x.shape[1], np.random.default_rng(seed), []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(steps if len(x) else 0):
            u, _, v = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ v
        out.append(r)
    return np.hstack(out)[:, :bits]


class Codes:
    """Codes of some vectors: ``sub`` (rows, tables) holds the substrings as numbers of ``width``
    bits, ``words`` (rows, words) the whole codes in 64-bit words."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, width: int):
        tables = turn.shape[1] // width
        self.sub = np.zeros((len(x), tables), np.uint32)
        self.words = np.zeros((len(x), -(-turn.shape[1] // 64)), np.uint64)
        for lo in range(0, len(x), 4096):
            bits = x[lo : lo + 4096] @ turn > 0
            self.sub[lo : lo + 4096] = bits.reshape(-1, tables, width) @ (1 << np.arange(width))
            packed = np.packbits(bits, axis=1)
            self.words[lo : lo + 4096].view(np.uint8)[:, : packed.shape[1]] = packed


def lift(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, top * top - (x * x).sum(1)))
    return np.hstack([x, rest[:, None]]) / top


def near_values(reach: int, width: int) -> np.ndarray:
    """Masks of all substring changes of up to ``reach`` bits."""
    return np.array([sum(1 << b for b in c) for k in range(reach + 1) for c in combinations(range(width), k)], np.uint32)


class MultiIndex:
    """Tables of one block of codes: for each substring, the rows ordered by its value and the
    place where each value starts. ``touched`` counts the entries of posting lists read so far."""

    def __init__(self, codes: Codes, width: int, reach: int):
        self.words, self.masks, self.touched = codes.words, near_values(reach, width), 0
        n, tables = codes.sub.shape
        self.order = np.concatenate([np.argsort(c, kind="stable").astype(np.int32) for c in codes.sub.T])
        self.start = np.stack([np.r_[0, np.cumsum(np.bincount(c, minlength=1 << width))] + j * n for j, c in enumerate(codes.sub.T)])
        self.table = np.arange(tables)[:, None]
        self.seen = np.zeros(n, bool)

    def hits(self, sub: np.ndarray) -> np.ndarray:
        """Rows that a posting list of a probed value holds, each once, in order."""
        probe = sub[:, None] ^ self.masks
        lo = self.start[self.table, probe].ravel()
        size = self.start[self.table, probe + 1].ravel() - lo
        total = int(size.sum())
        self.touched += total
        at = np.arange(total) + np.repeat(lo - (np.cumsum(size) - size), size)
        self.seen[:] = False
        self.seen[self.order[at]] = True
        return np.flatnonzero(self.seen)

    def within(self, codes: Codes, i: int, radius: int) -> np.ndarray:
        """The hits of query ``i`` whose whole code differs in at most ``radius`` bits."""
        row = self.hits(codes.sub[i])
        apart = np.bitwise_count(self.words[row] ^ codes.words[i]).sum(1, dtype=np.int32)
        return row[apart <= radius]


class Plan:
    """What the sample taught: rotations, substring width, reach and the whole code's radius."""

    def __init__(self, turn, width, reach, radius):
        self.turn, self.width, self.reach, self.radius = turn, width, reach, radius


def learn(sample: np.ndarray, top: float, asked: np.ndarray, near: np.ndarray, block: int) -> Plan | None:
    """The cheapest tables and reach that find ``FIND`` of true neighbours; None where none of up to
    ``TABLES`` and ``REACH`` do. ``sample`` teaches the rotations; ``near`` are true neighbours, row
    by row, of ``asked``."""
    width = int(np.clip(round(np.log2(max(2, block))), 8, 17))
    full = rotations(lift(sample, top), TABLES * width)
    c = Codes(lift(near, top), full, width).sub
    q = Codes(np.hstack([asked, np.zeros((len(asked), 1))]), full, width).sub
    apart = np.bitwise_count(c ^ q) if len(c) else np.zeros((1, TABLES), np.uint8)
    least = np.minimum.accumulate(apart, axis=1)  # nearest substring of the first so many tables
    choices = []
    for reach in range(REACH + 1):
        found = (least <= reach).mean(0)
        values = sum(comb(width, i) for i in range(reach + 1))
        for tables in range(1, TABLES + 1):
            ok = found[tables - 1] >= FIND
            choices.append((not ok, tables * values * (1 + block / 2**width) if ok else -found[tables - 1], tables, reach))
    missed, _, tables, reach = min(choices)
    if missed:
        return None
    return Plan(full[:, : tables * width], width, reach, int(np.ceil(np.quantile(apart[:, :tables].sum(1), COVER))))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, *, vec_id="vec_id", embedding="embedding", k=20, every=20) -> DataFrame:
    """The ``k`` nearest rows of each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every`` (or the rows of ``queries``), one
    for each id (of unlike vectors with one id, the smallest asks); candidates are all rows but
    those with the query's own id. Scores are inner products in double precision; equal scores
    go by the smaller id. A query for which probing found fewer than ``k`` rows in all blocks
    together is answered from all rows, block by block, so no answer is short; and so are all where
    no tables find enough of the sample's true neighbours, with a warning. Vectors that are
    null, empty, zero, of another length than most, or hold null or non-finite components take
    no part; repeated rows are candidates each, and are counted, not gathered; other columns
    are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    e = F.col(embedding).cast("array<double>")
    keep = lambda d: d.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = keep(vectors)
    asked = rows.filter(F.col("vec_id") % every == 0) if queries is None else keep(queries)
    stats = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("top")).orderBy(F.desc("n"), "d").first()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if stats is None:
        return spark.createDataFrame([], schema)
    d, n, top = stats
    h = F.xxhash64("vec_id", F.lit("ann"))
    sample = rows.filter(F.size("v") == d).filter(F.pmod(h, F.lit(1 << 20)) < (1 << 20) * min(1.0, 2 * SAMPLE_ROWS / n)).orderBy(h, "vec_id").limit(SAMPLE_ROWS).select("vec_id", "v").collect()
    # repeated rows are one row with a count; an id asks once
    rows = materialize(rows.filter(F.size("v") == d).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times")), "ann-rows")
    asked = materialize(asked.filter(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    size = int(np.clip(n // max(1, spark.sparkContext.defaultParallelism), LEAST_BLOCK, INDEX_BLOCK))
    blocks = max(1, -(-n // size))
    some = asked.orderBy(F.xxhash64("vec_id", F.lit("ask")), "vec_id").limit(SAMPLE_QUERIES)
    true = _search(rows, some, d, k, top, blocks, None)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = true.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("query_id", "vec_id")
    true = materialize(true, "ann-true")  # SAMPLE_QUERIES * k rows at most, so both sides below are small
    true = rows.select("vec_id", "v").join(F.broadcast(true), "vec_id").join(F.broadcast(some.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))), "query_id").select("q", "v").collect()
    array = lambda a: np.array(a, float).reshape(-1, d)
    plan = learn(array([r.v for r in sample]), top, array([r.q for r in true]), array([r.v for r in true]), -(-n // blocks))
    if plan is None:
        warnings.warn(f"no {TABLES} tables find {FIND:.0%} of the sampled neighbours: all rows are searched", stacklevel=2)
    held = plan and spark.sparkContext.broadcast(plan)  # dims x bits floats, whatever the data
    found = materialize(_search(rows, asked, d, k, top, blocks, held), "ann")
    others = F.lit(n) - F.coalesce("own", F.lit(0))
    own = rows.select("vec_id", "times").join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.sum("times").alias("own"))
    got = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.sum("times").alias("got"))
    short = asked.join(got, "vec_id", "left").join(own, "vec_id", "left").filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), others)).select("vec_id", "v")
    short = materialize(short, "ann-short")
    if short.limit(1).count():
        rest = materialize(_search(rows, short, d, k, top, blocks, None), "ann")
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(rest)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(k).cast("long"), F.col("times")))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("times", T.LongType())])


def _search(rows: DataFrame, asked: DataFrame, d: int, k: int, top: float, blocks: int, held) -> DataFrame:
    """Best ``k`` of each query in each block of the index: by the tables of ``held``, or of all rows if None."""
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    spread = lambda m, *c: F.pmod(F.xxhash64(*c, F.lit(m)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = rows.withColumn("b", spread(blocks, "vec_id", "v")).withColumn("g", each(groups))
    query = asked.withColumn("g", spread(groups, "vec_id")).withColumn("b", each(blocks))

    def matrix(t):
        return t.column("vec_id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def cell(left, right):
        (ids, x), (qid, q), out = matrix(left), matrix(right), []
        times = left.column("times").to_numpy()
        if len(ids) and len(qid) and held:
            plan = held.value
            index = MultiIndex(Codes(lift(x, top), plan.turn, plan.width), plan.width, plan.reach)
            asked = Codes(np.hstack([q, np.zeros((len(q), 1))]), plan.turn, plan.width)
        for i in range(len(qid)):
            row = index.within(asked, i, plan.radius) if held else np.arange(len(ids))
            row = row[ids[row] != qid[i]]
            score = np.concatenate([(x[row[a : a + AT_ONCE]] * q[i]).sum(1) for a in range(0, len(row), AT_ONCE)] or [np.zeros(0)])
            best = _best(score, ids[row], k)
            out.append((np.full(len(best), qid[i]), ids[row][best], score[best], times[row][best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        return pa.table(dict(zip(_FOUND.names, cols)))

    return index.groupBy("b", "g").cogroup(query.groupBy("b", "g")).applyInArrow(cell, _FOUND)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to smaller ids."""
    if len(score) <= 4 * k:
        return np.lexsort((ids, -score))[:k]
    kth = np.partition(score, len(score) - k)[len(score) - k]
    at = np.flatnonzero(score >= kth)
    return at[np.lexsort((ids[at], -score[at]))[:k]]
