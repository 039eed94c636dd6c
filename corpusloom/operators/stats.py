"""Paired statistics: ratios of sums, intervals, bootstraps, n-gram diagnostics."""

from __future__ import annotations

import copy
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import WORD, joined_ngrams

#: The normal and Student (4 degrees of freedom) quantiles in use.
Z95, T95_DF4 = 1.96, 2.7764451051977987


def bits_per_byte(nats: Column, size: Column) -> Column:
    """Ratio of sums, never a mean of ratios."""
    return F.sum(nats) / F.ln(F.lit(2.0)) / F.sum(size)


def wilson(wins: Column, n: Column, z: float = Z95) -> Column:
    """Struct of the Wilson interval's ends; null when ``n`` is 0."""
    p = wins / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.struct((mid - half).alias("low"), (mid + half).alias("high")))


def paired_t(df: DataFrame, by: list[str], diff: str, pairs: int = 5, t: float = T95_DF4, margin: float = 0.01) -> DataFrame:
    """Mean difference with its t interval, direction and equivalence; null bounds unless there
    are exactly ``pairs`` pairs."""
    d = df.groupBy(*by).agg(F.count(diff).alias("pairs"), F.avg(diff).alias("mean"), F.stddev_samp(diff).alias("sd"))
    half = F.when(F.col("pairs") == pairs, t * F.col("sd") / F.sqrt(F.lit(float(pairs))))
    d = d.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)
    way = F.when(F.col("high") < 0, "lower").when(F.col("low") > 0, "higher").when(F.col("low").isNotNull(), "unclear").otherwise("incomplete")
    return d.withColumn("direction", way).withColumn("equivalent", (F.col("low") > -margin) & (F.col("high") < margin)).drop("sd")


def hash_poisson(key: Column, draw: Column, terms: int = 8) -> Column:
    """Poisson(1) weight of a row in a draw, from a hash: the same everywhere, no generator state.

    The uniform is 13 hex digits of an MD5 of key and draw; the weight counts the steps of the
    Poisson distribution function that it passes.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), draw.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    total, p, out = 0.0, float(np.exp(-1)), F.lit(0)
    for k in range(terms):
        total += p
        p /= k + 1
        out = out + (u >= total).cast("int")
    return out


#: Rows of a leaf of the resampling tree, about, and leaves at most (their sizes are broadcast).
LEAF_ROWS, LEAVES = 4096, 65_536
#: Rows alike from which their count in a draw is drawn at once, and indices that are drawn at once.
ALIKE, AT_ONCE = 40, 1 << 17
#: Rows of a block: 16 random bits are two of them. Pairs that are drawn at once stay in a core's cache.
BLOCK, PAIRS = 256, 1 << 15
#: Rows of a part of a group, about, and raw numbers of a piece at most, where groups share a generator.
PART_ROWS, PIECE = 4096, 1 << 22
#: Rows held of groups that are drawn together, and groups up to which a running sum places them.
HELD_ROWS, GROUPS = 1 << 23, 100_000


def _generator(*seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.SFC64(np.random.SeedSequence(seed)))


class ResampleTree:
    """How often each leaf's rows are drawn: a draw takes as many rows as there are, with
    replacement, and a node's share of its parent's rows is binomial. Each node has a generator of
    its own, so any task finds the counts of any leaf, and the counts of a draw always sum to all."""

    def __init__(self, sizes: np.ndarray, draws: int, seed: int):
        self.levels, self.draws, self.seed = [np.asarray(sizes, np.int64)], draws, seed
        while len(self.levels[0]) > 1:
            self.levels.insert(0, self.levels[0].reshape(-1, 2).sum(1))
        self.path: list[tuple[int, np.ndarray]] = []

    def counts(self, leaf: int) -> np.ndarray:
        """Rows that each draw takes from a leaf."""
        depth = len(self.levels) - 1
        for level in range(depth + 1):
            node = leaf >> (depth - level)
            if level < len(self.path) and self.path[level][0] == node:
                continue
            del self.path[level:]
            if not level:
                taken = np.full(self.draws, self.levels[0][0])
            else:
                above, whole, left = self.path[-1][1], self.levels[level - 1][node >> 1], self.levels[level][node & ~1]
                taken = _generator(self.seed, level, node >> 1).binomial(above, left / whole if whole else 0.0)
                if node & 1:
                    taken = above - taken
            self.path.append((node, taken))
        return self.path[-1][1]


def block_sums(values: np.ndarray, taken: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sums of the drawn values (complex) of a block of :data:`BLOCK` rows, by draw. Two rows are drawn
    at once, from a table of the sums of all pairs; of an odd number one is drawn alone."""
    out, two = np.empty(len(taken), complex), np.add.outer(values, values).ravel()
    half, odd = taken >> 1, np.flatnonzero(taken & 1)
    ends = np.r_[0, np.cumsum(half)]
    cuts = np.unique(np.r_[np.searchsorted(ends, np.arange(0, ends[-1], PAIRS)), len(taken)]) if ends[-1] else np.zeros(1, int)
    held = np.empty(int(np.diff(ends[cuts]).max(initial=0)) + 1, complex)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        n = int(ends[hi] - ends[lo])
        drawn = two.take(rng.bit_generator.random_raw(n // 4 + 1).view(np.uint16)[: n + 1], out=held[: n + 1], mode="wrap")
        drawn[n] = 0  # where draws without a pair begin that come last
        out[lo:hi] = np.add.reduceat(drawn, ends[lo:hi] - ends[lo])
    out[half == 0] = 0
    out[odd] += values.take(rng.integers(0, len(values), len(odd), dtype=np.uint8))
    return out


def leaf_sums(values: np.ndarray, alike: np.ndarray, taken: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sums of the drawn values (complex) of a leaf, by draw. ``alike`` says how many rows have each value."""
    out = np.zeros(len(taken), complex)
    many = alike >= ALIKE
    if many.any():
        p = np.append(alike[many], alike[~many].sum()) / alike.sum()
        step = max(1, AT_ONCE // len(p))
        rest = np.empty_like(taken)
        for lo in range(0, len(taken), step):
            counts = rng.multinomial(taken[lo : lo + step], p)
            out[lo : lo + step] = counts[:, :-1] @ values[many]
            rest[lo : lo + step] = counts[:, -1]
        taken = rest
    few = np.repeat(values[~many], alike[~many])
    blocks = len(few) // BLOCK
    if blocks:  # rows beyond whole blocks are drawn one by one
        sizes = np.append(np.full(blocks, BLOCK), len(few) - blocks * BLOCK)
        parts = rng.multinomial(taken, sizes / len(few))
        for i in range(blocks):
            out += block_sums(few[i * BLOCK : (i + 1) * BLOCK], parts[:, i], rng)
        few, taken = few[blocks * BLOCK :], parts[:, blocks]
    if not len(few):
        return out
    kind = next(k for k in (np.uint16, np.uint32, np.uint64) if len(few) <= np.iinfo(k).max)
    ends = np.cumsum(taken)
    lo = 0
    while lo < len(taken):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
        some = taken[lo:hi] > 0
        if some.any():
            drawn = few.take(rng.integers(0, len(few), int(ends[hi - 1] - base), dtype=kind))
            starts = np.r_[0, ends[lo:hi] - base][:-1]
            out[lo:hi][some] += np.add.reduceat(drawn, starts[some])
        lo = hi
    return out


def resampled_ratios(df: DataFrame, numerator: str, denominator: str, draws: int = 20_000, seed: int = 1701, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(draw, ratio): ratio of sums over as many rows as there are, drawn with replacement.

    Rows with equal values are counted first, so rows that are stored very often are one entry.
    Entries are spread over leaves by a hash of their values, a draw's rows over the leaves by
    :class:`ResampleTree`, and each task passes on ``draws`` sums. The same rows give the same
    draws however they are partitioned; a null value counts as zero; no rows give no draws.
    """
    from ..session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, "alike")
    some = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(x) for c, x in ((numerator, "n"), (denominator, "d"))))
    some.groupBy("n", "d").agg(F.count(F.lit(1)).alias("alike")).write.parquet(path)
    alike = spark.read.schema("n double, d double, alike long").parquet(path)
    rows = alike.agg(F.sum("alike")).first()[0] or 0
    schema = "draw int, n double, d double"
    if not rows:
        return spark.createDataFrame([], "draw int, ratio double")
    leaves = 1 << min(LEAVES - 1, -(-rows // leaf_rows) - 1).bit_length()
    alike = alike.withColumn("leaf", F.pmod(F.xxhash64("n", "d"), F.lit(leaves)).cast("int"))
    sizes = np.zeros(leaves, np.int64)
    for r in alike.groupBy("leaf").agg(F.sum("alike").alias("rows")).collect():
        sizes[r.leaf] = r.rows
    held = spark.sparkContext.broadcast(sizes)

    def run(batches):
        tree, sums, open_, parts = ResampleTree(held.value, draws, seed), np.zeros(draws, complex), None, []

        def close():
            if parts:
                n, d, alike = (np.concatenate(c) for c in zip(*parts))
                sums[:] += leaf_sums(n + 1j * d, alike, tree.counts(open_), _generator(seed, 1 << 20, open_))
                parts.clear()

        for b in batches:
            n, d, alike, leaf = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.r_[0, np.flatnonzero(np.diff(leaf)) + 1, len(leaf)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z > a:
                    if leaf[a] != open_:
                        close()
                        open_ = int(leaf[a])
                    parts.append((n[a:z], d[a:z], alike[a:z]))
        close()
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws), pa.int32()), pa.array(sums.real.copy()), pa.array(sums.imag.copy())], ["draw", "n", "d"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    # a task takes leaves that lie side by side, as many as any other: they share their path in the tree
    placed = alike.select("n", "d", "alike", "leaf").repartitionById(tasks, (F.col("leaf") * tasks / leaves).cast("int")).sortWithinPartitions("leaf", "n", "d")
    return placed.mapInArrow(run, schema).groupBy("draw").agg(F.try_divide(F.sum("n"), F.sum("d")).alias("ratio"))


def interval(draws: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """Percentile interval with linear interpolation."""
    a = (1 - level) / 2
    return draws.agg(F.percentile(value, F.lit(a)).alias("low"), F.percentile(value, F.lit(1 - a)).alias("high"), F.count(F.lit(1)).alias("draws"))


def _parts(n: int) -> int:
    """Parts of the generator's range for ``n`` rows: a part's rows lie in a core's cache."""
    return 1 << min(16, ((n - 1) // PART_ROWS).bit_length())


def _parted(raw: np.ndarray, parts: int, stretch: int, numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Puts numbers by part within each stretch, and their positions beside them; where each
    stretch's parts begin and end, by stretch."""
    bounds = []
    for lo in range(0, len(raw), stretch):
        some, at = raw[lo : lo + stretch], slice(lo, lo + stretch)
        if parts == 1:
            numbers[at], places[at] = some, np.arange(lo, lo + stretch)
            bounds.append([lo, lo + stretch])
            continue
        part = (some >> np.uint32(33 - parts.bit_length())).astype(np.uint8 if parts <= 256 else np.uint16)
        order = np.argsort(part, kind="stable")
        some.take(order, out=numbers[at], mode="wrap")
        np.add(order, lo, out=places[at], casting="unsafe")
        bounds.append(lo + np.r_[0, np.cumsum(np.bincount(part, minlength=parts))])
    return np.array(bounds)


def _refused(raw: np.ndarray, sizes: list[int], step: int) -> list[np.ndarray]:
    """Positions, for each number of rows, of the raw numbers that numpy's generator passes over so
    that all rows are as likely. The length is a multiple of ``step``, which is one of 8."""
    found, product, small = [([], []) for _ in sizes], np.empty(step, np.uint32), np.empty(step, bool)
    eights = small.view(np.uint64)
    for lo in range(0, len(raw), step):
        for n, (where, what) in zip(sizes, found):
            if bound := (1 << 32) % n:
                np.less(np.multiply(raw[lo : lo + step], np.uint32(n), out=product), np.uint32(bound), out=small)
                if len(some := eights.nonzero()[0]):
                    where.append(some + lo // 8)
                    what.append(eights[some])
    out = []
    for where, what in found:
        eight, one = np.concatenate(what or [eights[:0]]).view(bool).reshape(-1, 8).nonzero()
        out.append(np.concatenate(where)[eight] * 8 + one if where else one)
    return out


def shared_sums(groups: list[np.ndarray], draws: int, rng: np.random.Generator, at_once: int = AT_ONCE) -> list[np.ndarray]:
    """Of each group (complex values), the sums of as many values as there are, drawn with
    replacement, by draw: those of ``rng.integers(n, size=(draws, n))`` by a new PCG64 generator,
    the same for every group, so its raw numbers are made once for all.

    A raw number u of 32 bits is index u * n >> 32, if it is not refused. Numbers are held in
    pieces and put by their highest bits, so they meet a group's rows a part at a time.
    """
    if (most := max(map(len, groups))) > 1 << 32:  # numpy draws from 64 bits
        ends = [np.r_[0 : len(v) : at_once, len(v)] for v in groups]
        return [np.array([sum(v.take(r.integers(0, len(v), z - a)).sum() for a, z in zip(e, e[1:])) for _ in range(draws)]) for v, e in zip(groups, ends) for r in [copy.deepcopy(rng)]]
    parts, step = _parts(most), max(8, at_once // 32 * 8)
    block = step * min(parts, max(1, PIECE // step))
    length, stretch = block * max(1, 16 // parts), step * next(k for k in (4, 2, 1) if block % (step * k) == 0)
    numbers, places, product = np.empty(length, np.uint32), np.empty(length, np.int32), np.empty(0, np.uint64)
    sums, taken, live = [np.zeros(draws + 1, complex) for _ in groups], [0] * len(groups), list(range(len(groups)))
    while live:
        raw = rng.bit_generator.random_raw(length // 2).view(np.uint32)
        refused, plans = _refused(raw, [len(groups[g]) for g in live], step), []
        for g, out in zip(live, refused):
            n, before = len(groups[g]), taken[g]
            taken[g] += length - len(out)
            first = before // n
            cuts = np.arange(first + 1, min(draws, (taken[g] - 1) // n) + 1) * n - before  # where draws begin, among those taken
            cuts += np.searchsorted(out - np.arange(len(out)), cuts)
            cell = out // block * parts + (raw[out].astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            out = out[np.argsort(cell, kind="stable")].astype(np.int32)
            plans.append((groups[g], np.uint64(n), sums[g][first : first + len(cuts) + 1], cuts.astype(np.int32), np.zeros(len(cuts) + 1, np.int64), out, np.r_[0, np.cumsum(np.bincount(cell, minlength=length // block * parts))].tolist()))
        bounds = _parted(raw, parts, stretch, numbers, places).reshape(length // block, block // stretch, parts + 1)
        for i in range(length // block * parts):
            stretches = [slice(a, z) for a, z in bounds[i // parts, :, i % parts : i % parts + 2].tolist()]
            some, at = np.concatenate([numbers[x] for x in stretches]).astype(np.uint64), np.concatenate([places[x] for x in stretches])
            if len(some) > len(product):
                product, held = np.empty(len(some) * 17 // 16, np.uint64), np.empty(len(some) * 17 // 16 + 1, complex)
            index, drawn = product[: len(some)], held[: len(some) + 1]
            rows, picked = index.view(np.int64), drawn[:-1]
            for values, n, mine, cuts, begin, out, where in plans:
                np.right_shift(np.multiply(some, n, out=index), np.uint64(32), out=index)
                values.take(rows, out=picked, mode="wrap")
                drawn[-1] = 0  # where draws without a number in this part begin that come last
                if where[i] < where[i + 1]:
                    drawn[at.searchsorted(out[where[i] : where[i + 1]])] = 0
                begin[1:] = at.searchsorted(cuts)
                part = np.add.reduceat(drawn, begin)
                part[:-1][begin[1:] == begin[:-1]] = 0
                mine += part
        live = [g for g in live if taken[g] < draws * len(groups[g])]
    return [x[:draws] for x in sums]


def drawn_sums(values: np.ndarray, draws: int, rng: np.random.Generator, at_once: int = AT_ONCE) -> np.ndarray:
    """:func:`shared_sums` of one group. Memory does not grow with the draws."""
    return shared_sums([values], draws, rng, at_once)[0]


def numpy_bootstrap(df: DataFrame, by: list[str], key: str, a: str, b: str, size: str, draws: int = 20_000, seed: int = 1701) -> DataFrame:
    """Paired bootstrap of (sum a - sum b) / ln 2 / sum size with numpy's generator, per group.

    A group's generator is one sequence, so a group is drawn in one task, which holds its values.
    All groups have the same sequence: tasks take groups of about as many rows in all, and draw
    those of like size together (:func:`shared_sums`), :data:`HELD_ROWS` rows or one group at once.
    A group's result is the same in whatever company. Rows of one key go by their values, so a
    rerun draws the same. :func:`resampled_ratios` spreads one large group over all tasks.
    """
    from ..session import scratch_path

    spark = df.sparkSession
    schema = df.select(*by).schema.add("delta", "double").add("low", "double").add("high", "double").add("wins", "long").add("windows", "long")
    path, tasks, names = scratch_path(spark, "groups"), spark.sparkContext.defaultParallelism, [f"__by{i}" for i in range(len(by))]
    counted = df.groupBy(*(F.col(c).alias(x) for c, x in zip(by, names))).agg(F.count(F.lit(1)).alias("__rows"))
    counted.write.parquet(path)
    sizes = spark.read.schema(counted.schema).parquet(path)
    groups, rows = sizes.agg(F.count("__rows"), F.coalesce(F.sum("__rows"), F.lit(1))).first()
    if groups > GROUPS:
        sizes = sizes.withColumn("__task", F.pmod(F.xxhash64(*names), F.lit(tasks)).cast("int"))
    else:
        through = F.sum("__rows").over(Window.orderBy("__rows", *names).rowsBetween(Window.unboundedPreceding, 0))
        sizes = sizes.withColumn("__task", F.floor((through - F.col("__rows") / 2) * tasks / rows).cast("int"))
    real = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}  # null goes as NaN
    order = {f"__o{i}": F.coalesce(F.col(c), F.lit(float("nan"))) if c in real else F.col(c) for i, c in enumerate(dict.fromkeys([key, a, b, size]))}
    given = df.select(*by, (F.col(a) - F.col(b)).cast("double").alias("__diff"), F.col(size).cast("double").alias("__size"), *(c.alias(x) for x, c in order.items()))
    for c, x in zip(by, names):
        on = F.col(c).eqNullSafe(F.col(x)) if x == names[0] else on & F.col(c).eqNullSafe(F.col(x))
    placed = given.join(sizes, on).repartitionById(tasks, "__task").sortWithinPartitions("__rows", *by, *(F.col(x).asc_nulls_last() for x in order))

    def run(batches):
        held, heads, values, filled = [], [], np.empty(0, complex), 0

        def close():
            low, high = np.array([np.quantile(s.real / np.log(2) / s.imag, [0.025, 0.975]) for s in shared_sums(held, draws, np.random.default_rng(seed))]).T
            delta = np.array([v.real.sum() / np.log(2) / v.imag.sum() for v in held])
            wins, windows = np.array([np.count_nonzero(v.real < 0) for v in held]), np.array([len(v) for v in held])
            columns = [pa.concat_arrays([h.column(c) for h in heads]) for c in by] + [pa.array(x) for x in (delta, low, high, wins, windows)]
            held.clear()
            heads.clear()
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            diff, n, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__diff", "__size", "__rows"))
            at = 0
            while at < len(rows):
                if filled == len(values):
                    need = int(rows[at])
                    if held and (_parts(need) != _parts(len(held[0])) or sum(map(len, held)) + need > HELD_ROWS):
                        yield close()
                    values, filled = np.empty(need, complex), 0
                    heads.append(batch.slice(at, 1))
                more = min(len(values) - filled, len(rows) - at)
                values.real[filled : filled + more], values.imag[filled : filled + more] = diff[at : at + more], n[at : at + more]
                at, filled = at + more, filled + more
                if filled == len(values):
                    held.append(values)
        if held:
            yield close()

    return placed.select(*by, "__diff", "__size", "__rows").mapInArrow(run, schema)


def repeat_excess(arr: Column, n: int) -> Column:
    """Share of n-grams that repeat an earlier one: (count - distinct) / count, 0 when none."""
    g = joined_ngrams(arr, n)
    return F.when(F.size(g) > 0, (F.size(g) - F.size(F.array_distinct(g))) / F.size(g)).otherwise(F.lit(0.0))


_GRAMS = T.StructType([T.StructField("words", T.LongType()), T.StructField("positions", T.LongType()), T.StructField("distinct", T.LongType()), T.StructField("max_count", T.LongType()), T.StructField("max_ngram", T.StringType())])


def gram_counts(text: Column, n: int) -> Column:
    """Of the lower-case words of a text: words, n-gram positions, distinct n-grams, the top count
    and the first n-gram to reach it. A document is counted where it lies, without a shuffle."""

    def run(x: pa.Array) -> pa.Array:
        out = []
        for t in x.to_pylist():
            if t is None:
                out.append(None)
                continue
            w = re.findall(WORD, t)
            c = Counter(zip(*(w[i:] for i in range(n))))
            top = max(c, key=c.get) if c else None  # the first of equals is the first inserted
            out.append((len(w), max(0, len(w) - n + 1), len(c), c[top] if c else 0, " ".join(top) if c else None))
        return pa.array([None if r is None else dict(zip(_GRAMS.names, r)) for r in out], to_arrow_type(_GRAMS))

    return F.arrow_udf(run, _GRAMS)(F.lower(text))


def ngram_repetition(df: DataFrame, key: str, text: Column, n: int) -> DataFrame:
    """Per document with an n-gram: positions, max_count, max_ngram (first to reach it),
    max_frequency and excess_rate."""
    d = df.select(key, gram_counts(text, n).alias("g")).filter("g.positions > 0").select(key, "g.*")
    return d.select(key, "positions", "max_count", "max_ngram", (F.col("max_count") / F.col("positions")).alias("max_frequency"), ((F.col("positions") - F.col("distinct")) / F.col("positions")).alias("excess_rate"))


def tree_digest(df: DataFrame, group: str, key: str, digest: str, levels: int = 4, width: int = 1024) -> DataFrame:
    """(group, digest): SHA-256 over the digests of ``width`` keys, of those over ``width`` such
    nodes, and so on, so that no task ever holds more than ``width`` digests of a group."""
    for _ in range(levels):
        node = F.floor(F.col(key) / width).cast("long")
        inside = F.transform(F.sort_array(F.collect_list(F.struct(key, digest))), lambda x: x[digest])
        df = df.groupBy(group, node.alias("__k")).agg(F.sha2(F.array_join(inside, ""), 256).alias(digest)).withColumnRenamed("__k", key)
    return df.select(group, digest)


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))


def factorial_effects(arms: DataFrame, value: str) -> DataFrame:
    """Main effects and interaction of two factors from four arms (columns f1, f2 of 0 and 1)."""
    cell = lambda i, j: F.avg(F.when((F.col("f1") == i) & (F.col("f2") == j), F.col(value)))
    one = arms.agg(cell(0, 0).alias("a"), cell(0, 1).alias("b"), cell(1, 0).alias("c"), cell(1, 1).alias("d"))
    return one.select(((F.col("c") + F.col("d") - F.col("a") - F.col("b")) / 2).alias("f1_effect"), ((F.col("b") + F.col("d") - F.col("a") - F.col("c")) / 2).alias("f2_effect"), (F.col("d") - F.col("c") - F.col("b") + F.col("a")).alias("interaction"))


def log_softmax(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """Adds log_p: the score less the log of the group's sum of exponentials."""
    w = Window.partitionBy(*group)
    top = F.max(score).over(w)
    return df.withColumn("log_p", F.col(score) - (top + F.ln(F.sum(F.exp(F.col(score) - top)).over(w))))


def learning_rate(step: Column, steps: int, peak: float, warmup: int, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine down to ``floor`` of the peak."""
    part = (step - warmup) / F.lit(float(max(1, steps - warmup)))
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(np.pi * part))))
