"""Operators over ordered rows: runs, sessions, offsets, windows over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limit_blank_runs(lines: DataFrame, key: str, pos: str, line: str, most: int = 2) -> DataFrame:
    """Adds ``keep``: false for blank lines beyond ``most`` in a row."""
    blank = F.trim(F.col(line)) == ""
    d = lines.withColumn("__run", F.sum((~blank).cast("int")).over(Window.partitionBy(key).orderBy(pos)))
    k = F.sum(blank.cast("int")).over(Window.partitionBy(key, "__run").orderBy(pos))
    return d.withColumn("keep", ~blank | (k <= most)).drop("__run")


def run_ids(df: DataFrame, partition: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """Run-length groups: a new run whenever ``value`` changes, so a value that returns starts
    another run."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    return df.withColumn(name, F.sum(F.when(first, 0).otherwise(new)).over(w))


def running_offset(length: Column, partition: list, order: list) -> Column:
    """Start of each record: the sum of the lengths before it."""
    return F.sum(length).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - length


#: Rows that a bucket of a global order holds on average, and buckets at most (larger tables have larger buckets).
BUCKET_ROWS, BUCKETS = 65_536, 1024


def distributed_offsets(df: DataFrame, key: str, length: str, name: str = "start", rows: int = BUCKET_ROWS) -> DataFrame:
    """Start of each record in one global stream ordered by ``key`` (null first), without a
    single-partition window: bucket sums are added up first, records within buckets second.

    Buckets lie between quantiles of the key, about ``rows`` records each. Records with one key
    share a bucket, and follow one another in no set order but by length; null lengths count
    as 0.
    """
    size = F.coalesce(F.col(length), F.lit(0))
    n = df.count()
    parts = max(1, min(BUCKETS, -(-n // rows)))
    bounds = [] if parts == 1 else sorted(set(df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))
    at = F.lit(0)
    if bounds:  # number of bounds below the key
        at = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda x: x < F.col(key)))
    d = df.withColumn("__b", at.cast("long"))
    base = d.groupBy("__b").agg(F.sum(size).alias("__n")).withColumn("__base", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n"))
    order = Window.partitionBy("__b").orderBy(F.col(key).asc_nulls_first(), length).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__in", F.sum(size).over(order) - size)
    return d.join(F.broadcast(base.select("__b", "__base")), "__b").withColumn(name, F.col("__base") + F.col("__in")).drop("__b", "__in", "__base")


#: Counts by range and group up to this many (some 2 MB) are broadcast; more are joined by shuffle.
RANGE_COUNTS = 20_000


def numbered(df: DataFrame, by: list[str], order: list[str], place: str = "n", of: str | None = None, length: str | None = None, start: str = "start") -> DataFrame:
    """Adds ``place``, a row's number (from 1) among the rows with its ``by``; ``of``, how many these
    are; and with ``length`` the sum of it over the rows before (``start``, a null length counts 0).

    No group is gathered, however few there are: rows are sorted by range over ``by`` and ``order``
    (nulls first), ranges cut groups, and what lies before a range is a running sum over a row for
    each range and group in it. Rows that are alike in both follow one another in no set order.
    """
    from ..session import scratch_path

    spark, given, p = df.sparkSession, df.columns, "__"
    while any(c.startswith(p) for c in given):
        p += "_"
    name = lambda c: p + c
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)] + [F.col(name("tie"))]
    at = F.monotonically_increasing_id()
    d = df.withColumn(name("tie"), at).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop(name("tie"))
    size = F.coalesce(F.col(length), F.lit(0)) if length else F.lit(0)
    inside = Window.partitionBy(name("part"), *by).orderBy(name("at"))  # a range's share of a group
    d = d.select("*", F.shiftright(at, 33).alias(name("part")), at.bitwiseAND((1 << 33) - 1).alias(name("at")), size.alias(name("size")))
    path = scratch_path(spark, "numbered")
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)
    counts = d.groupBy(name("part"), *by).agg(F.count(F.lit(1)).alias(name("here")), F.min(name("at")).alias(name("first")), F.sum(name("size")).alias(name("sum")))
    group = Window.partitionBy(*(F.col(c) for c in by)) if by else Window.partitionBy(F.lit(0))
    before = lambda c: F.sum(c).over(group.orderBy(name("part"))) - F.col(c)
    counts = counts.select(F.col(name("part")).alias(name("p")), *(F.col(c).alias(name(f"by{i}")) for i, c in enumerate(by)), name("first"), before(name("here")).alias(name("rows")), before(name("sum")).alias(name("base")), F.sum(name("here")).over(group).alias(name("all")))
    met = F.col(name("part")) == F.col(name("p"))
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(name(f"by{i}")))
    few = counts.limit(RANGE_COUNTS + 1).collect()  # as many as there are ranges, and groups besides
    if len(few) <= RANGE_COUNTS:
        counts = F.broadcast(spark.createDataFrame(few, counts.schema))
    d = d.join(counts, met)
    out = [(F.col(name("rows")) + F.col(name("at")) - F.col(name("first")) + 1).alias(place)]
    out += [F.col(name("all")).alias(of)] if of else []
    if length:
        run = F.sum(name("size")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(name("size"))
        out.append((F.col(name("base")) + run).alias(start))
    return d.select(*given, *out)


def contiguity_violations(df: DataFrame, partition: list[str], start: str, length: str, ident: str) -> DataFrame:
    """Records of an index that do not start where the last one ended, or repeat an id."""
    w = Window.partitionBy(*partition).orderBy(start)
    gap = F.coalesce(F.lag(F.col(start) + F.col(length)).over(w), F.lit(0)) != F.col(start)
    twice = F.count(F.lit(1)).over(Window.partitionBy(ident)) > 1
    return df.withColumn("gap", gap).withColumn("duplicate", twice).filter("gap or duplicate")


def merge_adjacent(df: DataFrame, partition: list[str], start: str, end: str, value: str) -> DataFrame:
    """Consecutive rows of one value as one range: partition columns, value, start, end. Rows of a
    run keep their distance between their numbers in the partition and among its rows of the value."""
    d = numbered(numbered(df, partition, [start], "__all"), [*partition, value], [start], "__own")
    run = (F.col("__all") - F.col("__own")).alias("__run")
    return d.groupBy(*partition, value, run).agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__run")


def even_selection(df: DataFrame, by: list[str], order: list[str], count: int) -> DataFrame:
    """Rows ``i * rows // count`` of each group, for ``i`` (added) from 0 to ``count - 1``; a group
    of fewer rows gives some of them more than once."""
    d = numbered(df, by, order, "__n", "__of")
    first = lambda k: F.ceil(k * count / F.col("__of"))  # noqa: E731  of the i that fall on row k or later
    picks = F.when(first(F.col("__n") - 1) < first(F.col("__n")), F.sequence(first(F.col("__n") - 1), first(F.col("__n")) - 1))
    return d.withColumn("i", F.explode(picks)).drop("__n", "__of")


def linspace_starts(a: Column, b: Column, n: int) -> Column:
    """``n`` evenly spaced starts from ``a`` to ``b``, truncated."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(a + i * (b - a) / F.lit(float(max(1, n - 1)))).cast("long"))


def integer_starts(choices: Column, n: int) -> Column:
    """``n`` evenly spaced starts by integer division."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.expr("1") * F.floor(i * (choices - 1) / F.lit(max(1, n - 1))).cast("long"))


def roster(df: DataFrame, order: str, length: str, budget: int) -> DataFrame:
    """Records visited in order, again and again, until ``budget`` targets are met: adds epoch,
    start (of the visit) and take (the last visit may be partial). Closed form: the epoch is
    where the record's cumulative length falls."""
    total = df.agg(F.sum(length)).first()[0] or 0
    if total == 0:
        return df.limit(0).select("*", F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("take"))
    epochs = -(-budget // total)
    at = distributed_offsets(df, order, length, name="__at")
    out = at.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("start", F.col("epoch") * F.lit(total).cast("long") + F.col("__at"))
    return out.withColumn("take", F.least(F.col(length).cast("long"), F.lit(budget) - F.col("start"))).filter("take > 0").drop("__at")


def pack_segments(df: DataFrame, start: str, length: str, context: int) -> DataFrame:
    """Stretches cut at window bounds: adds pack, offset (in the pack), piece (its length) and
    from_token (where in the record the piece starts)."""
    first, last = F.floor(F.col(start) / context), F.floor((F.col(start) + F.col(length) - 1) / context)
    d = df.filter(F.col(length) > 0).withColumn("pack", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col(start), F.col("pack") * context)
    hi = F.least(F.col(start) + F.col(length), (F.col("pack") + 1) * context)
    return d.select("*", (lo - F.col("pack") * context).alias("offset"), (hi - lo).alias("piece"), (lo - F.col(start)).alias("from_token"))


def best_so_far(df: DataFrame, partition: list[str], step: str, loss: str, least: float = 0.0) -> DataFrame:
    """Adds best (running minimum) and improved (strictly better than all before by over ``least``)."""
    w = Window.partitionBy(*partition).orderBy(step)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("improved", before.isNull() | (F.col(loss) < before - least)).withColumn("best", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def early_stop(df: DataFrame, partition: list[str], step: str, loss: str, patience: int, least: float) -> DataFrame:
    """First step of each partition with ``patience`` reports since the last improvement."""
    d = best_so_far(df, partition, step, loss, least)
    w = Window.partitionBy(*partition).orderBy(step)
    n = F.row_number().over(w)
    d = d.withColumn("__n", n)
    since = F.col("__n") - F.last(F.when(F.col("improved"), F.col("__n")), ignorenulls=True).over(w)
    return d.withColumn("__since", since).filter(F.col("__since") >= patience).groupBy(*partition).agg(F.min(step).alias("stop_step"))


def round_robin(df: DataFrame, group: str, order: list[str], limit: int | None = None, block: int = 1) -> DataFrame:
    """Rows dealt group by group, ``block`` at a time, with their rank in the deal."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    d = df.withColumn("__r", F.floor((n - 1) / block)).withColumn("__i", n)
    out = d.orderBy("__r", group, "__i")
    return (out.limit(limit) if limit is not None else out).drop("__i").withColumnRenamed("__r", "deal")


def first_per_key(df: DataFrame, key: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def cyclic_window(stream: Column, start: Column, length: int, fill: int = -100, total: Column | None = None) -> Column:
    """``length`` items from ``start``, wrapping round; positions past ``total`` are filled."""
    size = F.size(stream)
    pick = lambda i: F.get(stream, F.pmod(start + i, size).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(i < (total if total is not None else F.lit(length)), pick(i)).otherwise(fill))


def mask_between(tokens: Column, on: int, off: int) -> Column:
    """True after an ``on`` marker up to and including the next ``off`` marker."""
    start = F.struct(F.lit(False).alias("live"), F.expr("cast(array() as array<boolean>)").alias("out"))
    step = lambda a, t: F.struct(F.when(t == on, True).when(t == off, False).otherwise(a["live"]).alias("live"), F.concat(a["out"], F.array(a["live"])).alias("out"))
    return F.aggregate(tokens, start, step, lambda a: a["out"])


def context_pad(arr: Column, n: int, fill) -> Column:
    """For each place, the ``n`` items before it, padded on the left."""
    padded = F.concat(F.array_repeat(F.lit(fill), n), arr)
    return F.transform(arr, lambda x, i: F.slice(padded, i + 1, n))
