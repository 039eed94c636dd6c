"""Joins that have no operator of their own in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_ranges(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, partition: list[str] = (), block: int = 1 << 20) -> DataFrame:
    """Each point with the range that contains it (``start <= at < end``, ranges apart), or nulls.

    Points and range starts are merged in one order and the last start is carried forward, so
    the join is a sort within partitions, not a nested loop. The work spreads over the
    ``partition`` columns and over blocks of positions: a range takes part in every block that
    it reaches into.
    """
    given = points.columns
    partition = [*partition, "__block"]
    points = points.withColumn("__block", F.floor(F.col(at) / block))
    first, last = F.floor(F.col(start) / block), F.floor((F.col(end) - 1) / block)
    ranges = ranges.filter(F.col(end) > F.col(start)).withColumn("__block", F.explode(F.sequence(first, last)))
    extra = [c for c in ranges.columns if c not in (start, end, *partition)]
    keep = F.struct(F.col(start).alias("start"), F.col(end).alias("end"), *extra)
    r = ranges.select(*partition, F.col(start).alias("__at"), F.lit(0).alias("__k"), keep.alias("__r"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("__p"))
    p = points.select(*partition, F.col(at).alias("__at"), F.lit(1).alias("__k"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*points.columns).alias("__p"))
    both = r.unionByName(p)
    w = Window.partitionBy(*partition).orderBy("__at", "__k")
    out = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__k = 1")
    inside = F.col("__at") < F.col("__r.end")
    return out.select(*(F.col(f"__p.{c}").alias(c) for c in given), *(F.when(inside, F.col(f"__r.{c}")).alias(n) for c, n in [("start", start), ("end", end), *((c, c) for c in extra)]))


def first_reply(messages: DataFrame, thread: str, pos: str, ident: str, reply: str) -> DataFrame:
    """Adds parent_pos: place of the first earlier message of the thread whose id is the reply."""
    child = messages.filter(F.col(reply) != "").alias("c")
    parent = messages.alias("p")
    hit = child.join(parent, (F.col(f"c.{thread}") == F.col(f"p.{thread}")) & (F.col(f"c.{reply}") == F.col(f"p.{ident}")) & (F.col(f"p.{pos}") < F.col(f"c.{pos}")))
    first = hit.groupBy(F.col(f"c.{thread}").alias(thread), F.col(f"c.{pos}").alias(pos)).agg(F.min(f"p.{pos}").alias("parent_pos"))
    return messages.join(first, [thread, pos], "left")


def complete_pairs(df: DataFrame, pair: str, passed: str) -> DataFrame:
    """Per pair with both members: whether both passed."""
    g = df.groupBy(pair).agg(F.count(F.lit(1)).alias("members"), F.bool_and(passed).alias("both"))
    return g.filter("members = 2").drop("members")


def strict_lookup(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Inner join in which a key without partner raises instead of vanishing."""
    marked = other.withColumn("__found", F.lit(True))
    j = df.join(marked, key, "left")
    return j.filter(F.assert_true(F.col("__found").isNotNull(), F.lit("missing key")).isNull()).drop("__found")
