"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. ``edges`` are (a, b) with a < b. Each node u links its larger (large-star)
    or smaller (small-star) neighbours, and itself, to the smallest of its neighbourhood."""
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        both = both.union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(low, "u")
    if large:
        moved = linked.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        moved = linked.select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.filter("a < b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (long columns a, b); root is the smallest
    node that can be reached.

    Each step is a shuffle of the links alone and ends in a written table, so lineage stays
    short; the count of steps is about the logarithm of the longest path. Neighbours are
    never gathered: hubs meet as a minimum with map-side combination and a join whose large
    side adaptive execution may split.
    """
    now = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        large = materialize(_star(now, True), "links")
        after = materialize(_star(large, False), "links")
        seen = after.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        discard(now)
        discard(large)
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
