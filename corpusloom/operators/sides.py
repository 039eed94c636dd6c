"""Sides of joins that are broadcast only when they have been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that goes to every task, at most.
SIDE_ROWS = 100_000


def side(df: DataFrame, limit: int = SIDE_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has no more than ``limit`` rows; the planner joins it by
    shuffle otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fixed_side(df: DataFrame, what: str, limit: int = SIDE_ROWS) -> DataFrame:
    """``df`` for a join without a key: a table of a fixed size, which raises beyond ``limit``."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"{what} has more than {limit} rows: use an operator that works in blocks")
    return F.broadcast(df)
