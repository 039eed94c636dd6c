"""Review votes: validation, effective votes, tallies, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .splits import violations
from .stats import wilson

CHOICES = ("A", "B", "skip", "withdraw")


def invalid_votes(votes: DataFrame, packet: str) -> DataFrame:
    """(event_id, rule) of every broken rule of a vote log."""
    charset = "^[A-Za-z0-9_-]{1,80}$"
    rules = {
        "event_id": F.col("event_id").rlike(charset),
        "reviewer_id": F.col("reviewer_id").rlike(charset),
        "packet": F.col("packet_id") == packet,
        "case": F.col("case_id") >= 0,
        "choice": F.col("choice").isin(*CHOICES),
    }
    return violations(votes, ["event_id"], rules)


def effective_votes(votes: DataFrame) -> DataFrame:
    """First occurrence of each event id, then the last choice per packet, reviewer and case in
    order of arrival; withdrawn ones are gone. Columns: packet_id, reviewer_id, case_id, choice."""
    once = votes.withColumn("__n", F.row_number().over(Window.partitionBy("event_id").orderBy("arrival"))).filter("__n = 1")
    last = once.groupBy("packet_id", "reviewer_id", "case_id").agg(F.max_by("choice", "arrival").alias("choice"))
    return last.filter("choice <> 'withdraw'")


def tally(effective: DataFrame, by: list[str]) -> DataFrame:
    """Picks of A and B, skips and reviewers."""
    return effective.groupBy(*by).agg(F.count_if(F.col("choice") == "A").alias("a"), F.count_if(F.col("choice") == "B").alias("b"), F.count_if(F.col("choice") == "skip").alias("skips"), F.countDistinct("reviewer_id").alias("reviewers"))


def gates(effective: DataFrame, cases: int = 200, decisive: int = 160, wins: int = 120) -> DataFrame:
    """One row: reviewed, decisive and won cases against a fixed denominator, and the Wilson
    interval of wins among decisive cases."""
    d = effective.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("choice").isin("A", "B")).alias("decisive"), F.count_if(F.col("choice") == "A").alias("wins"))
    w = wilson(F.col("wins").cast("double"), F.col("decisive").cast("double"))
    return d.select("*", (F.col("wins") / cases).alias("share"), w["low"].alias("low"), w["high"].alias("high"), ((F.col("reviewed") == cases) & (F.col("decisive") >= decisive) & (F.col("wins") >= wins)).alias("passed"))
