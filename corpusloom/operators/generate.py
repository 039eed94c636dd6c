"""Row generation: hash draws, grids, phrase products, counterfactual pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_int(key: Column, digits: int = 8) -> Column:
    """Non-negative integer from the first hex digits of an MD5."""
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("long")


def uniform(key: Column) -> Column:
    """Uniform double in [0, 1) from a key: the same in every run and on every machine."""
    return hash_int(key, 13).cast("double") / float(1 << 52)


def pick(options: list[str], key: Column) -> Column:
    """One of ``options`` by hash."""
    return F.get(F.array(*(F.lit(o) for o in options)), (hash_int(key) % len(options)).cast("int"))


def weighted_draw(rows: DataFrame, key: Column, ranges: DataFrame, name: str, size: str) -> DataFrame:
    """Each row with a ``name`` drawn in proportion to ``size``: a hash draw falls into one of
    the cumulative ranges. ``ranges`` has a row per choice and is searched as one sorted array."""
    cum = ranges.withColumn("__hi", F.sum(size).over(Window.orderBy(name)))
    one = cum.agg(F.sort_array(F.collect_list(F.struct("__hi", name))).alias("__all"), F.max("__hi").alias("__total"))
    u = F.pmod(hash_int(key), F.col("__total"))
    hit = F.filter("__all", lambda r: r["__hi"] > F.col("__u"))
    return rows.crossJoin(F.broadcast(one)).withColumn("__u", u).withColumn(name, hit[0][name]).drop("__all", "__total", "__u")


def grid(spark, **axes) -> DataFrame:
    """Cross product of small axes."""
    out = None
    for name, values in axes.items():
        d = spark.createDataFrame([(v,) for v in values], [name])
        out = d if out is None else out.crossJoin(d)
    return out


def cyclic(i: Column, r: Column, step: int, n: int) -> Column:
    """Cyclic assignment: half the row number plus a stride per repeat, modulo ``n``."""
    return (F.floor(i / 2) + r * step) % n


def products(first: Column, second: Column) -> Column:
    """All joins of an item of one array with an item of another, first array outermost."""
    return F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.concat(a, b))))


def accepted_forms(templates: Column, values: Column, endings: Column) -> Column:
    """Distinct sentences: templates filled, capitalised, with each ending."""
    from ..functions.text import capitalise
    from .spans import fill_slots

    stem = F.transform(templates, lambda t: F.regexp_replace(capitalise(fill_slots(t, values)), r"[.!?]$", ""))
    return F.array_distinct(products(stem, endings))


def tier(confidence: Column, retold: Column) -> Column:
    """How sure a speaker is: rumour, hearsay or witness."""
    return F.when(confidence < 40, "rumour").when(retold, "hearsay").otherwise("witness")


def counterfactual_pairs(rows: DataFrame, key: str, field: str, pool: list[str]) -> DataFrame:
    """Two members per row that differ in one field: the row's own value and another of the pool.

    Adds pair, member (0 or 1) and changed_from, changed_to.
    """
    options = F.filter(F.array(*(F.lit(p) for p in pool)), lambda p: p != F.col(field))
    other = F.get(options, (hash_int(F.concat_ws(":", F.lit("swap"), F.col(key).cast("string"))) % F.size(options)).cast("int"))
    d = rows.withColumn("pair", F.col(key)).withColumn("changed_from", F.col(field)).withColumn("changed_to", other)
    d = d.withColumn("member", F.explode(F.array(F.lit(0), F.lit(1))))
    return d.withColumn(field, F.when(F.col("member") == 0, F.col("changed_from")).otherwise(F.col("changed_to")))


def gumbel_top_k(df: DataFrame, group: list[str], item: str, log_weight: str, k: int) -> DataFrame:
    """``k`` draws without replacement per group, by weight: the largest of log weight plus a
    Gumbel noise from a hash of group and item."""
    u = uniform(F.concat_ws(":", *(F.col(g).cast("string") for g in group), F.col(item).cast("string")))
    noise = -F.ln(-F.ln(u + F.lit(1e-16)))
    w = Window.partitionBy(*group).orderBy(F.desc("__g"), item)
    d = df.withColumn("__g", F.round(F.col(log_weight) + noise, 9))
    return d.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= k).drop("__g")
