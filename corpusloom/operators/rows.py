"""Account rows: facts, names, slots, minds, exchanges, batches, and their scoring."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .generate import hash_int, pick
from .sides import side


def mask_facts(text: Column, facts: Column) -> Column:
    """Values of ``facts`` (name, value structs) replaced by ``{name}``, longest first, ignoring case."""
    order = F.array_sort(facts, lambda a, b: F.coalesce(F.nullif(F.length(b["value"]) - F.length(a["value"]), F.lit(0)), F.when(a["name"] < b["name"], -1).otherwise(1)))
    quoted = lambda v: F.concat(F.lit("(?i)\\Q"), v, F.lit("\\E"))
    return F.aggregate(order, text, lambda t, f: F.regexp_replace(t, quoted(f["value"]), F.concat(F.lit("{"), f["name"], F.lit("}"))))


def required_facts(masked: Column) -> Column:
    """Names of the slots in a masked text."""
    return F.regexp_extract_all(masked, F.lit(r"\{(\w+)\}"), F.lit(1))


def _full_names(text: str, names: list[str]) -> str:
    first = [n.split()[0] for n in names]
    known = {f: n for f, n in zip(first, names) if first.count(f) == 1} | {n: n for n in names}
    if not known:
        return text
    any_name = "|".join(re.escape(n) for n in sorted(known, key=len, reverse=True))
    return re.sub(rf"(?<!\w)(?:{any_name})(?!\w)", lambda m: known[m[0]], text)


@F.arrow_udf(T.StringType())
def full_names(text: pa.Array, names: pa.Array) -> pa.Array:
    """First names that only one of ``names`` has become that full name."""
    return pa.array([None if t is None else _full_names(t, [n for n in ns or [] if len(n.split()) > 1]) for t, ns in zip(text.to_pylist(), names.to_pylist())])


def render_fields(template: Column, fields: Column) -> Column:
    """Numbered slots filled with fields that may be spoken; others stay literal."""
    pairs = F.transform(fields, lambda f, i: F.struct(f["text"].alias("v"), i.alias("i"), f["spoken"].alias("ok")))
    return F.aggregate(F.filter(pairs, lambda p: p["ok"]), template, lambda t, p: F.replace(t, F.concat(F.lit("{"), p["i"].cast("string"), F.lit("}")), p["v"]))


def fill_actor_place(template: Column, fields: Column) -> Column:
    """First field of role 1 and of role 3, or the defaults."""
    first = lambda role, default: F.coalesce(F.get(F.filter(fields, lambda f: f["role"] == role), F.lit(0))["text"], F.lit(default))
    return F.replace(F.replace(template, F.lit("{actor}"), first(1, "raiders")), F.lit("{place}"), first(3, "the towns"))


def turn_rows(turns: DataFrame, key: str, order: str, text: str, most: int = 4) -> DataFrame:
    """Exchanges: each turn with its last ``most`` turns and who said them, seen from the
    speaker: key, order, output, history (speaker, text)."""
    w = Window.partitionBy(key).orderBy(order)
    d = turns.withColumn("__n", F.row_number().over(w))
    back = F.collect_list(F.struct(F.col("__n").alias("n"), F.col(text).alias("text"))).over(w.rowsBetween(-most, -1))
    said = F.transform(back, lambda m: F.struct(F.when(m["n"] % 2 == F.col("__n") % 2, "self").otherwise("other").alias("speaker"), m["text"].alias("text")))
    return d.select(key, order, F.col(text).alias("output"), said.alias("history"))


def bridged(rows: DataFrame, key: str, voices: list[str], goals: list[str], levels: list[str]) -> DataFrame:
    """Rows under a drawn mind: voice, goal, stress and courage by hash of the key."""
    k = lambda name: F.concat(F.lit(name + ":"), F.col(key).cast("string"))
    mind = F.struct(pick(goals, k("goal")).alias("goal"), pick(levels, k("stress")).alias("stress"), pick(levels, k("courage")).alias("courage"))
    return rows.withColumn("voice", pick(voices, k("voice"))).withColumn("mind", mind)


def marks(table: dict[tuple[str, bool, str], list[str]], move: Column, state: dict[str, Column]) -> Column:
    """Opening sentences of a predicament: those of the cell (axis, value, move) that holds,
    else one empty string."""
    out = F.array(F.lit(""))
    for (axis, value, of), sentences in reversed(table.items()):
        hit = (move == of) & (state[axis] == value)
        out = F.when(F.coalesce(hit, F.lit(False)), F.array(*(F.lit(s) for s in sentences))).otherwise(out)
    return out


def with_cell(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted wordings of a row's cell, from a phrase table."""
    return rows.join(side(cells), keys, "left")


def hash_act(seed: str, key: Column, acts: int) -> Column:
    """Act of a row by SHA-256 of seed and key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % acts


def rehearsal(rows: DataFrame, covered: DataFrame, rule: str) -> DataFrame:
    """Rows, and a response beside each whose rule is not covered: adds response (boolean)."""
    base = rows.withColumn("response", F.lit(False))
    return base.unionByName(rows.join(covered.select(rule).distinct(), rule, "left_anti").withColumn("response", F.lit(True)))


def mixed_batches(rows: DataFrame, source: str, order: list, counts: dict[str, int]) -> DataFrame:
    """Batches of fixed composition: adds batch. Each source fills its places in order; batches
    that a source can no longer fill are dropped."""
    take = F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))
    n = F.row_number().over(Window.partitionBy(source).orderBy(*order)) - 1
    d = rows.filter(F.col(source).isin(*counts)).withColumn("batch", F.floor(n / take[F.col(source)]))
    full = d.groupBy(source).agg(F.floor(F.count(F.lit(1)) / F.first(take[F.col(source)])).alias("n")).agg(F.min("n").alias("__full"), F.count(F.lit(1)).alias("__s"))
    return d.crossJoin(F.broadcast(full)).filter((F.col("batch") < F.col("__full")) & (F.col("__s") == len(counts))).drop("__full", "__s")


def reference_scores(rows: DataFrame, by: list[str], text: str, reference: str, names: str) -> DataFrame:
    """Exact matches and texts with all names, per group."""
    every = F.forall(names, lambda n: F.contains(F.col(text), n))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(text) == F.col(reference)).alias("exact"), F.count_if(every).alias("all_names"))


def history_pairs(rows: DataFrame, pair: str, side: str, text: str, approved: str) -> DataFrame:
    """Paired counterfactual histories: per pair, whether both were approved and whether the
    response changed."""
    a, b = rows.filter(F.col(side) == 0).alias("a"), rows.filter(F.col(side) == 1).alias("b")
    j = a.join(b, F.col(f"a.{pair}") == F.col(f"b.{pair}"))
    return j.select(F.col(f"a.{pair}").alias(pair), (F.col(f"a.{approved}") & F.col(f"b.{approved}")).alias("both"), (F.col(f"a.{text}") != F.col(f"b.{text}")).alias("changed"))


def replacement_pool(rows: DataFrame, role: str, value: str) -> DataFrame:
    """Distinct values of each role, sorted."""
    return rows.groupBy(role).agg(F.sort_array(F.collect_set(value)).alias("pool"))


def run_pair_faults(runs: DataFrame, pair: str, arm: str, fields: list[str]) -> DataFrame:
    """Fields that differ between the two arms of a pair (nulls are equal)."""
    a, b = (runs.filter(F.col(arm) == k).alias(k) for k in ("B", "C"))
    j = a.join(b, F.col(f"B.{pair}") == F.col(f"C.{pair}"))
    wrong = F.array(*(F.when(~F.col(f"B.{f}").eqNullSafe(F.col(f"C.{f}")), F.lit(f)) for f in fields))
    return j.select(F.col(f"B.{pair}").alias(pair), F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("field"))


def drawn(options: Column, key: Column) -> Column:
    """One item of an array by hash."""
    return F.get(options, (hash_int(key) % F.size(options)).cast("int"))
