"""Counterfactual pairs over rules, with partial knowledge and distractors.

A row gets a rule, a value for each of the rule's roles, a teller (how sure, whether retold) and
perhaps an earlier account that has nothing to do with it. Its pair tells the account twice, and the
second time one field has another value, all else equal. All draws are hashes of the row's key, so
any task makes any pair, and again the same one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_suffix, capitalise, cue_prefix
from .generate import hash_int

#: Roles that are no names: they are neither shortened nor swapped.
PLAIN = ("quantity", "detail", "material")
#: Bytes of an account, the most and the fewest characters of a name in it.
ACCOUNT_BYTES, NAME_MOST, NAME_LEAST = 143, 20, 6


@dataclass(frozen=True)
class Rule:
    """An account's grammar: its roles, its source with ``{0}``, ``{1}``, … for them, two outputs,
    whether its actor may be unknown, and (left, right) fields whose quantities must rise."""

    name: str
    roles: tuple[str, ...]
    source: str
    outputs: tuple[str, str]
    partial: bool = False
    less_than: tuple[int, int] | None = None

    def named(self) -> list[int]:
        return [j for j, r in enumerate(self.roles) if r not in PLAIN]

    def limit(self, values: Column) -> Column:
        """Characters that a name may have for the account to fit."""
        bare = rendered(F.lit(self.source), F.transform(values, lambda v, i: F.when(i.isin(*self.named()), F.lit("")).otherwise(v)), len(self.roles))
        room = F.floor((F.lit(ACCOUNT_BYTES) - F.octet_length(bare)) / max(1, len(self.named()))).cast("int")
        return F.least(F.lit(NAME_MOST), room)


def rendered(template: Column, values: Column, slots: int) -> Column:
    """A template with its slots filled."""
    for j in range(slots):
        template = F.replace(template, F.lit("{%d}" % j), F.coalesce(F.get(values, F.lit(j)), F.lit("")))
    return template


def _drawn(key: Column, what: str, n) -> Column:
    return (hash_int(F.concat_ws(":", F.lit(what), key.cast("string"))) % n).cast("int")


def _value(role: str, key: Column, what: str, pools: dict[str, list[str]]) -> Column:
    if role == "quantity":
        return (_drawn(key, what, 198) + 2).cast("string")
    pool = pools[role]
    return F.get(F.array(*(F.lit(p) for p in pool)), _drawn(key, what, len(pool)))


def _values(rule: Rule, key: Column, what: str, pools: dict) -> list[Column]:
    return [_value(r, key, f"{what}{j}", pools) for j, r in enumerate(rule.roles)]


def rule_pairs(rows: DataFrame, key: str, rules: list[Rule], pools: dict[str, list[str]]) -> DataFrame:
    """Two members for each row: pair, member, rule, prefix, output, changed, unknown (fields, from
    0), confidence, retold, distracted.

    Rules go round by the key. A rule that allows it leaves its first actor unknown in one of seven
    pairs: then both source and output say ``someone``, and that field is never the one that
    changes. Names are cut so that the account fits its bytes; a grammar that leaves a name fewer
    than six characters raises. Two pairs of three begin with an account of another rule. Rows with
    a null key are left out; repeated keys give the same pair again.
    """
    k = F.col("k")
    d = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"))
    n = len(rules)
    built = []
    for at, rule in enumerate(rules):
        values = _values(rule, k, "value", pools)
        if rule.less_than:
            left, right = rule.less_than
            values[right] = (values[left].cast("int") + 1 + _drawn(k, "more", 29)).cast("string")
        actor = next((j for j, r in enumerate(rule.roles) if r == "actor"), None)
        unknown = F.when(_drawn(k, "unknown", 7) == 0, F.lit(actor)) if rule.partial and actor is not None else F.lit(None).cast("int")
        earlier = rules[(at + 7) % n]
        distractor = rendered(F.lit(earlier.outputs[0]), F.array(*_values(earlier, k, "earlier", pools)), len(earlier.roles))
        built.append((F.array(*values), unknown, distractor, rule))
    turn = F.pmod(k, F.lit(n))

    def by_rule(of) -> Column:
        out = F.when(turn == 0, of(*built[0]))
        for i, b in enumerate(built[1:], 1):
            out = out.when(turn == i, of(*b))
        return out

    d = d.select("k", by_rule(lambda v, *_: v).alias("drawn"), by_rule(lambda v, u, *_: u).cast("int").alias("unknown"), by_rule(lambda v, u, e, r: e).alias("earlier"))
    named = by_rule(lambda v, u, e, r: F.array(*(F.lit(j) for j in r.named())).cast("array<int>"))
    d = d.withColumn("most", by_rule(lambda v, u, e, r: r.limit(F.col("drawn")))).withColumn("named", named)
    d = d.filter(F.assert_true(F.col("most") >= NAME_LEAST, F.lit("the grammar leaves too little space for names")).isNull())
    cut = lambda c: F.rtrim(F.left(c, F.col("most")))
    d = d.withColumn("values", F.transform("drawn", lambda v, j: F.when(F.array_contains("named", j), cut(v)).otherwise(v)))
    d = d.withColumn("free", F.filter("named", lambda j: ~j.eqNullSafe(F.col("unknown"))))
    d = d.withColumn("changed", F.when(F.size("free") > 0, F.get("free", _drawn(k, "changed", F.greatest(F.lit(1), F.size("free"))))))
    # the role of the changed field decides the pool that its other value comes from
    pool = F.lit(None).cast("array<string>")
    for role, words in pools.items():
        of_role = by_rule(lambda v, u, e, r: F.array(*(F.lit(x) for x in r.roles)))
        pool = F.when(F.get(of_role, F.col("changed")) == role, F.array(*(F.lit(w) for w in words))).otherwise(pool)
    d = d.withColumn("others", F.filter(pool, lambda w: F.rtrim(F.left(w, F.col("most"))) != F.get("values", F.col("changed"))))
    other = F.rtrim(F.left(F.get("others", _drawn(k, "other", F.greatest(F.lit(1), F.size("others")))), F.col("most")))
    d = d.withColumn("other", other).withColumn("member", F.explode(F.array(F.lit(0), F.lit(1))))
    told = F.transform("values", lambda v, j: F.when((F.col("member") == 1) & (j == F.col("changed")), F.col("other")).otherwise(v))
    d = d.withColumn("told", F.transform(told, lambda v, j: F.when(j == F.col("unknown"), F.lit("someone")).otherwise(v)))
    sure = F.when(_drawn(k, "sure", 4) == 0, 20).otherwise(80)
    retold, form = _drawn(k, "retold", 3) == 0, _drawn(k, "form", 2)
    distracted = k % 3 != 0
    slots = max(len(r.roles) for r in rules)
    source = rendered(by_rule(lambda v, u, e, r: F.lit(r.source)), F.col("told"), slots)
    output = rendered(by_rule(lambda v, u, e, r: F.when(form == 0, r.outputs[0]).otherwise(r.outputs[1])), F.col("told"), slots)
    context = F.when(distracted, F.concat(F.lit("- "), "earlier", F.lit("\n"))).otherwise("")
    prefix = F.concat(context, F.lit("- "), cue_prefix(source, sure, F.when(retold, 4).otherwise(0)), F.lit("\n"))
    name = by_rule(lambda v, u, e, r: F.lit(r.name))
    return d.select(k.alias("pair"), "member", name.alias("rule"), prefix.alias("prefix"), answer_suffix(capitalise(output), sure, retold).alias("output"), "changed", "unknown", sure.alias("confidence"), retold.alias("retold"), distracted.alias("distracted"))
