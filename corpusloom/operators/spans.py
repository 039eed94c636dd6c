"""Text with typed spans, in UTF-8 byte offsets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def shift_spans(spans: Column, opener: Column) -> Column:
    """Spans moved behind an opener."""
    return F.transform(spans, lambda s: s.withField("start", s["start"] + F.octet_length(opener)))


def render_template(template: str, columns: list[str]) -> Column:
    """Struct of the rendered text and the byte span of each slot, in order of slots."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    cols = [F.col(p[1:-1]).cast("string") if p[0] == "{" else F.lit(p) for p in parts]
    spans = []
    for i, p in enumerate(parts):
        if p[0] == "{":
            if p[1:-1] not in columns:
                raise ValueError(f"unknown slot {p}")
            start = reduce(lambda a, c: a + F.octet_length(c), cols[:i], F.lit(0))
            spans.append(F.struct(F.lit(p[1:-1]).alias("field"), start.alias("start"), (start + F.octet_length(cols[i])).alias("end"), cols[i].alias("text")))
    return F.struct(F.concat(*cols).alias("text"), F.array(*spans).alias("spans"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Text between two byte offsets."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")


def replace_fields(text: Column, spans: Column, values: Column) -> Column:
    """Replace whole spans by ``values`` (a map by field), with offsets computed anew.

    ``spans`` are (field, start, end) in byte offsets, ordered and apart; an overlap raises.
    """
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.expr("cast(array() as array<struct<field: string, start: int, end: int>>)").alias("spans"))

    def step(acc, s):
        value = F.coalesce(F.element_at(values, s["field"]), byte_slice(text, s["start"], s["end"]))
        head = F.concat(acc["text"], byte_slice(text, acc["at"], s["start"]))
        ok = F.when(s["start"] >= acc["at"], head).otherwise(F.raise_error(F.lit("spans overlap")))
        span = F.struct(s["field"].alias("field"), F.octet_length(head).alias("start"), (F.octet_length(head) + F.octet_length(value)).alias("end"))
        return F.struct(F.concat(ok, value).alias("text"), s["end"].cast("int").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    tail = lambda acc: F.struct(F.concat(acc["text"], byte_slice(text, acc["at"], F.octet_length(text))).alias("text"), acc["spans"].alias("spans"))
    return F.aggregate(spans, start, step, tail)


def fill_slots(template: Column, values: Column) -> Column:
    """Numbered slots ``{0}``, ``{1}``, ... filled from an array; others stay as they are."""
    return F.aggregate(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), template, lambda t, x: F.replace(t, F.concat(F.lit("{"), x["i"].cast("string"), F.lit("}")), x["v"]))
