"""Vocabularies, token arrays and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def char_vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(ch, id): distinct characters in byte order. One row per character of the alphabet."""
    seen = docs.select(F.explode(F.array_distinct(F.split(text, ""))).alias("ch")).filter("ch <> ''").distinct()
    return seen.select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).cast("long").alias("id"))


def encode_characters(docs: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ids): ids of every character. The alphabet travels to the documents as one array
    of ids by code point (1.1 million places at most), so a lookup is one step."""
    by_code = F.map_from_entries(F.collect_list(F.struct(F.ascii("ch"), "id")))
    one = vocabulary.agg(by_code.alias("m"), F.max(F.ascii("ch")).alias("top")).filter("top is not null")
    table = one.select(F.transform(F.sequence(F.lit(0), "top"), lambda i: F.try_element_at("m", i)).alias("of"))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return docs.crossJoin(F.broadcast(table)).select(key, F.transform(chars, lambda c: F.get("of", F.ascii(c))).alias("ids"))


def masked_labels(ids: Column, prefix: Column, ignore: int = -100) -> Column:
    """``ids`` with ``ignore`` over the first ``prefix`` places."""
    return F.transform(ids, lambda x, i: F.when(i < prefix, F.lit(ignore)).otherwise(x))


def pad_to(arr: Column, width: Column, fill: Column) -> Column:
    """Ragged arrays as a rectangle."""
    return F.concat(arr, F.array_repeat(fill, F.greatest(F.lit(0), width - F.size(arr)).cast("int")))
