"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import free_prefix, identified, materialize, path_of, remove, scratch, small, table
from corpusloom.llm.exact_dedup import exact_groups
from corpusloom.llm.langid import fit, identify
from corpusloom.llm.mixing import mixed_rows
from corpusloom.llm.packing import pack
from corpusloom.llm.queries import tokenizer
from corpusloom.llm.simhash import near_duplicates

#: Dropped rows up to this many (some 40 MB) are broadcast to the texts; more are joined by shuffle.
DROPPED = 500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language. Those that are null, empty or without a letter are rejected; null
    ids, repeated rows and very long texts are documents like any other, texts between two languages
    stay. No documents give none; other columns, of any name, are kept."""
    said = identify(docs, fit(docs), keep=True)
    return said.filter(F.col(said.columns[len(docs.columns)]) != "und").select(*said.columns[: len(docs.columns)])


def _staying(docs: DataFrame, dropped: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``docs`` but for the rows that ``dropped(rows, key)`` names in its column doc_id. The key is
    doc_id and, for tables that repeat it, the row's file and place; its name and those beside it
    are none that ``docs`` has."""
    p = free_prefix(docs.columns)
    row, key = f"{p}row", f"{p}key"
    rows = identified(docs, row)
    rows = rows.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.col(row)["file"].alias("file"), F.col(row)["at"].alias("at")))
    gone = dropped(rows, key).select(F.col("doc_id.file").alias(f"{p}file"), F.col("doc_id.at").alias(f"{p}at"))
    gone = materialize(gone, "dropped")
    met = (F.col(row)["file"] == F.col(f"{p}file")) & (F.col(row)["at"] == F.col(f"{p}at"))
    return rows.join(small(gone, gone.count(), DROPPED), met, "left_anti").select(*(rows[c] for c in docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A to Z the row with the largest doc_id stays, of repeated
    ids the last by file and place, a null id only where no other is. Null and empty texts are equal.
    No documents give none; other columns, of any name, are kept."""
    return _staying(docs, lambda rows, key: exact_groups(rows, doc_id=key).filter("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row with the smallest doc_id stays: a null id before any other,
    of repeated ids the first by file and place. Texts without words are one component. No documents
    give none; other columns, of any name, are kept."""
    return _staying(docs, lambda rows, key: near_duplicates(rows, doc_id=key).filter("doc_id <> component_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents of scarce sources repeat, at most three times. A
    null source is a source; null texts have no words and go with their place in the order; equal ids
    go by size, then file and place. No documents give none; other columns, of any name, are kept."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows at the mix's proportions; columns, nulls, repeated rows and very long texts as
    in :func:`pack`."""
    return pack(docs, tokenizer())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. When a stage is written, the tables that it read and made are removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        remove(spark, [p for p in (path_of(docs), *made) if p and p != path_of(kept)])
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
