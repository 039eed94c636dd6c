"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


from . import q01_packing, q02_chat, q03_langid, q04_mixing, q05_sharding, q06_exact_dedup, q07_license_scan  # noqa: E402, F401
from . import q08_simhash, q09_warc, q10_ann, q11_hard_negatives, q12_merkle, q13_bin_completion  # noqa: E402, F401
