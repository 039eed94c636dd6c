"""Deterministic splits, leakage checks and hash-based assignment."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_bucket(value: Column, buckets: int, salt: str = "") -> Column:
    """First 8 hex digits of SHA-256(salt, NUL, value), modulo ``buckets``."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "\0") if salt else F.lit(""), value), 256), 1, 8), 16, 10).cast("bigint") % buckets


def author_split(group: Column, seed: str) -> Column:
    """train, validation or test by the author before the first pipe: 18, 1 and 1 of 20."""
    b = hash_bucket(F.get(F.split(group, r"\|", 2), F.lit(0)), 20, seed)
    return F.when(b == 0, "test").when(b == 1, "validation").otherwise("train")


def name_split(name: Column, known: Column | None = None) -> Column:
    """train below 8 of 10, then validation, then test; known names are always train."""
    b = hash_bucket(name, 10)
    split = F.when(b < 8, "train").when(b == 8, "validation").otherwise("test")
    return split if known is None else F.when(known, "train").otherwise(split)


def every_nth(df: DataFrame, partition: list, order: list, n: int = 20) -> DataFrame:
    """Adds ``valid``: every n-th row of the order, from the first."""
    from .sequence import numbered

    return numbered(df, partition, order, "__n").withColumn("valid", (F.col("__n") - 1) % n == 0).drop("__n")


def tail_split(df: DataFrame, partition: list, order: list, share: int = 20) -> DataFrame:
    """Adds ``held``: the last 1/share of the rows of each partition."""
    from .sequence import numbered

    d = numbered(df, partition, order, "__n", "__of")
    return d.withColumn("held", F.col("__n") > F.col("__of") - F.floor(F.col("__of") / share)).drop("__n", "__of")


def halves(df: DataFrame, partition: list, order: list) -> DataFrame:
    """Adds ``half``: selection for the first half of the rows of each partition, then outcome."""
    from .sequence import numbered

    d = numbered(df, partition, order, "__n", "__of")
    return d.withColumn("half", F.when(F.col("__n") <= F.floor(F.col("__of") / 2), "selection").otherwise("outcome")).drop("__n", "__of")


def split_leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split, with the splits."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def overlap(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct tuples present on both sides."""
    return a.select(*columns).intersect(b.select(*columns))


def blocked(df: DataFrame, against: DataFrame, key: Column, against_key: Column) -> DataFrame:
    """Rows whose key is not on the other side (left anti)."""
    right = against.select(against_key.alias("__k")).distinct()
    return df.withColumn("__k", key).join(right, "__k", "left_anti").drop("__k")


#: Grams of passages up to this many (some 100 MB) go to every task; more meet the documents' grams by shuffle.
GRAM_ROWS = 500_000


def passage_hits(df: DataFrame, key: str, text: Column, passages: DataFrame, passage_text: Column, n: int, limit: int = GRAM_ROWS) -> DataFrame:
    """(key, hits): distinct grams of a document that stand in a passage: passages of ``n`` words
    or more give all their ``n``-word grams, shorter ones their whole word sequence.

    A document is all rows of one key, and null is a key like any other; keys without a hit are
    left out. Within ``limit`` grams the documents are searched where they lie: a gram is only built
    where its first two words stand side by side. Beyond, grams of both sides meet in a join. Either
    way finds (key, gram) pairs, and the same aggregation counts them.
    """
    from ..functions.text import joined_ngrams, words

    p = passages.select(words(passage_text).alias("w")).filter(F.size("w") > 0)
    parts = F.when(F.size("w") < n, F.array(F.array_join("w", " "))).otherwise(joined_ngrams(F.col("w"), n))
    right = p.select(F.least(F.size("w"), F.lit(n)).alias("k"), F.explode(parts).alias("g")).distinct()
    if (count := right.count()) > limit:
        sizes = sorted(r[0] for r in right.select("k").distinct().collect())  # at most n of them
        grams = F.concat(*(joined_ngrams(F.col("w"), k) for k in sizes))
        left = df.select(F.col(key).alias("key"), words(text).alias("w")).select("key", F.explode(F.array_distinct(grams)).alias("g"))
        met = left.join(right.select("g"), "g")
    else:
        found = df.sparkSession.sparkContext.broadcast(_grams_by_head([tuple(r) for r in right.collect()] if count else []))
        schema = T.StructType([T.StructField("key", df.select(key).schema[key].dataType), T.StructField("found", T.ArrayType(T.LongType()))])

        def run(batches):
            for b in batches:
                hits = [_hits(t.as_py(), *found.value) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.int64()))], ["key", "found"])

        met = df.select(F.col(key).alias("key"), text.cast("string").alias("text")).mapInArrow(run, schema).filter(F.size("found") > 0).select("key", F.explode("found").alias("g"))
    return met.groupBy(F.col("key").alias(key)).agg(F.countDistinct("g").alias("hits"))


def _grams_by_head(grams: list[tuple[int, str]]):
    """({single word: number}, {first word: {second word: lengths}}, {gram: number})."""
    ones, heads, whole = {}, {}, {}
    for at, (k, g) in enumerate(grams):
        w = g.encode().split(b" ")
        if k == 1:
            ones[w[0]] = at
        else:
            heads.setdefault(w[0], {}).setdefault(w[1], set()).add(k)
            whole[b" ".join(w)] = at
    return ones, heads, whole


def _hits(text: str | None, ones: dict, heads: dict, whole: dict) -> list[int]:
    """Numbers of the grams that stand in a text."""
    w = (text or "").encode("utf-8", "surrogatepass").split()  # the same white space as the pattern's
    hit = {ones[x] for x in ones.keys() & set(w)} if ones else set()
    for i, first in enumerate(w[:-1]):
        if first in heads and (sizes := heads[first].get(w[i + 1])):
            hit.update(at for k in sizes if i + k <= len(w) and (at := whole.get(b" ".join(w[i : i + k]))) is not None)
    return sorted(hit)


#: Names up to this many (some 50 MB) are broadcast; more meet the texts' words by shuffle.
NAME_ROWS = 500_000
#: A word of any alphabet.
WORD_RUN = r"(?U)\w+"


def names_in(texts: DataFrame, text: Column, names: DataFrame, limit: int = NAME_ROWS) -> DataFrame:
    """(name): those of ``names`` (name) that stand in a text as they are written, with no word
    character right before or after them.

    Null names, and names without a word character, stand nowhere. A name is only compared where its
    first word stands: up to ``limit`` names go to the texts, more meet the words of the texts by
    shuffle, and the texts of the candidates by theirs. One expression compares in either case.
    """
    names = names.select(F.trim("name").alias("name")).distinct()
    names = names.withColumn("w", F.regexp_extract("name", WORD_RUN, 0)).filter("w <> ''")
    heads = lambda d: F.explode(F.array_distinct(F.regexp_extract_all(d, F.lit(WORD_RUN), F.lit(0)))).alias("w")
    plain = F.regexp_replace("name", r"([^\p{L}\p{N}\s])", r"\\$1")  # every sign stands for itself
    stands = F.contains("t", F.col("name")) & F.regexp_like("t", F.concat(F.lit(r"(?U)(?<!\w)"), plain, F.lit(r"(?!\w)")))
    if names.count() <= limit:
        met = texts.select(text.cast("string").alias("t")).select("t", heads(F.col("t"))).join(F.broadcast(names), "w")
    else:
        held = texts.sparkSession.read.parquet(_numbered(texts.select(text.cast("string").alias("t"))))
        some = held.select("i", heads(F.col("t"))).join(names, "w").select("i", "name")
        met = some.join(held, "i")
    return met.filter(stands).select("name").distinct()


def _numbered(texts: DataFrame) -> str:
    """Where a copy of ``texts`` lies whose rows are numbered (``i``)."""
    from ..session import scratch_path

    path = scratch_path(texts.sparkSession, "texts")
    texts.withColumn("i", F.monotonically_increasing_id()).write.parquet(path)
    return path


def unseen_pairs(pairs: DataFrame, names: str, texts: DataFrame, text: Column, **options) -> DataFrame:
    """Pairs none of whose names (an array) stands in a text: a theta anti-join by words."""
    seen = names_in(texts, text, pairs.select(F.explode(names).alias("name")), **options)
    d = pairs.withColumn("__pair", F.struct(*pairs.columns))
    bad = d.select("__pair", F.explode(names).alias("name")).withColumn("name", F.trim("name")).join(seen, "name", "left_semi").select("__pair").distinct()
    return d.join(bad, "__pair", "left_anti").drop("__pair")


def blind_sides(df: DataFrame, key: Column, salt: str, odd_first: bool = False) -> DataFrame:
    """Balanced blind assignment: rows ranked by hash, the first half (with the odd row, if
    ``odd_first``) is not swapped. Ranks are
    counts of the hashes below: by ranges of the hash first, inside a range second."""
    d = df.withColumn("__h", F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)).withColumn("__r", F.substring("__h", 1, 3))
    ranges = d.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))  # 4,096 at most
    before = F.sum("__n").over(Window.orderBy(F.col("__r").asc_nulls_first()))
    ranges = ranges.select(F.col("__r").alias("__s"), (before - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    d = d.withColumn("__i", F.row_number().over(Window.partitionBy("__r").orderBy("__h"))).join(F.broadcast(ranges), F.col("__r").eqNullSafe(F.col("__s")))
    rank = (F.col("__before") + F.col("__i")).cast("int")
    return d.withColumn("rank", rank).withColumn("swapped", F.col("rank") > F.floor((F.col("__all") + int(odd_first)) / 2)).drop("__h", "__r", "__s", "__i", "__before", "__all")


def packet_id(prefix: str, *cols: Column) -> Column:
    """Prefix and 16 hex digits of the SHA-256 of a canonical string."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *cols), 256), 1, 16))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference both ways: empty when the frames hold the same rows."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: key columns and the rule's name. A rule that is null is broken."""
    checks = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return df.select(*key, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("rule"))


def require(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """``df`` itself; evaluating a row that breaks a rule raises with the rule's name."""
    ok = reduce(lambda a, r: a & F.coalesce(F.assert_true(r[1], F.lit(r[0])).isNull(), F.lit(True)), rules.items(), F.lit(True))
    return df.filter(ok)
