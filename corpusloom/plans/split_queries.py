"""Queries of splits, leakage checks, sets and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import splits as S
from ..operators import stats
from .registry import register, table

SEED = "spark-split-v1"
SPLIT_SQL = "CASE CAST('0x' || substr(sha256('spark-split-v1' || chr(0) || split_part(source, '|', 1)), 1, 8) AS BIGINT) % 20 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"
W = "regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')"
BUCKET10 = "CAST('0x' || substr(sha256({0}), 1, 8) AS BIGINT) % 10"


@register("slice_repetition_by_split", f"""
WITH w AS (SELECT lang, {SPLIT_SQL} AS split, {W} AS w FROM documents),
g AS (SELECT lang, split, len(w) AS n, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS g FROM w)
SELECT split, lang, count(*) AS documents, sum(n)::BIGINT AS words,
  round(sum(len(g) - len(list_distinct(g))) / greatest(1, sum(len(g))), 9) AS excess
FROM g GROUP BY ALL ORDER BY split, lang""")
def slice_query(spark, sf):
    """Flagship: bigram repetition by split and language, as a ratio of sums."""
    d = table(spark, sf, "documents").select("lang", S.author_split(F.col("source"), SEED).alias("split"), stats.gram_counts(F.col("text"), 2).alias("g"))
    over, positions = F.sum(F.col("g.positions") - F.col("g.distinct")), F.sum("g.positions")
    return d.groupBy("split", "lang").agg(F.count("*").alias("documents"), F.sum("g.words").alias("words"), F.round(over / F.greatest(F.lit(1), positions), 9).alias("excess")).orderBy("split", "lang")


@register("g01_author_split", f"SELECT doc_id, {SPLIT_SQL} AS split FROM documents")
def g01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.author_split(F.col("source"), SEED).alias("split"))


@register("g02_name_pools", f"""
SELECT c_custkey, CASE WHEN {BUCKET10.format('c_name')} < 8 THEN 'train' WHEN {BUCKET10.format('c_name')} = 8 THEN 'validation' ELSE 'test' END AS pool,
 CASE WHEN c_custkey % 50 = 0 OR {BUCKET10.format('c_name')} < 8 THEN 'train' WHEN {BUCKET10.format('c_name')} = 8 THEN 'validation' ELSE 'test' END AS wide FROM customer""")
def g02(spark, sf):
    """Name pools (G2), with known names forced to train."""
    n = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", S.name_split(n).alias("pool"), S.name_split(n, F.col("c_custkey") % 50 == 0).alias("wide"))


@register("g04_every_20th", "SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 20 = 0 AS valid FROM documents")
def g04(spark, sf):
    return S.every_nth(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"]).select("doc_id", "valid")


@register("g05_tail_split", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) > count(*) OVER (PARTITION BY lang) - count(*) OVER (PARTITION BY lang) // 20 AS held FROM documents")
def g05(spark, sf):
    """Last twentieth of each stream held out."""
    return S.tail_split(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"]).select("doc_id", "held")


@register("g06_halves", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= count(*) OVER (PARTITION BY source) // 2 THEN 'selection' ELSE 'outcome' END AS half FROM documents")
def g06(spark, sf):
    """Selection and outcome halves."""
    return S.halves(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"]).select("doc_id", "half")


@register("g08_blind_sides", """
SELECT item_id, row_number() OVER (ORDER BY sha256('blind-v1:' || item_id)) AS rank,
  row_number() OVER (ORDER BY sha256('blind-v1:' || item_id)) > count(*) OVER () // 2 AS swapped FROM benchmark""")
def g08(spark, sf):
    """Balanced blind A/B sides (G8, T-2) over the fixed benchmark table."""
    return S.blind_sides(table(spark, sf, "benchmark").select("item_id"), F.col("item_id"), "blind-v1:")


@register("g10_packet_ids", "SELECT doc_id, 'review-' || substr(sha256(source || chr(31) || lang || chr(31) || doc_id), 1, 16) AS packet FROM documents")
def g10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.packet_id("review-", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("packet"))


@register("g11_stream_weights", """
SELECT source, sum(n_chars)::BIGINT AS size, round(pow(sum(n_chars), 0.5) / sum(pow(sum(n_chars), 0.5)) OVER (), 9) AS weight FROM documents GROUP BY source""")
def g11(spark, sf):
    """Stream weights: size to a power, normalised."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("size"))
    p = F.pow("size", F.lit(0.5))
    return d.select("source", "size", F.round(p / F.sum(p).over(Window.partitionBy()), 9).alias("weight"))


@register("g12_weighted_choice", """
WITH s AS (SELECT source, sum(n_chars) AS size FROM documents GROUP BY source),
c AS (SELECT source, sum(size) OVER (ORDER BY source) - size AS lo, sum(size) OVER (ORDER BY source) AS hi, sum(size) OVER () AS total FROM s),
d AS (SELECT doc_id, (CAST('0x' || substr(md5('draw:' || doc_id), 1, 8) AS BIGINT)) AS u FROM documents)
SELECT doc_id, source AS picked FROM d JOIN c ON u % total >= lo AND u % total < hi""")
def g12(spark, sf):
    """Sources drawn by size: a hash-uniform draw falls into a cumulative range."""
    from ..operators.generate import weighted_draw

    d = table(spark, sf, "documents")
    ranges = d.groupBy("source").agg(F.sum("n_chars").alias("size"))
    return weighted_draw(d.select("doc_id"), F.concat(F.lit("draw:"), F.col("doc_id").cast("string")), ranges, "source", "size").select("doc_id", F.col("source").alias("picked"))


@register("j06_split_leaks", f"""
SELECT lang AS key, list_sort(list(DISTINCT {SPLIT_SQL})) AS splits FROM documents GROUP BY lang HAVING count(DISTINCT {SPLIT_SQL}) > 1""")
def j06(spark, sf):
    """Keys found in more than one split."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("key"), S.author_split(F.col("source"), SEED).alias("split"))
    return S.split_leaks(d, "key", "split")


@register("j07_blocked_accounts", """
WITH k AS (SELECT doc_id, source, regexp_replace(lower(text), '[0-9]+', 'N', 'g') AS k FROM documents)
SELECT doc_id FROM k WHERE source <> 'src0' AND k NOT IN (SELECT k FROM k WHERE source = 'src0')
QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1""")
def j07(spark, sf):
    """Accounts whose normalised key is not in a blocked set, each key once."""
    from ..operators.sequence import first_per_key

    d = table(spark, sf, "documents").select("doc_id", "source", X.account_key(F.col("text")).alias("k"))
    kept = S.blocked(d.filter("source <> 'src0'"), d.filter("source = 'src0'"), F.col("k"), F.col("k"))
    return first_per_key(kept, ["k"], ["doc_id"]).select("doc_id")


@register("j09_benchmark_passages", """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM benchmark),
bg AS (SELECT DISTINCT least(len(w), 16) AS k, unnest(CASE WHEN len(w) >= 16 THEN list_transform(range(1, len(w) - 14), lambda i: array_to_string(w[i:i+15], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM b WHERE len(w) > 0),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g FROM d, (SELECT DISTINCT k FROM bg) WHERE len(w) >= k)
SELECT doc_id, count(*) AS hits FROM dg JOIN bg USING (g) GROUP BY doc_id""".replace("\\\\", "\\"))
def j09(spark, sf):
    """Benchmark passages of any length inside documents: 16-word shingles, shorter ones whole."""
    return S.passage_hits(table(spark, sf, "documents"), "doc_id", F.col("text"), table(spark, sf, "benchmark"), F.col("text"), 16)


@register("j08_unseen_pairs", rf"""
WITH p AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[^\pL\pN_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{6,}}')) AS names FROM benchmark),
t AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\pL\pN_]+')) AS w FROM documents WHERE {SPLIT_SQL} = 'train'),
n AS (SELECT item_id, unnest(names) AS name FROM p)
SELECT item_id FROM p WHERE item_id NOT IN (SELECT item_id FROM n JOIN t ON name = w)""")
def j08(spark, sf):
    """Passages none of whose long names stands in a text of the training split."""
    p = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{6,}\b"), F.lit(0)).alias("names"))
    train = table(spark, sf, "documents").filter(S.author_split(F.col("source"), SEED) == "train")
    return S.unseen_pairs(p, "names", train, F.col("text")).select("item_id")


@register("j10_subset_check", """
SELECT o_orderkey FROM orders WHERE (o_orderkey, o_custkey) NOT IN (SELECT (o_orderkey, o_custkey) FROM orders WHERE o_orderkey % 7 <> 0)""")
def j10(spark, sf):
    """Rows of B that are not in C on (id, content)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.join(o.filter("o_orderkey % 7 <> 0"), ["o_orderkey", "o_custkey"], "left_anti").select("o_orderkey")


@register("j11_overlap", """
SELECT lower(text) AS target, lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT lower(text), lang FROM documents WHERE doc_id % 2 = 1""")
def j11(spark, sf):
    """Targets that two halves share (J11, J12, SO4)."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.lower("text").alias("target"))
    return S.overlap(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), ["target", "lang"])


@register("so06_set_equality", """
SELECT n_regionkey AS k, 'left' AS side FROM (SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region)
UNION ALL SELECT r_regionkey, 'right' FROM (SELECT r_regionkey FROM region EXCEPT ALL SELECT n_regionkey FROM nation)""")
def so06(spark, sf):
    """Multiset difference both ways (SO5, SO6, SO7)."""
    return S.same_rows(table(spark, sf, "nation").select(F.col("n_regionkey").alias("k")), table(spark, sf, "region").select(F.col("r_regionkey").alias("k")))


@register("so08_exact_duplicates", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def so08(spark, sf):
    """Content hashes that occur more than once."""
    d = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return d.filter("copies > 1")


@register("so01_union_families", """
SELECT doc_id, lang, NULL::BIGINT AS item_id FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, lang, NULL FROM documents WHERE lang = 'es' UNION ALL SELECT NULL, NULL, item_id FROM benchmark""")
def so01(spark, sf):
    """Union of row families with replay: missing columns are null."""
    d = table(spark, sf, "documents").filter("lang = 'es'").select("doc_id", "lang")
    return d.union(d).unionByName(table(spark, sf, "benchmark").select("item_id"), allowMissingColumns=True)


@register("so02_ordered_distinct", f"""
WITH e AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {W} AS w FROM documents) WHERE len(w) > 0),
f AS (SELECT doc_id, w, min(i) AS i FROM e GROUP BY doc_id, w), g AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS once FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(once, '') AS once FROM documents LEFT JOIN g USING (doc_id)""")
def so02(spark, sf):
    """Distinct words in order of appearance."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(X.lower_words(F.col("text"))), " ").alias("once"))


@register("so03_sorted_distinct", "SELECT DISTINCT lang, source FROM documents ORDER BY lang, source")
def so03(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct().orderBy("lang", "source")


@register("f11_vote_violations", """
SELECT event_id, unnest(list_filter([CASE WHEN user_id % 10 = 0 THEN 'reviewer' END, CASE WHEN value IS NULL OR value < 1 THEN 'value' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'choice' END], lambda x: x IS NOT NULL)) AS rule FROM events""")
def f11(spark, sf):
    """Rule violations of an event log, one row each."""
    rules = {"reviewer": F.col("user_id") % 10 != 0, "value": F.col("value") >= 1, "choice": F.col("event_type").isin("click", "view")}
    return S.violations(table(spark, sf, "events"), ["event_id"], rules)


@register("f13_pairing_guard", """
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, a.o_orderkey IS NOT NULL AS in_a, b.o_orderkey IS NOT NULL AS in_b
FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) b USING (o_orderkey)
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL""")
def f13(spark, sf):
    """Keys that lack a partner on either side."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    a, b = o.filter("k % 5 <> 0").withColumn("a", F.lit(True)), o.filter("k % 3 <> 0").withColumn("b", F.lit(True))
    return a.join(b, "k", "full").filter("a is null or b is null").select("k", F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b"))


@register("f14_grid_complete", "SELECT count(*) AS n, count(DISTINCT (lang, source)) AS keys, count(DISTINCT (lang, source)) = count(DISTINCT lang) * count(DISTINCT source) AS complete FROM documents")
def f14(spark, sf):
    """Grid completeness: every combination present."""
    d = table(spark, sf, "documents")
    return d.agg(F.count("*").alias("n"), F.countDistinct("lang", "source").alias("keys"), (F.countDistinct("lang", "source") == F.countDistinct("lang") * F.countDistinct("source")).alias("complete"))


@register("f16_knowledge_filter", """
SELECT o_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'O' AND l_linenumber NOT IN (1, 5))::INT AS known FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def f16(spark, sf):
    """Spans kept by knowledge, spoken flag and role, as an array filter."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_linestatus", "l_linenumber")).alias("fields"))
    keep = lambda f: (f["l_returnflag"] != "R") & (f["l_linestatus"] == "O") & ~f["l_linenumber"].isin(1, 5)
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.join(items, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.size(F.filter("fields", keep)).alias("known"))


@register("f17_held_out_cells", """
SELECT doc_id FROM documents WHERE (lang, n_chars % 3) NOT IN (VALUES ('en', 0), ('fr', 1))""")
def f17(spark, sf):
    """Rows outside held-out cells (a small anti join)."""
    cells = spark.createDataFrame([("en", 0), ("fr", 1)], "lang string, cell long")
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") % 3).alias("cell"))
    return d.join(F.broadcast(cells), ["lang", "cell"], "left_anti").select("doc_id")


@register("a12_ngram_jaccard", f"""
WITH w AS (SELECT doc_id, {W} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) ELSE [] END AS g FROM w),
p AS (SELECT a.doc_id AS a, a.g AS ga, b.g AS gb FROM g a JOIN g b ON b.doc_id = a.doc_id + 1)
SELECT a AS doc_id, round(CASE WHEN len(ga) + len(gb) > 0 THEN len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb)))::DOUBLE ELSE 0 END, 9) AS jaccard,
 list_sort(list_intersect(ga, gb))[1:12] AS shared FROM p""")
def a12(spark, sf):
    """Trigram overlap of neighbouring documents, with up to 12 examples."""
    d = table(spark, sf, "documents").select("doc_id", F.array_distinct(X.joined_ngrams(X.lower_words(F.col("text")), 3)).alias("g"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return d.join(b, "doc_id").select("doc_id", F.round(stats.jaccard(F.col("g"), F.col("h")), 9).alias("jaccard"), F.slice(F.sort_array(F.array_intersect("g", "h")), 1, 12).alias("shared"))
