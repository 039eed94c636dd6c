"""Scalar functions, each with an entry of its own, and small checks over runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import records as RC
from ..operators import retrieval as R
from ..operators import sequence as Q
from ..operators import spans as SP
from ..operators import stats as ST
from .registry import register, table


def docs(spark, sf):
    return table(spark, sf, "documents")


@register("sf02_hex_prefix", "SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) AS value FROM documents")
def sf02(spark, sf):
    """First eight hex digits of a digest as an integer (SF2)."""
    return docs(spark, sf).select("doc_id", F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("long").alias("value"))


@register("sf06_words", "SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS words FROM documents")
def sf06(spark, sf):
    """All words of a text (SF6)."""
    return docs(spark, sf).select("doc_id", X.lower_words(F.col("text")).alias("words"))


@register("sf07_names", r"SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\pL\pN_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}')) AS names FROM documents")
def sf07(spark, sf):
    """Capitalised words of three letters or more (SF7)."""
    return docs(spark, sf).select("doc_id", F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0)).alias("names"))


@register("sf09_full_match", r"""
SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#([0-9]+)$', 1) AS kind, CASE WHEN regexp_matches(c_name, '^([A-Za-z]+)#([0-9]+)$') THEN CAST(regexp_extract(c_name, '^([A-Za-z]+)#([0-9]+)$', 2) AS BIGINT) END AS number FROM customer""")
def sf09(spark, sf):
    """A whole match with named parts (SF9)."""
    whole = r"^([A-Za-z]+)#([0-9]+)$"
    part = lambda i: F.regexp_extract("c_name", whole, i)
    return table(spark, sf, "customer").select("c_custkey", part(1).alias("kind"), F.when(F.col("c_name").rlike(whole), part(2)).cast("long").alias("number"))


@register("sf10_split", r"SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS words FROM documents")
def sf10(spark, sf):
    """Words between white space (SF10)."""
    return docs(spark, sf).select("doc_id", X.words(F.col("text")).alias("words"))


@register("sf11_lower", "SELECT doc_id, lower(text) AS low, replace(lower(text), 'ß', 'ss') AS folded FROM documents")
def sf11(spark, sf):
    """Lower case, and folded for comparison (SF11)."""
    low = F.lower("text")
    return docs(spark, sf).select("doc_id", low.alias("low"), F.replace(low, F.lit("ß"), F.lit("ss")).alias("folded"))


@register("sf14_affixes", "SELECT p_partkey, starts_with(p_name, 's') AS starts, ends_with(p_name, 'e') AS ends, contains(p_name, 'an') AS holds, replace(p_name, ' ', '_') AS joined FROM part")
def sf14(spark, sf):
    """Beginnings, ends, contents, replacement (SF14)."""
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", n.startswith("s").alias("starts"), n.endswith("e").alias("ends"), n.contains("an").alias("holds"), F.replace(n, F.lit(" "), F.lit("_")).alias("joined"))


@register("sf15_substrings", """
SELECT doc_id, substr(text, 3, 10) AS middle, right(text, 7) AS tail, instr(text, ' ')::INT AS first_space,
 CASE WHEN instr(text, ' ') > 0 THEN length(text) + 1 - instr(reverse(text), ' ') ELSE 0 END::INT AS last_space FROM documents""")
def sf15(spark, sf):
    """Substrings, tails, first and last positions (SF15)."""
    t = F.col("text")
    last = F.when(F.instr(t, " ") > 0, F.length(t) + 1 - F.instr(F.reverse(t), " ")).otherwise(0)
    return docs(spark, sf).select("doc_id", F.substring(t, 3, 10).alias("middle"), F.right(t, F.lit(7)).alias("tail"), F.instr(t, " ").alias("first_space"), last.alias("last_space"))


@register("sf17_base_letters", "SELECT doc_id, strip_accents(text) AS base FROM documents")
def sf17(spark, sf):
    """Decomposed, without combining marks (SF17)."""
    return docs(spark, sf).select("doc_id", X.nfkd_base(F.col("text")).alias("base"))


@register("sf18_slots", "SELECT n_nationkey, replace(replace('{0} of region {1}, not {2}', '{0}', n_name), '{1}', n_regionkey::VARCHAR) AS text FROM nation")
def sf18(spark, sf):
    """Numbered slots filled; one without a value stays (SF18)."""
    values = F.array("n_name", F.col("n_regionkey").cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", SP.fill_slots(F.lit("{0} of region {1}, not {2}"), values).alias("text"))


@register("sf19_ngrams", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS grams FROM w""")
def sf19(spark, sf):
    """Trigrams in order, repeats kept (SF19)."""
    return docs(spark, sf).select("doc_id", X.joined_ngrams(X.words(F.col("text")), 3).alias("grams"))


@register("sf26_numbers", """
SELECT event_id, round(ln(1 + value), 9) AS log, round(exp(-value / 100), 9) AS decay, round(sqrt(value), 9) AS root, round(pow(value, 1.5), 6) AS power, abs(user_id - 50) AS off, floor(value)::BIGINT AS whole, event_id % 7 AS rest, sign(user_id - 50)::INT AS side FROM events""")
def sf26(spark, sf):
    """Logarithm, powers, rounding, remainders, signs (SF26)."""
    v, off = F.col("value"), F.col("user_id") - 50
    return table(spark, sf, "events").select("event_id", F.round(F.ln(1 + v), 9).alias("log"), F.round(F.exp(-v / 100), 9).alias("decay"), F.round(F.sqrt(v), 9).alias("root"), F.round(F.pow(v, F.lit(1.5)), 6).alias("power"), F.abs(off).alias("off"), F.floor(v).alias("whole"), (F.col("event_id") % 7).alias("rest"), F.signum(off).cast("int").alias("side"))


@register("sf29_lexical_overlap", """
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?'), lambda x: length(x) >= 4)) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) > 0 THEN len(list_intersect(a.w, b.w)) / len(a.w)::DOUBLE ELSE 0 END, 9) AS share FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def sf29(spark, sf):
    """Share of a turn's words of four letters or more that the next turn has (SF29)."""
    long = F.array_distinct(F.filter(X.lower_words(F.col("text")), lambda w: F.length(w) >= 4))
    a = table(spark, sf, "conversations").select("conv_id", "turn", long.alias("w"))
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(R.lexical_overlap(F.col("w"), F.col("v")), 9).alias("share"))


@register("x05_target_windows", """
WITH w AS (SELECT doc_id, n_chars, unnest(range(0, n_chars::BIGINT, 256)) AS start FROM documents WHERE n_chars > 0)
SELECT doc_id, start, least(256, n_chars - start)::BIGINT AS size, start >= 64 AND start + 256 <= n_chars AS in_bounds FROM w""")
def x05(spark, sf):
    """Windows of 256 targets, and whether context and targets lie in the stream."""
    d = docs(spark, sf).filter("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_chars") - 1) / 256))).alias("k"))
    start = F.col("k") * 256
    return d.select("doc_id", start.alias("start"), F.least(F.lit(256), F.col("n_chars") - start).cast("long").alias("size"), ((start >= 64) & (start + 256 <= F.col("n_chars"))).alias("in_bounds"))


@register("x07_seed_gate", """
WITH r AS (SELECT l_orderkey AS run, l_linenumber AS seed, l_quantity > 10 AS passed, l_suppkey % 2 AS digest FROM lineitem),
p AS (SELECT run, passed, digest FROM r WHERE seed = 1)
SELECT r.run, r.seed, r.seed = 1 OR (coalesce(p.passed, false) AND p.digest = r.digest) AS allowed FROM r LEFT JOIN p USING (run)""")
def x07(spark, sf):
    """Seeds after the first need a passing pilot with the same digest."""
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("seed"), (F.col("l_quantity") > 10).alias("passed"), (F.col("l_suppkey") % 2).alias("digest"))
    return RC.seed_gate(r, "run", "seed", "passed", "digest").select("run", "seed", "allowed")


@register("x12_approved_responses", """
WITH a AS (SELECT event_type AS act, list(DISTINCT user_id % 10) AS ok FROM events WHERE event_id % 50 = 0 GROUP BY 1)
SELECT event_type AS act, count(*) AS n, count(*) FILTER (WHERE list_contains(coalesce(ok, []), user_id % 10) AND value > 1) AS approved FROM events LEFT JOIN a ON act = event_type GROUP BY 1""")
def x12(spark, sf):
    """Responses by act: those that stopped and are of the act's approved set."""
    e = table(spark, sf, "events").withColumn("text", F.col("user_id") % 10)
    ok = e.filter("event_id % 50 = 0").groupBy("event_type").agg(F.collect_set("text").alias("ok"))
    return RC.approved_by_group(e, ok, "event_type", "text", "ok", F.col("value") > 1).withColumnRenamed("event_type", "act")


@register("x30_stream_losses", """
WITH s AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
k AS (SELECT source, n, unnest(range(0, 8)) AS j FROM (SELECT DISTINCT source, n FROM s)),
p AS (SELECT DISTINCT source, j, (j * (n - 1) // 7) AS i FROM k)
SELECT source, count(*) AS windows, round(avg(ln(1 + n_chars)), 9) AS loss FROM p JOIN s USING (source, i) GROUP BY source""")
def x30(spark, sf):
    """Mean loss of a stream over eight evenly spaced windows."""
    d = Q.numbered(docs(spark, sf).select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "nth", "n")
    chosen = F.array_contains(Q.integer_starts(F.col("n"), 8), F.col("nth") - 1)
    d = d.filter(chosen)
    # the same window may be chosen more than once: it counts as often
    times = F.size(F.filter(Q.integer_starts(F.col("n"), 8), lambda i: i == F.col("nth") - 1))
    d = d.select("source", F.ln(1 + F.col("n_chars")).alias("loss"), times.alias("times"))
    return d.groupBy("source").agg(F.sum("times").alias("windows"), F.round(F.sum(F.col("loss") * F.col("times")) / F.sum("times"), 9).alias("loss"))


@register("x36_one_format", "SELECT lang, count(DISTINCT source) AS formats, count(DISTINCT source) = 1 AS single FROM documents GROUP BY lang")
def x36(spark, sf):
    """One format for all splits of a dataset, or not."""
    return docs(spark, sf).groupBy("lang").agg(F.countDistinct("source").alias("formats"), (F.countDistinct("source") == 1).alias("single"))


@register("x35_options", """
SELECT p_partkey, list_filter([CASE WHEN p_size NOT IN (1, 2, 4, 8, 16, 32) THEN 'count' END, CASE WHEN NOT regexp_matches(p_brand, '^Brand#[0-9]+$') THEN 'brand' END, CASE WHEN p_retailprice <= 0 THEN 'price' END], lambda x: x IS NOT NULL) AS faults FROM part""")
def x35(spark, sf):
    """Options against allowed counts and strict forms."""
    rules = {"count": F.col("p_size").isin(1, 2, 4, 8, 16, 32), "brand": F.col("p_brand").rlike("^Brand#[0-9]+$"), "price": F.col("p_retailprice") > 0}
    return table(spark, sf, "part").select("p_partkey", RC.faults(rules).alias("faults"))


@register("x16_covered_rules", """
WITH f AS (SELECT source, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 1 GROUP BY source), r AS (SELECT DISTINCT source FROM documents)
SELECT source, doc_id, doc_id IS NOT NULL AS covered FROM r LEFT JOIN f USING (source)""")
def x16(spark, sf):
    """First test row of each rule, and whether every rule has one."""
    d = docs(spark, sf).select("source", "doc_id")
    first = d.filter("doc_id % 2 = 1").groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    return d.select("source").distinct().join(first, "source", "left").withColumn("covered", F.col("doc_id").isNotNull())


@register("x20_author_windows", """
WITH w AS (SELECT l_orderkey AS book, l_linenumber AS w, l_quantity::BIGINT AS bytes, l_extendedprice / 1000 AS nats, l_returnflag AS author FROM lineitem WHERE l_linestatus = 'O')
SELECT author, book, w, bytes, round(nats / ln(2) / bytes, 9) AS bpb, round(sum(nats) OVER (PARTITION BY author) / ln(2) / sum(bytes) OVER (PARTITION BY author), 6) AS author_bpb FROM w""")
def x20(spark, sf):
    """Windows of further authors with their own and their author's bits a byte."""
    d = table(spark, sf, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_returnflag").alias("author"), F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("w"), F.col("l_quantity").cast("long").alias("bytes"), (F.col("l_extendedprice") / 1000).alias("nats"))
    by = d.groupBy("author").agg(F.round(ST.bits_per_byte(F.col("nats"), F.col("bytes")), 6).alias("author_bpb"))
    return d.join(by, "author").select("author", "book", "w", "bytes", F.round(F.col("nats") / F.ln(F.lit(2.0)) / F.col("bytes"), 9).alias("bpb"), "author_bpb")
