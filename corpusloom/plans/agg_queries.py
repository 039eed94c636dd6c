"""Queries of joins, aggregations, top-k and statistics.

Windows of a scored stream are derived from ``lineitem`` (start, bytes, nats), books from
``orders``, votes from ``events``; formulas are the same in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import generate as G
from ..operators import joins as J
from ..operators import sequence as Q
from ..operators import stats as ST
from ..operators import votes as V
from .registry import register, table

W = "regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')"
WIN_SQL = """(SELECT l_orderkey AS book, l_linenumber AS w, l_quantity::BIGINT AS bytes, l_extendedprice / 1000 AS nats_a,
  l_extendedprice / 1000 * (1 + l_discount - 0.05) AS nats_b, l_returnflag || l_linestatus AS author FROM lineitem)"""


def windows(spark, sf):
    """Window losses of two models: book, w, bytes, nats_a, nats_b, author."""
    price = F.col("l_extendedprice") / 1000
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("w"), F.col("l_quantity").cast("long").alias("bytes"), price.alias("nats_a"), (price * (1 + F.col("l_discount") - 0.05)).alias("nats_b"), F.concat("l_returnflag", "l_linestatus").alias("author"))


@register("a01_bits_per_byte", f"SELECT author, round(sum(nats_a) / ln(2) / sum(bytes), 6) AS bpb FROM {WIN_SQL} GROUP BY author")
def a01(spark, sf):
    """Bits per byte by author, a ratio of sums."""
    return windows(spark, sf).groupBy("author").agg(F.round(ST.bits_per_byte(F.col("nats_a"), F.col("bytes")), 6).alias("bpb"))


@register("a02_paired_rollup", f"""
SELECT author, round(sum(nats_a) / ln(2) / sum(bytes), 6) AS a, round(sum(nats_b) / ln(2) / sum(bytes), 6) AS b,
 count(*) AS windows, sum(bytes)::BIGINT AS bytes, count(DISTINCT book) AS books, count(*) FILTER (WHERE nats_b < nats_a) AS wins, count(*) FILTER (WHERE nats_b > nats_a) AS losses, count(*) FILTER (WHERE nats_b = nats_a) AS ties
FROM {WIN_SQL} GROUP BY ROLLUP (author)""")
def a02(spark, sf):
    """Paired aggregate by author and pooled, in one rollup."""
    w = windows(spark, sf)
    return w.rollup("author").agg(F.round(ST.bits_per_byte(F.col("nats_a"), F.col("bytes")), 6).alias("a"), F.round(ST.bits_per_byte(F.col("nats_b"), F.col("bytes")), 6).alias("b"), F.count("*").alias("windows"), F.sum("bytes").alias("bytes"), F.countDistinct("book").alias("books"), F.count_if(F.col("nats_b") < F.col("nats_a")).alias("wins"), F.count_if(F.col("nats_b") > F.col("nats_a")).alias("losses"), F.count_if(F.col("nats_b") == F.col("nats_a")).alias("ties"))


_TREE_SQL = "SELECT lang, k // 1024 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM {} GROUP BY lang, k // 1024"


@register("a04_split_summary", rf"""
WITH l0 AS (SELECT lang, doc_id AS k, sha256(text) AS h FROM documents),
l1 AS ({_TREE_SQL.format('l0')}), l2 AS ({_TREE_SQL.format('l1')}), l3 AS ({_TREE_SQL.format('l2')}), l4 AS ({_TREE_SQL.format('l3')}),
s AS (SELECT lang, sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')))::BIGINT AS words, sum(length(text))::BIGINT AS chars, count(*) AS chunks,
 count(DISTINCT source) AS books, list_sort(list(DISTINCT source)) AS authors FROM documents GROUP BY lang)
SELECT s.*, h AS digest FROM s JOIN l4 ON s.lang IS NOT DISTINCT FROM l4.lang""")
def a04(spark, sf):
    """Split summary with sorted authors and a tree digest of the texts' digests in order of ids."""
    d = table(spark, sf, "documents")
    tree = ST.tree_digest(d.select("lang", F.col("doc_id").alias("k"), F.sha2("text", 256).alias("h")), "lang", "k", "h")
    s = d.groupBy("lang").agg(F.sum(X.word_count(F.col("text"))).alias("words"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("chunks"), F.countDistinct("source").alias("books"), F.sort_array(F.collect_set("source")).alias("authors"))
    return s.join(tree.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang").withColumnRenamed("h", "digest")


@register("a05_ngram_repetition", f"""
WITH w AS (SELECT doc_id, {W} AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2),
c AS (SELECT doc_id, g, count(*) AS n, min(i) AS first FROM g GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS positions, max(n) AS max_count, arg_max(g, n * 1000000 - first) AS max_ngram,
 round(max(n) / sum(n), 9) AS max_frequency, round(sum(n - 1) / sum(n), 9) AS excess_rate FROM c GROUP BY doc_id""")
def a05(spark, sf):
    """Bigram repetition with the first n-gram to reach the top count (A5, T-5, T-10)."""
    d = ST.ngram_repetition(table(spark, sf, "documents"), "doc_id", F.col("text"), 2)
    return d.withColumn("max_frequency", F.round("max_frequency", 9)).withColumn("excess_rate", F.round("excess_rate", 9))


@register("a06_four_gram_repeat", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) ELSE [] END AS g FROM w)
SELECT doc_id, round(CASE WHEN len(g) > 0 THEN (len(g) - len(list_distinct(g))) / len(g) ELSE 0 END, 9) AS rate FROM g""")
def a06(spark, sf):
    """4-gram repeat rate over white-space words."""
    return table(spark, sf, "documents").select("doc_id", F.round(X.bind(X.words(F.col("text")), lambda w: ST.repeat_excess(w, 4)), 9).alias("rate"))


@register("a07_sweep_grouping_sets", """
SELECT lang, source, round(avg(n_chars), 6) AS mean_chars, count(DISTINCT text) AS outputs FROM documents GROUP BY GROUPING SETS ((lang, source), (lang))""")
def a07(spark, sf):
    """Sweep summary per setting and prompt, and per setting, in one pass."""
    return table(spark, sf, "documents").groupingSets([["lang", "source"], ["lang"]], "lang", "source").agg(F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.countDistinct("text").alias("outputs"))


@register("a08_mean_distinct", "WITH g AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT round(avg(n), 9) AS mean_books, count(*) FILTER (WHERE n > 1) AS mixed FROM g")
def a08(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n"))
    return g.agg(F.round(F.avg("n"), 9).alias("mean_books"), F.count_if(F.col("n") > 1).alias("mixed"))


@register("a09_name_index", r"""
WITH s AS (SELECT source, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
n AS (SELECT source, unnest(regexp_extract_all(regexp_replace(s, '^[^ \t\n\r\f\v]+', ''), '[\pL\pM\p{Nd}\p{Pc}]+')) AS name FROM s)
SELECT name, count(*) AS n, min(source) AS book FROM n WHERE regexp_full_match(name, '[A-Z][a-z]{2,}') GROUP BY name HAVING count(*) >= 5 AND count(DISTINCT source) = 1""")
def a09(spark, sf):
    """Capitalised words inside sentences, seen 5 times or more in exactly one book."""
    s = table(spark, sf, "documents").select("source", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("s"))
    n = s.select("source", F.explode(F.regexp_extract_all(F.regexp_replace("s", r"^\S+", ""), F.lit(r"(?U)\b[A-Z][a-z]{2,}\b"), F.lit(0))).alias("name"))
    g = n.groupBy("name").agg(F.count("*").alias("n"), F.min("source").alias("book"), F.countDistinct("source").alias("books"))
    return g.filter("n >= 5 and books = 1").drop("books")


@register("a10_placement_histogram", """
WITH t AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch, unnest(range(1, length(text) + 1)) AS i FROM conversations WHERE text <> ''),
p AS (SELECT ch, lag(ch) OVER (PARTITION BY conv_id, turn ORDER BY i) AS prev FROM t),
v AS (SELECT DISTINCT ch FROM t)
SELECT v.ch, count(p.ch) AS n FROM v LEFT JOIN p ON p.ch = v.ch AND (p.prev IS NULL OR p.prev = ' ') GROUP BY v.ch""")
def a10(spark, sf):
    """Word-initial characters counted over the whole vocabulary."""
    from pyspark.sql import Window

    t = table(spark, sf, "conversations").filter("text <> ''").select("conv_id", "turn", F.posexplode(F.split("text", "")).alias("i", "ch")).filter("ch <> ''")
    p = t.withColumn("prev", F.lag("ch").over(Window.partitionBy("conv_id", "turn").orderBy("i")))
    n = p.filter("prev is null or prev = ' '").groupBy("ch").agg(F.count("*").alias("n"))
    return t.select("ch").distinct().join(n, "ch", "left").select("ch", F.coalesce("n", F.lit(0)).alias("n"))


@register("a11_unusual_rate", "SELECT o_orderpriority AS kind, round(count(*) FILTER (WHERE o_totalprice > 200000) / greatest(1, count(*) FILTER (WHERE o_totalprice > 100000)), 9) AS rate FROM orders GROUP BY 1")
def a11(spark, sf):
    """Ratio of sums with a denominator of at least one."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.round(F.count_if(F.col("o_totalprice") > 200000) / F.greatest(F.lit(1), F.count_if(F.col("o_totalprice") > 100000)), 9).alias("rate"))


VOTES_SQL = """(SELECT 'p' || (user_id % 2) AS packet_id, 'r' || (user_id % 17) AS reviewer_id, 'e' || (event_id - event_id % 3) AS event_id,
 (event_id * 7) % 200 AS case_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'withdraw' ELSE 'skip' END AS choice, event_id AS arrival FROM events)"""
EFFECTIVE_SQL = f"""(SELECT packet_id, reviewer_id, case_id, arg_max(choice, arrival) AS choice FROM
  (SELECT * FROM {VOTES_SQL} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival) = 1) GROUP BY 1, 2, 3 HAVING arg_max(choice, arrival) <> 'withdraw')"""


def votes(spark, sf):
    """A vote log from ``events``: some events are retries of the one before."""
    e = table(spark, sf, "events")
    choice = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "B").when(F.col("event_type") == "purchase", "withdraw").otherwise("skip")
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return e.select(c("p", F.col("user_id") % 2).alias("packet_id"), c("r", F.col("user_id") % 17).alias("reviewer_id"), c("e", F.col("event_id") - F.col("event_id") % 3).alias("event_id"), ((F.col("event_id") * 7) % 200).alias("case_id"), choice.alias("choice"), F.col("event_id").alias("arrival"))


@register("w08_effective_votes", f"SELECT * FROM {EFFECTIVE_SQL}")
def w08(spark, sf):
    """Effective votes of an append-only log (W8, ST2)."""
    return V.effective_votes(votes(spark, sf))


@register("a13_vote_tally", f"SELECT packet_id, count(*) FILTER (WHERE choice = 'A') AS a, count(*) FILTER (WHERE choice = 'B') AS b, count(*) FILTER (WHERE choice = 'skip') AS skips, count(DISTINCT reviewer_id) AS reviewers FROM {EFFECTIVE_SQL} GROUP BY packet_id")
def a13(spark, sf):
    return V.tally(V.effective_votes(votes(spark, sf)), ["packet_id"])


@register("a14_review_gates", f"""
WITH g AS (SELECT count(*) AS reviewed, count(*) FILTER (WHERE choice IN ('A', 'B')) AS decisive, count(*) FILTER (WHERE choice = 'A') AS wins FROM {EFFECTIVE_SQL}),
p AS (SELECT *, wins / decisive AS p, decisive::DOUBLE AS n FROM g)
SELECT reviewed, decisive, wins, round(wins / 200, 9) AS share,
 round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 9) AS low,
 round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 9) AS high,
 reviewed = 200 AND decisive >= 160 AND wins >= 120 AS passed FROM p""")
def a14(spark, sf):
    """Review tally with gates and Wilson interval."""
    g = V.gates(V.effective_votes(votes(spark, sf)))
    return g.select("reviewed", "decisive", "wins", *(F.round(c, 9).alias(c) for c in ("share", "low", "high")), "passed")


@register("f11_invalid_votes", f"SELECT event_id, 'packet' AS rule FROM {VOTES_SQL} WHERE packet_id <> 'p1'")
def f11_votes(spark, sf):
    return V.invalid_votes(votes(spark, sf), "p1")


@register("a16_paired_t", """
WITH d AS (SELECT o_orderkey // 5 AS arm, o_totalprice / 1e7 - 0.015 AS diff FROM orders),
s AS (SELECT arm, count(diff) AS pairs, avg(diff) AS mean, stddev_samp(diff) AS sd FROM d GROUP BY arm),
i AS (SELECT arm, pairs, mean, CASE WHEN pairs = 5 THEN mean - 2.7764451051977987 * sd / sqrt(5) END AS low, CASE WHEN pairs = 5 THEN mean + 2.7764451051977987 * sd / sqrt(5) END AS high FROM s)
SELECT arm, pairs, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high,
 CASE WHEN high < 0 THEN 'lower' WHEN low > 0 THEN 'higher' WHEN low IS NOT NULL THEN 'unclear' ELSE 'incomplete' END AS direction, low > -0.01 AND high < 0.01 AS equivalent FROM i""")
def a16(spark, sf):
    """Paired t interval over exactly five pairs, direction and equivalence."""
    d = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 5).alias("arm"), (F.col("o_totalprice") / 1e7 - 0.015).alias("diff"))
    t = ST.paired_t(d, ["arm"], "diff")
    return t.select("arm", "pairs", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")), "direction", "equivalent")


@register("a17_numpy_bootstrap")
def a17n(spark, sf):
    """The numpy draws of the paired bootstrap, 20,000 per set of books."""
    w = windows(spark, sf).withColumn("set", F.col("book") % 97)
    return ST.numpy_bootstrap(w, ["set"], "nats_a", "nats_b", "nats_a", "bytes")


@register("a17_window_bootstrap")
def a17k(spark, sf):
    """Paired window bootstrap: 20,000 draws of as many windows as there are, with replacement."""
    w = windows(spark, sf).select((F.col("nats_b") - F.col("nats_a")).alias("num"), F.col("bytes").alias("den"))
    return ST.interval(ST.resampled_ratios(w, "num", "den"), "ratio").select(F.round("low", 12).alias("low"), F.round("high", 12).alias("high"), "draws")


@register("a18_cluster_bootstrap")
def a18k(spark, sf):
    """Bootstrap over whole books, 20,000 draws of as many books as there are: sums per book first."""
    w = windows(spark, sf).groupBy("book").agg(F.sum(F.col("nats_b") - F.col("nats_a")).alias("num"), F.sum("bytes").alias("den"))
    w = w.withColumn("num", F.round("num", 9))  # a book's sum is the same in whatever order its windows come
    return ST.interval(ST.resampled_ratios(w, "num", "den"), "ratio").select(F.round("low", 12).alias("low"), F.round("high", 12).alias("high"), "draws")


@register("a20_pass_counts", "SELECT l_linestatus AS act, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS passed FROM lineitem GROUP BY ROLLUP (l_linestatus)")
def a20(spark, sf):
    """Pass counts by act with the total."""
    return table(spark, sf, "lineitem").rollup(F.col("l_linestatus").alias("act")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("passed"))


@register("a21_pair_scores", """
SELECT count(*) AS pairs, count(*) FILTER (WHERE ok) AS approved FROM (SELECT l_orderkey, bool_and(l_returnflag = 'N') AS ok FROM lineitem GROUP BY 1 HAVING count(*) = 2)""")
def a21(spark, sf):
    """Complete pairs, and those with both members approved."""
    p = J.complete_pairs(table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "N").alias("ok")), "l_orderkey", "ok")
    return p.agg(F.count("*").alias("pairs"), F.count_if("both").alias("approved"))


@register("a22_min_distinct", "SELECT min(n) AS fewest, max(n) AS most FROM (SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY source)")
def a22(spark, sf):
    """Distinct replies per act, and the extremes over acts."""
    g = table(spark, sf, "documents").groupBy("source").agg(F.countDistinct("text").alias("n"))
    return g.agg(F.min("n").alias("fewest"), F.max("n").alias("most"))


@register("a23_corpus_report", """
SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'depth' END AS dimension,
 coalesce(lang, source, CAST(n_chars // 1000 AS VARCHAR)) AS value, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (n_chars // 1000))""")
def a23(spark, sf):
    """Counts by several dimensions in one pass."""
    d = table(spark, sf, "documents").withColumn("depth", F.floor(F.col("n_chars") / 1000).cast("long"))
    g = d.groupingSets([["lang"], ["source"], ["depth"]], "lang", "source", "depth").agg(F.count("*").alias("n"), F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"))
    dim = F.when(F.col("gl") == 0, "lang").when(F.col("gs") == 0, "source").otherwise("depth")
    return g.select(dim.alias("dimension"), F.coalesce("lang", "source", F.col("depth").cast("string")).alias("value"), "n")


_POOL = "CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'validation' ELSE 'test' END"


@register("x23_split_assembly", f"""
WITH u AS (SELECT c_custkey AS i, c_mktsegment AS kind, CAST('0x' || substr(sha256(c_name), 1, 8) AS BIGINT) % 10 AS b, false AS mind FROM customer
  UNION ALL SELECT s_suppkey, CAST(s_nationkey AS VARCHAR), CAST('0x' || substr(sha256(s_name), 1, 8) AS BIGINT) % 10, true FROM supplier),
s AS (SELECT *, {_POOL} AS split FROM u),
r AS (SELECT i, kind, mind, split, unnest(range(0, CASE split WHEN 'train' THEN 3 ELSE 1 END)) AS r FROM s UNION ALL SELECT i, kind, mind, 'wording', 0 FROM s WHERE split = 'test')
SELECT split, CASE WHEN mind THEN 9 + (i // 2 + r * 4) % 4 ELSE (i // 2 + r * 4) % 9 END AS act, count(*) AS rows, count(*) FILTER (WHERE mind) AS with_mind, count(DISTINCT kind) AS kinds,
  sum(CAST('0x' || substr(md5(i || ':' || kind || ':' || r), 1, 8) AS BIGINT))::BIGINT AS digest FROM r GROUP BY ALL""")
def x23(spark, sf):
    """Splits put together from accounts (nine acts) and minds (four more): training rows three times
    over, each time under another act, the test rows once more as the wording split; reported by
    split and act, with a digest of the rows (X23)."""
    from ..operators.splits import name_split

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.col("c_mktsegment").alias("kind"), name_split(F.col("c_name")).alias("split"), F.lit(False).alias("mind"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("string").alias("kind"), name_split(F.col("s_name")).alias("split"), F.lit(True).alias("mind"))
    u = c.unionByName(s)
    times = F.when(F.col("split") == "train", 3).otherwise(1)
    rows = u.withColumn("r", F.explode(F.sequence(F.lit(0), times - 1))).unionByName(u.filter("split = 'test'").withColumn("split", F.lit("wording")).withColumn("r", F.lit(0)))
    act = F.when(F.col("mind"), G.cyclic(F.col("i"), F.col("r"), 4, 4) + 9).otherwise(G.cyclic(F.col("i"), F.col("r"), 4, 9))
    part = F.conv(F.substring(F.md5(F.concat_ws(":", "i", "kind", "r")), 1, 8), 16, 10).cast("long")
    return rows.groupBy("split", act.alias("act")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("mind").alias("with_mind"), F.countDistinct("kind").alias("kinds"), F.sum(part).alias("digest"))


@register("a24_failure_breakdown", """
WITH k AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_partkey % 3 = 0)
SELECT p_brand, count(*) FILTER (WHERE own) AS own_cell, count(*) FILTER (WHERE NOT own AND other) AS another, count(*) FILTER (WHERE NOT own AND NOT other) AS unknown FROM
 (SELECT p_brand, (p_brand, p_type) IN (SELECT (p_brand, p_type) FROM k) AS own, p_type IN (SELECT p_type FROM k) AS other FROM part) GROUP BY p_brand""")
def a24(spark, sf):
    """Wordings known to their own cell, to another, or to none."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    k = p.filter("p_partkey % 3 = 0").select("p_brand", "p_type").distinct()
    j = p.join(k.withColumn("own", F.lit(True)), ["p_brand", "p_type"], "left").join(k.select("p_type").distinct().withColumn("other", F.lit(True)), "p_type", "left")
    return j.groupBy("p_brand").agg(F.count("own").alias("own_cell"), F.count_if(F.col("own").isNull() & F.col("other").isNotNull()).alias("another"), F.count_if(F.col("own").isNull() & F.col("other").isNull()).alias("unknown"))


@register("a25_style_cube", "SELECT l_linestatus AS creature, l_returnflag AS emotion, count(*) AS n, count(*) FILTER (WHERE l_tax > 0.04) AS joint FROM lineitem GROUP BY CUBE (l_linestatus, l_returnflag)")
def a25(spark, sf):
    """Style scores with all marginals."""
    return table(spark, sf, "lineitem").cube(F.col("l_linestatus").alias("creature"), F.col("l_returnflag").alias("emotion")).agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") > 0.04).alias("joint"))


@register("a26_factorial_effects", """
WITH c AS (SELECT avg(v) FILTER (WHERE f1 = 0 AND f2 = 0) AS a, avg(v) FILTER (WHERE f1 = 0 AND f2 = 1) AS b, avg(v) FILTER (WHERE f1 = 1 AND f2 = 0) AS c, avg(v) FILTER (WHERE f1 = 1 AND f2 = 1) AS d
 FROM (SELECT o_orderkey % 2 AS f1, o_custkey % 2 AS f2, o_totalprice AS v FROM orders))
SELECT round((c + d - a - b) / 2, 4) AS f1_effect, round((b + d - a - c) / 2, 4) AS f2_effect, round(d - c - b + a, 4) AS interaction FROM c""")
def a26(spark, sf):
    d = table(spark, sf, "orders").select((F.col("o_orderkey") % 2).alias("f1"), (F.col("o_custkey") % 2).alias("f2"), F.col("o_totalprice").alias("v"))
    return ST.factorial_effects(d, "v").select(*(F.round(c, 4).alias(c) for c in ("f1_effect", "f2_effect", "interaction")))


@register("a27_utility_judge", """
WITH u AS (SELECT l_orderkey AS prompt, l_linenumber AS action, l_extendedprice AS utility FROM lineitem),
p AS (SELECT prompt, max(utility) AS best, avg(utility) AS mean, arg_min(utility, action * 10000000 + utility) AS chosen, count(*) FILTER (WHERE utility < 2000) AS bad FROM u GROUP BY prompt)
SELECT round(avg(chosen), 4) AS chosen, round(avg(best), 4) AS best, round(avg(mean), 4) AS mean, round(avg((chosen = best)::INT), 9) AS hit_rate, sum(bad)::BIGINT AS bad FROM p""")
def a27(spark, sf):
    """Chosen, best and mean utility, hit rate and catastrophes."""
    u = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"), F.avg("l_extendedprice").alias("mean"), F.min_by("l_extendedprice", F.struct("l_linenumber", "l_extendedprice")).alias("chosen"), F.count_if(F.col("l_extendedprice") < 2000).alias("bad"))
    return u.agg(F.round(F.avg("chosen"), 4).alias("chosen"), F.round(F.avg("best"), 4).alias("best"), F.round(F.avg("mean"), 4).alias("mean"), F.round(F.avg((F.col("chosen") == F.col("best")).cast("int")), 9).alias("hit_rate"), F.sum("bad").alias("bad"))


@register("a29_majority_class", "SELECT source, arg_max(lang, n * 1000 - ascii(lang)) AS lang, round(max(n) / sum(n), 9) AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def a29(spark, sf):
    """Majority label and its share."""
    g = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return g.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.ascii("lang"))).alias("lang"), F.round(F.max("n") / F.sum("n"), 9).alias("share"))


@register("a30_medians", "SELECT o_orderpriority AS kind, median(o_totalprice) AS median, round(quantile_cont(o_totalprice, 0.95), 1) AS p95, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 6) AS weighted FROM orders GROUP BY 1")
def a30(spark, sf):
    """Median, interpolated quantile and weighted mean."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.median("o_totalprice").alias("median"), F.round(F.percentile("o_totalprice", F.lit(0.95)), 1).alias("p95"), F.round(F.sum(F.col("o_totalprice") * F.col("o_custkey")) / F.sum("o_custkey"), 6).alias("weighted"))


@register("a33_multiset_digest", "SELECT n_regionkey, sha256(string_agg(n_nationkey || ':' || n_name, '|' ORDER BY n_nationkey)) AS digest FROM nation GROUP BY n_regionkey")
def a33(spark, sf):
    """Digest of a sorted canonical listing."""
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["n_nationkey"].cast("string"), F.lit(":"), r["n_name"])), "|")
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sha2(text, 256).alias("digest"))


@register("a35_vocabulary", f"SELECT DISTINCT unnest({W}) AS word FROM documents UNION SELECT DISTINCT unnest({W}) FROM conversations")
def a35(spark, sf):
    """Set of words over several fields."""
    w = lambda t: table(spark, sf, t).select(F.explode(X.lower_words(F.col("text"))).alias("word"))
    return w("documents").union(w("conversations")).distinct()


@register("a38_conversation_metrics", """
SELECT conv_id, count(*) AS lines, count(DISTINCT text) AS distinct_lines, count(*) FILTER (WHERE regexp_matches(text, '[.!?]$')) AS stopped, count(*) FILTER (WHERE trim(text) = '') AS empty, arg_max(text, turn) AS final FROM conversations GROUP BY conv_id""")
def a38(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("lines"), F.countDistinct("text").alias("distinct_lines"), F.count_if(F.col("text").rlike(r"[.!?]\z")).alias("stopped"), F.count_if(F.trim("text") == "").alias("empty"), F.max_by("text", "turn").alias("final"))


@register("a39_stream_totals", "SELECT lang, count(*) AS records, sum(length(text))::BIGINT AS characters, sum(len(string_split(text, ' ')))::BIGINT AS tokens FROM documents GROUP BY lang")
def a39(spark, sf):
    """Record, character and token totals."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("characters"), F.sum(F.size(F.split("text", " "))).alias("tokens"))


@register("a41_projection", "SELECT lang, round(sum(n_chars) / 3600.0 * 1.3, 6) AS hours FROM documents GROUP BY lang")
def a41(spark, sf):
    """Projected hours with a margin of 30 %."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.sum("n_chars") / 3600.0 * 1.3, 6).alias("hours"))


@register("x38_mean_of_means", "SELECT round(avg(m), 6) AS loss FROM (SELECT l_orderkey // 32 AS batch, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1)")
def x38(spark, sf):
    """Unweighted mean of batch means."""
    b = table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 32)).agg(F.avg("l_extendedprice").alias("m"))
    return b.agg(F.round(F.avg("m"), 6).alias("loss"))


@register("j01_strict_lookup", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j01(spark, sf):
    """Inner join where a missing key is an error."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return J.strict_lookup(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"])


@register("j02_dimension_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j02(spark, sf):
    """Rows with their rules: fixed-size dimensions are broadcast."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    d = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey))
    return table(spark, sf, "customer").join(d, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@register("j03_composite_lookup", """
SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def j03(spark, sf):
    """Two lookups by a composite key."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("a"), "b")


@register("j05_asof_books", """
WITH b AS (SELECT source, doc_id AS book, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS start, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS "end" FROM documents),
p AS (SELECT source, doc_id AS point, (doc_id * 977) % 60000 AS at FROM documents)
SELECT p.point, p.at, b.book, b.start::BIGINT AS start FROM p LEFT JOIN b ON p.source = b.source AND p.at >= b.start AND p.at < b."end" """)
def j05(spark, sf):
    """As-of join of positions with the book ranges that contain them."""
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    r = Q.numbered(d, ["source"], ["doc_id"], "nth", length="n_chars")
    r = r.select("source", F.col("doc_id").alias("book"), "start", (F.col("start") + F.col("n_chars")).alias("end")).filter("end > start")
    p = d.select("source", F.col("doc_id").alias("point"), ((F.col("doc_id") * 977) % 60000).alias("at"))
    return J.asof_ranges(p, r, "at", "start", "end", ["source"]).select("point", "at", "book", "start")


@register("j13_explicit_reply", """
WITH m AS (SELECT conv_id, turn, 'm' || (turn % 3) AS id, CASE WHEN turn % 2 = 1 THEN 'm' || ((turn + 1) % 3) ELSE '' END AS reply FROM conversations)
SELECT m.conv_id, m.turn, min(p.turn) AS parent_pos FROM m LEFT JOIN m p ON p.conv_id = m.conv_id AND m.reply <> '' AND p.id = m.reply AND p.turn < m.turn GROUP BY 1, 2""")
def j13(spark, sf):
    """First earlier message that an explicit reply names."""
    turn = F.col("turn")
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("m"), (turn % 3).cast("string")).alias("id"), F.when(turn % 2 == 1, F.concat(F.lit("m"), ((turn + 1) % 3).cast("string"))).otherwise("").alias("reply"))
    return J.first_reply(m, "conv_id", "turn", "id", "reply").select("conv_id", "turn", "parent_pos")


@register("j15_grid", "SELECT item_id, t.v AS temperature, k.v AS top_k, p.v AS penalty FROM benchmark, (VALUES (0.7), (0.9)) t(v), (VALUES (20), (40), (80)) k(v), (VALUES (1.0), (1.1)) p(v)")
def j15(spark, sf):
    """Every prompt under each setting of a grid of small axes."""
    g = G.grid(spark, temperature=[0.7, 0.9], top_k=[20, 40, 80], penalty=[1.0, 1.1])
    return table(spark, sf, "benchmark").select("item_id").join(F.broadcast(g))


@register("j16_variants", "SELECT doc_id, v AS variant, t AS turn FROM documents, range(0, 2) a(v), range(0, 4) b(t)")
def j16(spark, sf):
    """Row by variant by turn expansion."""
    rng = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return table(spark, sf, "documents").select("doc_id", rng(2).alias("variant")).withColumn("turn", rng(4))


@register("t01_multi_key_sort", "SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) AS rank FROM documents ORDER BY rank LIMIT 40")
def t01(spark, sf):
    """First 40 rows of a multi-key order (T-1, T-9)."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents").select("source", "doc_id").orderBy("source", "doc_id").limit(40)
    return d.withColumn("rank", F.row_number().over(Window.orderBy("source", "doc_id")))


@register("t04_candidates", """
WITH t AS (SELECT doc_id, source, n_chars AS weight FROM documents)
SELECT source, doc_id, weight FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, doc_id) <= 5""")
def t04(spark, sf):
    """Top candidates by weight, ties to the smaller token (T-3, T-4)."""
    return Q.first_per_key(table(spark, sf, "documents").select("source", "doc_id", F.col("n_chars").alias("weight")), ["source"], [F.desc("weight"), "doc_id"], 5)


@register("t07_every_kth", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) % 7 = 1 OR row_number() OVER (PARTITION BY lang ORDER BY doc_id) % 7 = 0")
def t07(spark, sf):
    """Every k-th row of an order (T-7)."""
    d = Q.numbered(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"])
    return d.filter("n % 7 in (0, 1)").drop("n")


@register("t08_even_selection", """
WITH d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY lang) AS c FROM documents),
i AS (SELECT DISTINCT lang, c, unnest(range(0, 90)) AS i FROM d)
SELECT i.lang, i, doc_id FROM i JOIN d ON d.lang IS NOT DISTINCT FROM i.lang AND d.n = i.i * i.c // 90""")
def t08(spark, sf):
    """Ninety evenly spaced rows of each stream (T-8)."""
    return Q.even_selection(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 90)


@register("t06_similar_strings")
def t06(spark, sf):
    """Three nearest part names by sequence-matcher ratio, among parts of the same brand (T-6, SF30)."""
    from ..operators.retrieval import nearest_strings

    p = table(spark, sf, "part")
    return nearest_strings(p, "p_brand", "p_partkey", "p_name", 3)


@register("sf37_log_softmax", """
SELECT l_orderkey, l_linenumber, round(l_tax * 10 - ln(sum(exp(l_tax * 10)) OVER (PARTITION BY l_orderkey)), 9) AS log_p FROM lineitem""")
def sf37(spark, sf):
    """Log-softmax over the candidates of a prompt."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 10).alias("score"))
    return ST.log_softmax(d, ["l_orderkey"], "score").select("l_orderkey", "l_linenumber", F.round("log_p", 9).alias("log_p"))


@register("sf38_penalised_weights", """
SELECT l_orderkey, l_linenumber, round(exp((CASE WHEN l_returnflag = 'R' THEN l_tax * 10 / 1.1 ELSE l_tax * 10 END) / 0.8), 9) AS weight FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY exp((CASE WHEN l_returnflag = 'R' THEN l_tax * 10 / 1.1 ELSE l_tax * 10 END) / 0.8) DESC, l_linenumber) <= 3""")
def sf38(spark, sf):
    """Repetition-penalised, temperature-scaled top-k weights."""
    s = F.col("l_tax") * 10
    w = F.exp(F.when(F.col("l_returnflag") == "R", s / 1.1).otherwise(s) / 0.8)
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", w.alias("weight"))
    return Q.first_per_key(d, ["l_orderkey"], [F.desc("weight"), "l_linenumber"], 3).withColumn("weight", F.round("weight", 9))


@register("x06_learning_rate", """
WITH s AS (SELECT o_orderkey, o_orderkey % 100 AS step FROM orders)
SELECT o_orderkey, round(CASE WHEN step < 10 THEN 0.001 * (step + 1) / 10 ELSE 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * (step - 10) / 90.0))) END, 12) AS rate FROM s""")
def x06(spark, sf):
    """Warm-up and cosine learning rates of the steps of runs of a hundred."""
    step = F.col("o_orderkey") % 100
    return table(spark, sf, "orders").select("o_orderkey", F.round(ST.learning_rate(step, 100, 0.001, 10), 12).alias("rate"))


@register("g30_bearings", "SELECT event_id, round((((degrees(atan2(value - 50, user_id - 50)) - event_id % 360) + 180) % 360 + 360) % 360 - 180, 6) AS bearing FROM events")
def g30(spark, sf):
    """Relative bearings wrapped to ±180 (G30, SF27)."""
    b = F.degrees(F.atan2(F.col("value") - 50, F.col("user_id") - 50)) - F.col("event_id") % 360
    return table(spark, sf, "events").select("event_id", F.round(F.pmod(b + 180, F.lit(360.0)) - 180, 6).alias("bearing"))


@register("g31_gumbel_top_k", """
WITH u AS (SELECT l_orderkey, l_linenumber, ln(l_extendedprice) - ln(-ln(CAST('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 + 1e-16)) AS g FROM lineitem)
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(g, 9) DESC, l_linenumber)::INT AS draw FROM u QUALIFY draw <= 2""")
def g31(spark, sf):
    """Two proposals per prompt without replacement, by weight."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.ln(F.col("l_extendedprice")).alias("lw"))
    return G.gumbel_top_k(d, ["l_orderkey"], "l_linenumber", "lw", 2).select("l_orderkey", "l_linenumber", "draw")


@register("g16_counterfactual_pairs", """
WITH d AS (SELECT c_custkey, c_mktsegment AS own, list_filter(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], lambda x: x <> c_mktsegment) AS o FROM customer),
p AS (SELECT *, o[1 + CAST('0x' || substr(md5('swap:' || c_custkey), 1, 8) AS BIGINT) % len(o)] AS other FROM d)
SELECT c_custkey AS pair, m AS member, CASE WHEN m = 0 THEN own ELSE other END AS c_mktsegment, own AS changed_from, other AS changed_to FROM p, range(0, 2) r(m)""")
def g16(spark, sf):
    """Counterfactual pairs: one field changed, all else equal."""
    pool = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    d = G.counterfactual_pairs(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", pool)
    return d.select("pair", "member", "c_mktsegment", "changed_from", "changed_to")


@register("g14_cyclic_acts", "SELECT doc_id, r AS repeat, (doc_id // 2 + r * 4) % 13 AS act FROM documents, range(0, 3) x(r)")
def g14(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("repeat"))
    return d.select("doc_id", "repeat", G.cyclic(F.col("doc_id"), F.col("repeat"), 4, 13).alias("act"))


@register("g23_accepted_forms", """
SELECT n_nationkey, list_sort(list_distinct(flatten(list_transform(['they saw ' || n_name, n_name || ' was seen near ' || n_regionkey], lambda s: list_transform(['.', '!'], lambda e: upper(left(s, 1)) || substr(s, 2) || e))))) AS accepted FROM nation""")
def g23(spark, sf):
    """Accepted sentences: templates filled, capitalised, with each ending."""
    arr = lambda *x: F.array(*(F.lit(i) for i in x))
    forms = G.accepted_forms(arr("they saw {0}.", "{0} was seen near {1}."), F.array(F.col("n_name"), F.col("n_regionkey").cast("string")), arr(".", "!"))
    return table(spark, sf, "nation").select("n_nationkey", F.sort_array(forms).alias("accepted"))


@register("g22_tiers", "SELECT doc_id, CASE WHEN n_chars % 100 < 40 THEN 'rumour' WHEN n_chars % 2 = 0 THEN 'hearsay' ELSE 'witness' END AS tier, (ascii(source) + n_chars) % 3 AS family FROM documents")
def g22(spark, sf):
    """Tiers (G22) and families (G24) by rule."""
    return table(spark, sf, "documents").select("doc_id", G.tier(F.col("n_chars") % 100, F.col("n_chars") % 2 == 0).alias("tier"), ((F.ascii("source") + F.col("n_chars")) % 3).alias("family"))
