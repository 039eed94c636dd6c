"""Queries of windows, streams, dialogue, retrieval, kernels, sources and streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dialogue as D
from ..operators import retrieval as R
from ..operators import sequence as Q
from ..operators import tokens as TK
from .registry import register, table

REC_SQL = "(SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS start FROM documents)"


def records(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars")


@register("w01_running_offset", f"SELECT doc_id, start::BIGINT AS start FROM {REC_SQL}")
def w01(spark, sf):
    """Start of each record in one stream, by bucket sums and running sums (W1, SK3)."""
    return Q.distributed_offsets(records(spark, sf), "doc_id", "n_chars").select("doc_id", "start")


@register("w02_token_offsets", r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t WHERE len(w) > 0)
SELECT doc_id, sum(start)::BIGINT AS checksum, max(start + n)::BIGINT AS total FROM (SELECT doc_id, strlen(w) AS n, sum(strlen(w)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(w) AS start FROM e) GROUP BY doc_id""")
def w02(spark, sf):
    """Byte offsets of tokens inside a document, as a fold over the array."""
    acc = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("sum"))
    fold = F.aggregate(X.words(F.col("text")), acc, lambda a, w: F.struct((a["at"] + F.octet_length(w)).alias("at"), (a["sum"] + a["at"]).alias("sum")))
    return table(spark, sf, "documents").select("doc_id", fold.alias("f")).filter("f.at > 0").select("doc_id", F.col("f.sum").alias("checksum"), F.col("f.at").alias("total"))


@register("w03_contiguity", f"""
WITH r AS (SELECT doc_id % 5 AS part, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) - n_chars + (CASE WHEN doc_id % 50 = 7 THEN 1 ELSE 0 END) AS start FROM documents)
SELECT doc_id, gap FROM (SELECT doc_id, coalesce(lag(start + n_chars) OVER (PARTITION BY part ORDER BY start), 0) <> start AS gap FROM r) WHERE gap""")
def w03(spark, sf):
    """Index records that leave a gap or overlap (planted here)."""
    d = records(spark, sf).withColumn("part", F.col("doc_id") % 5)
    d = d.withColumn("start", Q.running_offset(F.col("n_chars"), ["part"], ["doc_id"]) + F.when(F.col("doc_id") % 50 == 7, 1).otherwise(0))
    return Q.contiguity_violations(d, ["part"], "start", "n_chars", "doc_id").select("doc_id", "gap")


@register("w04_merge_adjacent", """
WITH d AS (SELECT source, doc_id, lang, lang IS DISTINCT FROM lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS new FROM documents),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM d)
SELECT source, lang, min(doc_id) AS start, max(doc_id) + 1 AS "end" FROM r GROUP BY source, lang, run""")
def w04(spark, sf):
    """Consecutive rows of one value as one range."""
    d = table(spark, sf, "documents").select("source", "lang", F.col("doc_id").alias("s"), (F.col("doc_id") + 1).alias("e"))
    return Q.merge_adjacent(d, ["source"], "s", "e", "lang")


@register("w05_run_lengths", """
WITH e AS (SELECT user_id, event_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS new FROM events)
SELECT user_id, event_id, (sum(new::INT) OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS run FROM e""")
def w05(spark, sf):
    """Threads by run length: a value that returns starts a new one."""
    return Q.run_ids(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_id", "run")


@register("w06_carry_forward", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS speaker FROM events""")
def w06(spark, sf):
    """Speaker carried forward to the lines below it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("speaker"))


@register("w07_sliding_context", """
SELECT conv_id, turn, list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS context FROM conversations""")
def w07(spark, sf):
    """The three messages before each."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.collect_list("turn").over(w).alias("context"))
    return d.withColumn("context", F.when(F.size("context") > 0, F.col("context")))


@register("w09_memory_blocks", """
SELECT conv_id, turn, list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS block FROM conversations QUALIFY turn % 2 = 1""")
def w09(spark, sf):
    """Two-message blocks at odd places."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.collect_list("turn").over(w).alias("block")).filter("turn % 2 = 1")


@register("w10_roles", """
WITH m AS (SELECT conv_id, turn, role FROM conversations),
c AS (SELECT conv_id, turn, role, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ctx FROM m)
SELECT conv_id, turn, array_to_string(list_transform(ctx, lambda x: CASE WHEN x = role THEN 'Z' ELSE
  substr('ABC', len(list_distinct(list_filter(ctx[1:list_position(ctx, x)], lambda y: y <> role)))::INT, 1) END), '') AS roles FROM c WHERE len(ctx) > 0""")
def w10(spark, sf):
    """Anonymous roles: the target's speaker is Z, others A, B, C as they first appear."""
    return D.context_roles(table(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "roles")


@register("w13_bounded_history", """
SELECT conv_id, turn, array_to_string(list(CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END || ':' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ' / ') AS history FROM conversations""")
def w13(spark, sf):
    """Last four turns with speakers."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    item = F.concat(F.when(F.col("turn") % 2 == 0, "a").otherwise("b"), F.lit(":"), "text")
    h = F.collect_list(item).over(w)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.size(h) > 0, F.array_join(h, " / ")).alias("history"))


@register("w14_round_robin", """
WITH r AS (SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 2 AS deal FROM documents)
SELECT doc_id, lang, deal FROM r ORDER BY deal, lang, doc_id LIMIT 60""")
def w14(spark, sf):
    """Rows dealt group by group, two at a time."""
    return Q.round_robin(table(spark, sf, "documents").select("lang", "doc_id"), "lang", ["doc_id"], 60, block=2).select("doc_id", "lang", "deal")


@register("w16_first_per_key", "SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1")
def w16(spark, sf):
    """First row of each key in order."""
    return Q.first_per_key(table(spark, sf, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


@register("w18_best_so_far", """
SELECT event_id, min(value) OVER w AS best, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w18(spark, sf):
    return Q.best_so_far(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("event_id", "best", "improved")


@register("w19_early_stop", """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1e-5, true) AS improved FROM events),
s AS (SELECT user_id, event_id, n - max(CASE WHEN improved THEN n END) OVER (PARTITION BY user_id ORDER BY event_id) AS since FROM e)
SELECT user_id, min(event_id) AS stop_step FROM s WHERE since >= 3 GROUP BY user_id""")
def w19(spark, sf):
    """First report after three without improvement."""
    return Q.early_stop(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 3, 1e-5)


@register("w20_argmin_step", "SELECT user_id, arg_min(event_id, value * 1000000 + event_id / 1000000.0) AS step FROM events GROUP BY user_id")
def w20(spark, sf):
    """Step of the lowest loss per stream, earliest of equals."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("step"))


@register("w21_window_starts", """
SELECT doc_id, i::INT AS i, (i * greatest(n_chars - 1, 0) // 9)::BIGINT AS whole FROM documents, range(0, 10) r(i)""")
def w21(spark, sf):
    """Evenly spaced starts by integers (W22); the float form is W21."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(Q.integer_starts(F.greatest(F.col("n_chars"), F.lit(1)), 10)).alias("i", "whole"))
    return d.select("doc_id", "i", "whole")


@register("w21_linspace", "SELECT doc_id, list_transform(range(0, 10), lambda i: floor(0 + i * (n_chars - 0) / 9.0::DOUBLE)::BIGINT) AS starts FROM documents")
def w21f(spark, sf):
    """Evenly spaced starts by floats, truncated."""
    return table(spark, sf, "documents").select("doc_id", Q.linspace_starts(F.lit(0), F.col("n_chars"), 10).alias("starts"))


@register("w23_cyclic_windows", """
WITH c AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda x: ascii(x)) AS s FROM conversations WHERE length(text) > 0)
SELECT conv_id, turn, list_transform(range(0, 8), lambda i: CASE WHEN i < 6 THEN s[1 + (turn + i) % len(s)] ELSE -100 END) AS win FROM c""")
def w23(spark, sf):
    """Windows that wrap round a stream, with a masked tail."""
    d = table(spark, sf, "conversations").filter("length(text) > 0").select("conv_id", "turn", F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c)).alias("s"))
    return d.select("conv_id", "turn", Q.cyclic_window(F.col("s"), F.col("turn"), 8, total=F.lit(6)).alias("win"))


@register("w24_roster", """
WITH t AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS base, sum(n_chars) OVER () AS total FROM documents),
u AS (SELECT *, (total * 5 // 2)::BIGINT AS budget, unnest([0, 1, 2]) AS epoch FROM t),
v AS (SELECT doc_id, epoch, budget, (epoch * total + base)::BIGINT AS start, n_chars FROM u)
SELECT doc_id, epoch, start, least(n_chars, budget - start)::BIGINT AS take FROM v WHERE least(n_chars, budget - start) > 0""")
def w24(spark, sf):
    """Records visited again and again until 2.5 times the table's size is met, at any size."""
    r = records(spark, sf)
    total = r.agg(F.sum("n_chars")).first()[0] or 0
    return Q.roster(r, "doc_id", "n_chars", total * 5 // 2).select("doc_id", "epoch", "start", "take")


@register("w25_record_packing", f"""
WITH r AS (SELECT doc_id, n_chars, start::BIGINT AS start FROM {REC_SQL} WHERE n_chars > 0),
p AS (SELECT doc_id, start, n_chars, unnest(range(start // 1024, (start + n_chars - 1) // 1024 + 1)) AS pack FROM r)
SELECT doc_id, pack, greatest(start, pack * 1024) - pack * 1024 AS "offset", least(start + n_chars, (pack + 1) * 1024) - greatest(start, pack * 1024) AS piece FROM p""")
def w25(spark, sf):
    """Records packed end to end into windows of 1024."""
    d = Q.distributed_offsets(records(spark, sf), "doc_id", "n_chars")
    return Q.pack_segments(d, "start", "n_chars", 1024).select("doc_id", "pack", "offset", "piece")


@register("w26_block_mask", f"""
WITH r AS (SELECT doc_id, n_chars, start::BIGINT AS start FROM {REC_SQL} WHERE n_chars > 0),
p AS (SELECT doc_id, start, n_chars, unnest(range(start // 1024, (start + n_chars - 1) // 1024 + 1)) AS pack FROM r),
s AS (SELECT pack, least(start + n_chars, (pack + 1) * 1024) - greatest(start, pack * 1024) AS piece FROM p)
SELECT pack, count(*) AS segments, sum(piece * (piece + 1) // 2)::BIGINT AS visible FROM s GROUP BY pack""")
def w26(spark, sf):
    """Visible pairs of a block-causal mask per pack, from segment lengths."""
    d = Q.pack_segments(Q.distributed_offsets(records(spark, sf), "doc_id", "n_chars"), "start", "n_chars", 1024)
    return d.groupBy("pack").agg(F.count("*").alias("segments"), F.sum(F.floor(F.col("piece") * (F.col("piece") + 1) / 2)).alias("visible"))


@register("w27_loss_mask", """
WITH c AS (SELECT conv_id, turn, string_split(text, '') AS s FROM conversations WHERE length(text) > 0),
e AS (SELECT conv_id, turn, unnest(s) AS ch, generate_subscripts(s, 1) AS i FROM c),
k AS (SELECT conv_id, turn, i, max(CASE WHEN ch = 'e' THEN i END) OVER w AS lon, max(CASE WHEN ch = ' ' THEN i END) OVER w AS loff FROM e WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, count(*) FILTER (WHERE lon IS NOT NULL AND (loff IS NULL OR lon > loff)) AS live FROM k GROUP BY 1, 2""")
def w27(spark, sf):
    """Loss mask from a marker up to the next end marker."""
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    d = table(spark, sf, "conversations").filter("length(text) > 0").select("conv_id", "turn", Q.mask_between(ids, ord("e"), ord(" ")).alias("m"))
    return d.select("conv_id", "turn", F.size(F.filter("m", lambda x: x)).cast("long").alias("live"))


@register("w31_context_reach", f"""
SELECT doc_id, start::BIGINT AS start, start % 4096 < 1024 AS crosses FROM {REC_SQL}""")
def w31(spark, sf):
    """Windows whose context reaches across a record's start."""
    return Q.distributed_offsets(records(spark, sf), "doc_id", "n_chars").select("doc_id", "start", (F.col("start") % 4096 < 1024).alias("crosses"))


@register("w33_shared_boundaries", r"""
WITH c AS (SELECT doc_id, string_split(text, '') AS s, length(text) AS n FROM documents),
o AS (SELECT doc_id, list_filter(range(1, n + 1), lambda i: s[i] = ' ') AS a, list_filter(range(1, n + 1), lambda i: s[i] IN ('.', ' ') AND i % 2 = 0) AS b FROM c)
SELECT doc_id, len(list_intersect(a, b))::INT AS shared, list_min(list_filter(list_intersect(a, b), lambda x: x >= 50)) AS first FROM o""")
def w33(spark, sf):
    """Boundaries that two tokenisers share, and the first inside the target."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    at = F.filter(F.transform(chars, lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i"))), lambda x: x["c"].isin(".", " "))
    places = lambda keep: lambda x: F.transform(F.filter(x, keep), lambda y: y["i"])
    first, second = places(lambda y: y["c"] == " "), places(lambda y: y["i"] % 2 == 0)
    d = table(spark, sf, "documents").select("doc_id", X.bind(at, lambda x: F.array_intersect(first(x), second(x))).alias("s"))
    return d.select("doc_id", F.size("s").alias("shared"), F.array_min(F.filter("s", lambda x: x >= 50)).alias("first"))


@register("x02_padded_rectangle", r"""
WITH w AS (SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN []::INT[] ELSE list_transform(string_split(text, ''), lambda x: ascii(x)) END AS s FROM conversations), m AS (SELECT max(len(s)) AS n FROM w)
SELECT conv_id, turn, list_concat(s, list_transform(range(0, n - len(s)), lambda x: 0)) AS row FROM w, m""")
def x02(spark, sf):
    """The ids of every whole text, padded to the longest; a null text is all padding."""
    ids = F.coalesce(F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c)), F.array().cast("array<int>"))
    c = table(spark, sf, "conversations")
    widest = c.agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    return c.select("conv_id", "turn", ids.alias("s")).crossJoin(F.broadcast(widest)).select("conv_id", "turn", TK.pad_to(F.col("s"), F.col("n"), F.lit(0)).alias("row"))


@register("x39_budgeted_messages", r"""
WITH c AS (SELECT conv_id, turn, right(trim(regexp_replace(text, '\s+', ' ', 'g')), 110) AS t FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM c WHERE t <> ''),
m AS (SELECT conv_id, max(t) FILTER (WHERE n = 1) AS a, max(t) FILTER (WHERE n = 2) AS b, max(t) FILTER (WHERE n = 3) AS c FROM n GROUP BY conv_id),
k AS (SELECT *, b IS NOT NULL AND length(b) + 5 <= 295 - length(a) AS two FROM m)
SELECT conv_id, CASE WHEN two AND c IS NOT NULL AND 290 - length(a) - length(b) > 24 AND length(c) + 5 <= 290 - length(a) - length(b) THEN [c, b, a] WHEN two THEN [b, a] ELSE [a] END AS recent FROM k""")
def x39(spark, sf):
    """Recent messages, newest first, within a budget of characters."""
    return D.budgeted_messages(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@register("x31_accept_gate", """
SELECT user_id, event_id, value, coalesce(value >= max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL) AS accepted FROM events""")
def x31(spark, sf):
    """Accept or restore: a round stands if its utility does not fall below the last accepted."""
    return D.accept_gate(table(spark, sf, "events"), "user_id", "event_id", "value")


@register("x40_context_memory", "SELECT doc_id, left(trim(regexp_replace(left(text, 48) || ' | ~' || left(source || lang, 28), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 80) AS memory FROM documents".replace("\\\\", "\\"))
def x40(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.context_memory(F.col("text"), F.concat("source", "lang")).alias("memory"))


@register("x41_fixed_left_context", """
WITH t AS (SELECT conv_id, turn FROM conversations)
SELECT conv_id, turn, [coalesce(lag(turn, 2) OVER w, -1), coalesce(lag(turn, 1) OVER w, -1)] AS context FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def x41(spark, sf):
    """Two items to the left of each, padded."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    lag = lambda k: F.coalesce(F.lag("turn", k).over(w), F.lit(-1))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array(lag(2), lag(1)).alias("context"))


@register("w11_channel_records")
def w11(spark, sf):
    """Channel records of all conversations: summary, three messages, roles, target."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("channel"), F.col("turn").cast("int").alias("pos"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.lit("").alias("reply"), F.col("role").alias("speaker"), "text", F.lit("").alias("summary"), F.lit("").alias("vibe"))
    return D.channel_records(c, "U").select("channel", "pos", "kind", "style", F.sha2(F.col("tokens").cast("string"), 256).alias("digest"), F.size("tokens").alias("size"))


EMB = "SELECT vec_id, embedding, label FROM embeddings"


@register("sf28_vector_math", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm, round(list_sum(embedding::DOUBLE[]), 9) AS total FROM embeddings")
def sf28(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(R.norm(e), 9).alias("norm"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double")), 9).alias("total"))


@register("j18_recall", """
WITH m AS (SELECT vec_id AS slot, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 32), q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings),
s AS (SELECT query, slot, list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))) AS score FROM q, m)
SELECT query, slot, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, slot) = 1""")
def j18(spark, sf):
    """Best slot of a 32-vector memory for every vector, by cosine (J18, K3, T-5)."""
    e = table(spark, sf, "embeddings")
    memory = e.filter("vec_id < 32").select(F.col("vec_id").alias("slot"), F.col("embedding").alias("v"))
    r = R.recall(e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), memory)
    return r.select("query", "slot", F.round("score", 9).alias("score"))


@register("j19_hybrid_retrieval", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, [CAST(label AS VARCHAR), CAST(vec_id % 3 AS VARCHAR)] AS w FROM embeddings),
s AS (SELECT q.vec_id AS query, m.vec_id AS slot, list_dot_product(q.v, m.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(m.v, m.v))) + 0.2 * len(list_intersect(list_distinct(q.w), m.w)) / len(q.w) AS score FROM e q, e m WHERE q.vec_id % 20 = 0)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, slot) AS rank, slot, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, slot) <= 3""")
def j19(spark, sf):
    """Cosine plus a fifth of the word overlap, over all rows (the query's own too), for the ids divisible by 20."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.array(F.col("label").cast("string"), (F.col("vec_id") % 3).cast("string")).alias("w"))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("w").alias("qw"))
    m = e.select(F.col("vec_id").alias("slot"), F.col("embedding").alias("v"), F.col("w").alias("vw"))
    return R.hybrid_blocks(q, m).select("query", "rank", "slot", F.round("score", 9).alias("score"))


@register("sf31_quantise", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS top FROM embeddings)
SELECT vec_id, round(top / 127, 12) AS scale, list_sum(list_transform(v, lambda x: round_even(x / (top / 127), 0)))::BIGINT AS total FROM e""")
def sf31(spark, sf):
    """Row-wise int8 quantisation (SK18, SF31)."""
    d = table(spark, sf, "embeddings").select("vec_id", R.quantise_row(F.col("embedding")).alias("q"))
    return d.select("vec_id", F.round("q.scale", 12).alias("scale"), F.aggregate("q.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@register("sf32_set_masks", "SELECT event_id, (event_id | user_id) AS any, (event_id & user_id) AS both_bits, (event_id & ~user_id) AS only_first, bit_count(event_id)::INT AS members, (1::BIGINT << (event_id % 60)::INT) AS single FROM events")
def sf32(spark, sf):
    """Finite-set operations on 64-bit masks."""
    a, b = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select("event_id", a.bitwiseOR(b).alias("any"), a.bitwiseAND(b).alias("both_bits"), a.bitwiseAND(F.bitwise_not(b)).alias("only_first"), F.bit_count(a).cast("int").alias("members"), F.expr("shiftleft(1L, cast(event_id % 60 as int))").alias("single"))


@register("sf24_canonical_json", """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS json, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def sf24(spark, sf):
    """Canonical JSON with sorted keys, and a parsed field (SF24, SF25)."""
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("json"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("sf23_maps", "SELECT n_regionkey, list_sort(list(n_nationkey)) AS keys, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY n_regionkey")
def sf23(spark, sf):
    """Maps with dynamic keys (SF23, D14)."""
    m = F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name")))
    d = table(spark, sf, "nation").groupBy("n_regionkey").agg(m.alias("m"))
    return d.select("n_regionkey", F.sort_array(F.map_keys("m")).alias("keys"), F.aggregate(F.map_keys("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@register("sf20_arrays", "SELECT conv_id, list_sort(list(turn)) AS turns, len(list(role)) AS n, list_sort(list_distinct(list(role))) AS roles, bool_and(turn >= 0) AS all_valid, bool_or(role = 'system') AS any_system FROM conversations GROUP BY conv_id")
def sf20(spark, sf):
    """Array functions: sort, distinct, forall, exists (SF20-SF22)."""
    d = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("a"))
    turns, roles = F.col("a.turn"), F.col("a.role")
    return d.select("conv_id", F.sort_array(turns).alias("turns"), F.size("a").alias("n"), F.sort_array(F.array_distinct(roles)).alias("roles"), F.forall(turns, lambda t: t >= 0).alias("all_valid"), F.exists(roles, lambda r: r == "system").alias("any_system"))


def _paragraphs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))


@register("p08_paragraph_packing")
def p08(spark, sf):
    """Paragraphs packed into records of about 420 characters."""
    from ..operators.chunking import pack_paragraphs

    return pack_paragraphs(_paragraphs(spark, sf), "doc_id", "text", "book", 420)


@register("p09_release_chunks")
def p09(spark, sf):
    """Release chunks of about 24,000 characters, none below 512."""
    from ..operators.chunking import pack_paragraphs

    return pack_paragraphs(_paragraphs(spark, sf), "doc_id", "text", "book", 24_000, least=512)


@register("so09_near_duplicates")
def so09(spark, sf):
    """Chunks within Hamming distance 3 of a SimHash, by halves of six blocks (SO9)."""
    from ..operators.chunking import near_chunks

    return near_chunks(table(spark, sf, "documents"), "doc_id", "text", 3)


@register("so09_kept_chunks")
def so09_kept(spark, sf):
    """Chunks that stay when each one near an earlier kept one is rejected, and the first of each fingerprint (SO9)."""
    from ..operators.chunking import kept_chunks

    return kept_chunks(table(spark, sf, "documents"), "doc_id", "text", 3)


@register("k01_hypervectors")
def k01(spark, sf):
    """Hypervector of every document: digest of its signs and its norm."""
    from ..functions.kernels import holo_encode

    v = holo_encode(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", v.alias("v"))
    return d.select("doc_id", F.round(R.norm(F.col("v")), 5).alias("norm"), F.size(F.filter("v", lambda x: x > 0)).alias("positive"))


@register("k04_signatures")
def k04(spark, sf):
    """Signed vectors, and whether a signature that came with a vector is its own: every third
    comes with its neighbour's, as a forged one would (K4)."""
    from ..functions.kernels import sign_vector

    e = table(spark, sf, "embeddings").select("vec_id", "embedding", sign_vector(F.col("embedding")).alias("signature"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("signature").alias("other"))
    came = e.join(other, "vec_id", "left").withColumn("came", F.when(F.col("vec_id") % 3 == 0, F.col("other")).otherwise(F.col("signature")))
    return came.select("vec_id", "signature", F.coalesce(sign_vector(F.col("embedding")) == F.col("came"), F.lit(False)).alias("valid"))


_WRAP = "18446744073709551616::HUGEINT"
_SIGNED = "(CASE WHEN {0} >= 9223372036854775808::HUGEINT THEN {0} - 18446744073709551616::HUGEINT ELSE {0} END)::BIGINT"


@register("sf03_fnv1a", f"""
WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
l AS (SELECT doc_id, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS HUGEINT)) AS bytes FROM b),
f AS (SELECT doc_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, bytes), lambda a, x: (xor(a, x) * 1099511628211::HUGEINT) % {_WRAP}) AS h FROM l)
SELECT doc_id, {_SIGNED.format('h')} AS hash FROM f""")
def sf03(spark, sf):
    from ..functions.kernels import fnv1a

    return table(spark, sf, "documents").select("doc_id", fnv1a(F.col("text")).alias("hash"))


_STEP = "((xor({0}, {0} // {1}::HUGEINT) % 4294967296::HUGEINT) * {2}::HUGEINT + ((xor({0}, {0} // {1}::HUGEINT) // 4294967296::HUGEINT) * {2}::HUGEINT % 4294967296::HUGEINT) * 4294967296::HUGEINT) % 18446744073709551616::HUGEINT"


@register("sf04_mix", f"""
WITH a AS (SELECT doc_id, doc_id::HUGEINT AS x, (doc_id + 1)::HUGEINT AS y FROM documents),
b AS (SELECT *, {_STEP.format('x', 1 << 30, 0xBF58476D1CE4E5B9)} AS x1, xor(y, y * 8192::HUGEINT % {_WRAP}) AS y1 FROM a),
c AS (SELECT *, {_STEP.format('x1', 1 << 27, 0x94D049BB133111EB)} AS x2, xor(y1, y1 // 128::HUGEINT) AS y2 FROM b),
d AS (SELECT doc_id, xor(x2, x2 // {1 << 31}::HUGEINT) AS m, xor(y2, y2 * 131072::HUGEINT % {_WRAP}) AS s FROM c)
SELECT doc_id, {_SIGNED.format('m')} AS mixed, {_SIGNED.format('s')} AS shifted FROM d""")
def sf04(spark, sf):
    """The 64-bit finaliser and the xorshift step (SF4, SF5)."""
    from ..functions.kernels import mix64, xorshift64

    return table(spark, sf, "documents").select("doc_id", mix64(F.col("doc_id")).alias("mixed"), xorshift64(F.col("doc_id") + 1).alias("shifted"))


def _mix_sql(x: str, out: str, source: str) -> str:
    """CTEs that add ``out``, the finaliser of ``x``, to ``source``."""
    return f"""{out}_1 AS (SELECT *, {_STEP.format(x, 1 << 30, 0xBF58476D1CE4E5B9)} AS {out}_a FROM {source}),
{out}_2 AS (SELECT *, {_STEP.format(out + '_a', 1 << 27, 0x94D049BB133111EB)} AS {out}_b FROM {out}_1),
{out}_3 AS (SELECT *, xor({out}_b, {out}_b // {1 << 31}::HUGEINT) AS {out} FROM {out}_2),
{out}_4 AS (SELECT *, ({out} + {0x9E3779B97F4A7C15}::HUGEINT + {{}}) % {_WRAP} AS {out}_in FROM {out}_3)"""


@register("sf33_feature_places", "WITH d AS (SELECT doc_id, doc_id::HUGEINT AS x FROM documents),\n" + ",\n".join(
    [_mix_sql("x", "m0", "d").format(0), *(_mix_sql(f"m{i}_in", f"m{i + 1}", f"m{i}_4").format(i + 1) for i in range(4))])
    + "\nSELECT doc_id, [" + ", ".join(f"CASE WHEN m{i} // 256::HUGEINT % 2 = 1 THEN 1 ELSE -1 END * (m{i} % 256 + 1)::INT" for i in range(1, 5)) + "] AS places FROM m4_4")
def sf33(spark, sf):
    """Signed places of a feature in a vector of 256, by a chain of mixes: the place plus one, with its sign (SF33)."""
    from ..functions.kernels import feature_signs

    return table(spark, sf, "documents").select("doc_id", feature_signs(F.col("doc_id"), F.lit(4)).alias("places"))


@register("k10_proof_checks")
def k10(spark, sf):
    """Generated proofs, checked."""
    from ..operators.logic import check_proof, generate_proofs

    d = generate_proofs(table(spark, sf, "documents").select("doc_id"), "doc_id")
    c = check_proof(F.col("theorem"), F.col("proof"))
    return d.select("doc_id", "task", "theorem", "proof", "result", c.alias("c")).select("doc_id", "task", "theorem", "proof", "result", "c.syntax_ok", "c.valid")


MERGES = 24


@register("p13_pair_scores", r"""
WITH t AS (SELECT source, list_transform(string_split(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), ''), lambda c: ascii(c)) AS s FROM documents),
u AS (SELECT source, CASE WHEN len(s) = 1 AND s[1] = 0 THEN [] ELSE s END AS s FROM t),
l AS (SELECT source, sum(len(s) + 1) - 1 AS pairs FROM u GROUP BY source),
p AS (SELECT source, unnest(s[1:len(s) - 1]) AS a, unnest(s[2:]) AS b FROM u WHERE len(s) > 1),
c AS (SELECT source, a, b, count(*) AS n FROM p WHERE a <> 10 AND b <> 10 GROUP BY ALL)
SELECT a, b, round(sum(n / pairs::DOUBLE), 12) AS score, sum(n)::BIGINT AS total FROM c JOIN l USING (source) GROUP BY a, b HAVING sum(n) >= 2""")
def p13s(spark, sf):
    """Scores of all pairs before the first merge: counts by file over its pairs."""
    from ..operators.bpe import first_scores

    d = table(spark, sf, "documents").select("source", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    return first_scores(d, "source", "text")


@register("p13_bpe_merges")
def p13(spark, sf):
    """Merge learning by pair scores over files, all documents reduced to ASCII."""
    from ..operators.bpe import learn_merges, merges_frame

    d = table(spark, sf, "documents").select("source", X.ascii_strict(F.col("text")).alias("text"))
    return merges_frame(spark, learn_merges(d, "source", "text", MERGES))


@register("p15_bpe_encode")
def p15(spark, sf):
    """Texts reduced to ASCII, encoded with learnt merges and decoded again."""
    from ..operators.bpe import decode, encode, learn_merges

    d = table(spark, sf, "documents").select("doc_id", "source", X.ascii_strict(F.col("text")).alias("text"))
    merges = learn_merges(d, "source", "text", MERGES)
    out = d.select("doc_id", "text", encode(F.col("text"), merges).alias("ids"))
    return out.select("doc_id", F.size("ids").alias("tokens"), (decode(F.col("ids"), merges) == F.col("text")).alias("round_trip"))


@register("p18_byte_alphabet", "SELECT doc_id, strlen(text) AS size, text AS back FROM documents")
def p18(spark, sf):
    """Texts as bytes in the byte-level alphabet, a character each, and back."""
    from ..operators.bpe import from_alphabet, to_alphabet

    shown = table(spark, sf, "documents").select("doc_id", to_alphabet(F.encode("text", "UTF-8")).alias("shown"))
    return shown.select("doc_id", F.length("shown").cast("long").alias("size"), F.decode(from_alphabet(F.col("shown")), "UTF-8").alias("back"))


@register("sc12_merge_vocabulary")
def sc12(spark, sf):
    """Merges written as a vocabulary file and read back (SC12, SK6)."""
    from ..operators.bpe import learn_merges, merges_frame
    from ..session import scratch_path
    from ..sources.binary import load_vocabulary, save_vocabulary

    d = table(spark, sf, "documents").select("source", F.make_valid_utf8("text").alias("text"))
    path = scratch_path(spark, "vocabulary")
    save_vocabulary(spark, learn_merges(d, "source", "text", 8, X.ascii_text), path)
    return merges_frame(spark, load_vocabulary(spark, path))
