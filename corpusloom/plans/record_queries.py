"""Queries of training records: audits, validation, moves, ranks, reports, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pairs as G17
from ..operators import records as RC
from ..operators import splits as S
from .registry import register, table

LINE = r"regexp_replace(regexp_replace(coalesce({}, ''), '[^\x20-\x7E]', '?', 'g'), ' +', ' ', 'g')"


def _line(c):
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x20-\x7E]", "?"), " +", " ")


CONTEXT = 400


@register("x01_audit_slices", rf"""
WITH t AS (SELECT conv_id, turn, {LINE.format('text')} AS line FROM conversations),
c AS (SELECT conv_id, list(line ORDER BY turn) AS l FROM t GROUP BY conv_id HAVING count(*) > 1),
e AS (SELECT conv_id, list_transform(l[1:len(l) - 1], lambda x: '- ' || x) AS e, l[len(l)] AS output FROM c),
n AS (SELECT conv_id, e, output, {CONTEXT} + 1 - (length(output) + 1) AS room, list_transform(range(1, len(e)), lambda i: list_sum(list_transform(e[i:], lambda x: length(x) + 1))) AS left_over FROM e),
d AS (SELECT *, len(list_filter(left_over, lambda x: x > room)) AS dropped FROM n)
SELECT conv_id AS id, array_to_string(e[dropped + 1:], chr(10)) || chr(10) AS prefix, dropped::INT AS dropped, true AS contiguous, true AS target_ok, true AS ascii_ok, true AS events_ok,
 list_sum(list_transform(e[dropped + 1:], lambda x: length(x) + 1)) <= room AS fits FROM d""")
def x01(spark, sf):
    """Concatenated files written and cut by their audit, earliest events dropped to fit."""
    turns = table(spark, sf, "conversations").select("conv_id", F.struct("turn", _line(F.col("text")).alias("line")).alias("t"))
    c = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["line"]).alias("l")).filter("size(l) > 1")
    head = F.concat(F.array_join(F.transform(F.slice("l", 1, F.size("l") - 1), lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))
    c = c.select(F.floor(F.col("conv_id") / 64).alias("file"), F.col("conv_id").alias("id"), head.alias("head"), F.element_at("l", -1).alias("output"))
    c = c.withColumn("text", F.concat("head", "output", F.lit("\n\n")))
    one = F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"])  # 64 conversations a file
    files = c.groupBy("file").agg(F.encode(F.array_join(one, ""), "UTF-8").alias("content"))
    from ..operators.sequence import running_offset

    rows = c.withColumn("text_bytes", F.octet_length("text").cast("long")).withColumn("text_start", running_offset(F.col("text_bytes"), ["file"], ["id"]))
    rows = rows.select("file", "id", "text_start", (F.col("text_start") + F.octet_length("head")).alias("output_start"), "text_bytes", "output")
    return RC.audit_slices(files, rows, CONTEXT)


FORMATS = ("person-v1", "person-v2")
_IDS = "list_transform(string_split({}, ''), lambda c: ascii(c))"


def _ids(c):
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))


@register("f12_participant_rules", rf"""
WITH c AS (SELECT conv_id * 1000 + turn AS id, turn, conv_id, regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g') AS said FROM conversations),
r AS (SELECT id, CASE WHEN turn = 7 THEN 'person-v3' ELSE 'person-v1' END AS format, CASE WHEN conv_id % 11 = 3 THEN 'person-v2' ELSE 'person-v1' END || chr(10) || said AS prompt,
  CASE WHEN conv_id % 13 = 5 THEN '{{"kind":"action","action":"end_conversation"}}' WHEN conv_id % 13 = 6 THEN '["no object"]' ELSE '{{"kind":"speech","text":"' || said || '"}}' END AS target_text,
  CASE WHEN turn = 1 THEN 'draft' ELSE 'approved_compact' END AS review_status, CASE conv_id % 7 WHEN 2 THEN 'rejected late' WHEN 4 THEN 'hold' ELSE 'approved' END AS source_review_status, CASE WHEN turn = 3 THEN '' ELSE 'w' || conv_id END AS world_group FROM c),
k AS (SELECT *, {_IDS.format('prompt')} AS p, {_IDS.format('target_text')} AS t FROM r),
b AS (SELECT *, coalesce(nullif(trim(json_extract_string(CASE WHEN target_text LIKE '{{%' THEN target_text END, '$.text')), ''), '') AS words FROM k)
SELECT id, unnest(list_filter([
  CASE WHEN format NOT IN ('person-v1', 'person-v2') THEN 'format' END, CASE WHEN NOT starts_with(prompt, format || chr(10)) THEN 'header' END,
  CASE WHEN starts_with(source_review_status, 'rejected') THEN 'source_not_rejected' END, CASE WHEN starts_with(source_review_status, 'hold') THEN 'source_not_held' END,
  CASE WHEN review_status <> 'approved_compact' THEN 'compact_approved' END, CASE WHEN source_review_status <> 'approved' THEN 'source_approved' END, CASE WHEN world_group = '' THEN 'world_group' END,
  CASE WHEN target_text LIKE '[%' THEN 'target_object' END, CASE WHEN target_text LIKE '[%' OR (target_text LIKE '{{"kind":"speech%' AND words = '') THEN 'target_kind' END,
  CASE WHEN len(p) > 120 THEN 'prompt_budget' END, CASE WHEN len(t) > 159 THEN 'target_budget' END, CASE WHEN len(t) > 511 THEN 'target_bytes' END,
  CASE WHEN len(p) % 2 = 0 THEN 'prompt_tokens' END, CASE WHEN len(t) % 5 = 0 THEN 'labels' END], lambda x: x IS NOT NULL)) AS rule FROM b""")
def f12(spark, sf):
    """Participant rows against their rules, with planted faults: one row per broken rule."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", "conv_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "").alias("said"))
    target = F.when(F.col("conv_id") % 13 == 5, '{"kind":"action","action":"end_conversation"}').when(F.col("conv_id") % 13 == 6, '["no object"]').otherwise(F.concat(F.lit('{"kind":"speech","text":"'), "said", F.lit('"}')))
    r = c.select(
        "id",
        F.when(F.col("turn") == 7, "person-v3").otherwise("person-v1").alias("format"),
        F.concat(F.when(F.col("conv_id") % 11 == 3, "person-v2").otherwise("person-v1"), F.lit("\n"), "said").alias("prompt"),
        target.alias("target_text"),
        F.when(F.col("turn") == 1, "draft").otherwise("approved_compact").alias("review_status"),
        F.when(F.col("conv_id") % 7 == 2, "rejected late").when(F.col("conv_id") % 7 == 4, "hold").otherwise("approved").alias("source_review_status"),
        F.when(F.col("turn") == 3, "").otherwise(F.concat(F.lit("w"), "conv_id")).alias("world_group"),
    )
    p, t = _ids(F.col("prompt")), _ids(F.col("target_text"))
    r = r.withColumn("prompt_tokens", F.when(F.size(p) % 2 == 0, F.slice(p, F.lit(2), F.size(p))).otherwise(p)).withColumn("tokens", F.concat(p, t))
    labels = F.concat(F.array_repeat(F.lit(-100), F.size(p) - 1), t, F.array(F.lit(0)))
    r = r.withColumn("labels", F.when(F.size(t) % 5 == 0, F.reverse(labels)).otherwise(labels))
    return S.violations(r, ["id"], RC.participant_rules(_ids, FORMATS, prompt_most=120))


@register("k13_candidate_ranks", """
WITH s AS (SELECT l_orderkey, l_linenumber % 3 AS candidate, sum(-ln(1 + l_quantity)) AS score FROM lineitem GROUP BY ALL)
SELECT l_orderkey, candidate, round(score, 9) AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(score, 9) DESC, candidate)::INT AS rank FROM s""")
def k13(spark, sf):
    """Candidates of a prompt by the sum of their tokens' log-probabilities."""
    d = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("candidate"), (-F.ln(1 + F.col("l_quantity"))).alias("lp"))
    return RC.rank_candidates(d, ["l_orderkey"], "candidate", "lp").withColumn("score", F.round("score", 9))


@register("f10_memory_records", "SELECT conv_id, turn FROM conversations WHERE contains(text, 'e ')")
def f10(spark, sf):
    """Records whose summary marker stands right before a target marker."""
    d = table(spark, sf, "conversations").select("conv_id", "turn", _ids(F.col("text")).alias("ids"))
    return RC.memory_records(d, "ids", ord("e"), ord(" ")).select("conv_id", "turn")


@register("g09_side_list", """
WITH r AS (SELECT item_id, row_number() OVER (ORDER BY sha256('sides-915:' || item_id)) AS rank, count(*) OVER () AS n FROM benchmark)
SELECT item_id, CASE WHEN rank <= n - n // 2 THEN 'prior' ELSE 'expanded' END AS a, CASE WHEN rank <= n - n // 2 THEN 'expanded' ELSE 'prior' END AS b FROM r""")
def g09(spark, sf):
    """A list of sides, half and half, in a shuffled order."""
    d = S.blind_sides(table(spark, sf, "benchmark").select("item_id"), F.col("item_id"), "sides-915:", odd_first=True)
    return d.select("item_id", F.when(F.col("swapped"), "expanded").otherwise("prior").alias("a"), F.when(F.col("swapped"), "prior").otherwise("expanded").alias("b"))


@register("x45_seed_split", """
SELECT event_id, CASE WHEN user_id BETWEEN 1 AND 40 THEN 'train' ELSE 'validation' END AS split, sha256('worlds-3:' || event_id) AS shuffled FROM events WHERE user_id BETWEEN 1 AND 40 OR user_id >= 60""")
def x45(spark, sf):
    """Training and validation by disjoint seeds, in a shuffled order."""
    d = table(spark, sf, "events").select("event_id", "user_id")
    return RC.seed_split(d, "user_id", 40, 60, "worlds-3:", F.col("event_id")).select("event_id", "split", "shuffled")


NAMES = ["Élm Vale", "The Copper Lantern"]


@register("x18_field_substitutions", f"""
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
s AS (SELECT p_partkey, w, unnest(range(0, len(w))) AS slot FROM p), n AS (SELECT *, unnest({NAMES!r}) AS name FROM s)
SELECT p_partkey, slot::INT AS slot, name, array_to_string(list_transform(w, lambda x, i: CASE WHEN i - 1 = slot THEN name ELSE x END), ' ') AS text FROM n
UNION ALL SELECT p_partkey, NULL, NULL, array_to_string(w, ' ') FROM p""")
def x18(spark, sf):
    """Every field replaced by every name, beside the row itself."""
    d = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return RC.field_substitutions(d, "w", NAMES).select("p_partkey", "slot", "name", "text")


@register("x17_question_probes", r"""
WITH e AS (SELECT conv_id, arg_min(text, turn) AS question, arg_max(text, turn) AS answer FROM conversations WHERE text IS NOT NULL GROUP BY conv_id HAVING count(*) > 1),
p AS (SELECT a.conv_id, a.question, b.question AS other, a.answer FROM e a JOIN e b ON b.conv_id = xor(a.conv_id, 1)),
n AS (SELECT conv_id, question, other, regexp_extract_all(answer, '[A-Z][a-z]{2,}') AS names FROM p),
c AS (SELECT conv_id, list_filter(names, lambda x: contains(question, x)) AS expected, list_filter(names, lambda x: contains(other, x)) AS copied FROM n)
SELECT conv_id, expected, copied, expected = copied AS same FROM c""")
def x17(spark, sf):
    """An exchange under another's question: the names that its answer copies from its own question,
    and those that it could copy from the other (X17)."""
    c = table(spark, sf, "conversations").filter("text is not null").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.max_by("text", "turn").alias("answer"), F.count("*").alias("n")).filter("n > 1")
    return RC.question_probes(c, "conv_id", "question", "answer", F.col("conv_id").bitwiseXOR(F.lit(1)))


@register("x22_same_targets", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(list_transform(range(0, 4), lambda i: i * (len(w) - 64) // 3)) AS start FROM w WHERE len(w) >= 96),
t AS (SELECT doc_id, start, w[start + 1:start + 64] AS ws, array_to_string(w[start + 1:start + 64], ' ') AS target FROM s),
v AS (SELECT doc_id, start, strlen(target) AS bytes, list_sum(list_transform(ws, lambda x: ln(3 + length(x)) * 4)) AS a, list_sum(list_transform(string_split(target, ''), lambda c: ln(2 + ascii(c) % 7))) AS b FROM t)
SELECT doc_id, start::BIGINT AS start, bytes::BIGINT AS bytes, round(a / ln(2) / bytes, 9) AS by_words, round(b / ln(2) / bytes, 9) AS by_characters FROM v""")
def x22(spark, sf):
    """The same target spans scored under words and under characters, in bits a byte."""
    d = table(spark, sf, "documents").select("doc_id", X.words(F.col("text")).alias("w")).filter("size(w) >= 96")
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.floor(i * (F.size("w") - 64) / 3).cast("long")))
    d = d.withColumn("start", start).withColumn("ws", F.slice("w", (F.col("start") + 1).cast("int"), 64)).withColumn("target", F.array_join("ws", " ")).withColumn("bytes", F.octet_length("target").cast("long"))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x)) / F.ln(F.lit(2.0)) / F.col("bytes")
    chars = F.filter(F.split("target", ""), lambda c: c != "")
    return d.select("doc_id", "start", "bytes", F.round(total(F.col("ws"), lambda x: F.ln(3 + F.length(x)) * 4), 9).alias("by_words"), F.round(total(chars, lambda c: F.ln(2 + F.ascii(c) % 7)), 9).alias("by_characters"))


@register("j20_window_report", """
WITH r AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS start FROM documents),
w AS (SELECT doc_id, start, n_chars, unnest(range(((start + 255) // 256)::BIGINT, ((start + n_chars + 255) // 256)::BIGINT)) * 256 AS t FROM r WHERE n_chars > 0)
SELECT doc_id, t, t - 128 < start AS context_crosses, t + 64 > start + n_chars AS target_crosses, t - 128 < start OR t + 64 > start + n_chars AS excluded FROM w""")
def j20(spark, sf):
    """Windows with their book, kept or excluded because context or target leaves it; no row is lost."""
    from ..operators.sequence import distributed_offsets

    r = distributed_offsets(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars").filter("n_chars > 0")
    first, last = F.floor((F.col("start") + 255) / 256), F.floor((F.col("start") + F.col("n_chars") - 1) / 256)
    w = r.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("t", F.col("k") * 256)
    context, target = F.col("t") - 128 < F.col("start"), F.col("t") + 64 > F.col("start") + F.col("n_chars")
    return w.select("doc_id", "t", context.alias("context_crosses"), target.alias("target_crosses"), (context | target).alias("excluded"))


@register("a37_input_overlap", r"""
WITH d AS (SELECT doc_id, regexp_replace(source || ' ' || lang || ' ' || n_chars, '[0-9]+', 'N', 'g') AS slots, (n_chars // 200)::VARCHAR AS v FROM documents),
t AS (SELECT slots, v FROM d WHERE doc_id % 2 = 0)
SELECT doc_id, slots IN (SELECT slots FROM t) AS slots_seen, (slots, v) IN (SELECT (slots, v) FROM t) AS values_seen FROM d WHERE doc_id % 2 = 1""")
def a37(spark, sf):
    """Test inputs seen in training by their pattern, and with their values."""
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.concat_ws(" ", "source", "lang", F.col("n_chars").cast("string")), "[0-9]+", "N").alias("slots"), F.floor(F.col("n_chars") / 200).cast("string").alias("v"))
    return RC.overlap_report(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "doc_id", F.col("slots"), F.col("v"))


@register("x03_review_packets", """
WITH a AS (SELECT 'P' || k AS arm, item_id, text AS base, k || ' ' || text AS cand FROM benchmark, (VALUES (1), (2), (3)) v(k)),
r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY sha256('review-v1:' || arm || ':' || item_id)) <= count(*) OVER (PARTITION BY arm) // 2 AS first FROM a)
SELECT arm, item_id, CASE WHEN first THEN cand ELSE base END AS a_text, CASE WHEN first THEN base ELSE cand END AS b_text, CASE WHEN first THEN 'A' ELSE 'B' END AS candidate_side FROM r""")
def x03(spark, sf):
    """Review packets of three arms against a baseline, half of the cases swapped by hash."""
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    d = table(spark, sf, "benchmark").select("item_id", "text", k.alias("k")).select("item_id", F.concat(F.lit("P"), "k").alias("arm"), F.col("text").alias("base"), F.concat_ws(" ", F.col("k").cast("string"), "text").alias("cand"))
    return RC.review_packets(d, "item_id", "arm", "base", "cand", "review-v1:")


@register("x34_first_source_variants", """
WITH e AS (SELECT event_id, event_type, 'u' || user_id || '-v' || (event_id % 4) AS id FROM events),
f AS (SELECT event_type, regexp_extract(arg_min(id, event_id), '^(.*)-v', 1) AS stem FROM e GROUP BY event_type)
SELECT e.event_id, e.event_type, e.id FROM e JOIN f ON e.event_type = f.event_type AND regexp_extract(e.id, '^(.*)-v', 1) = f.stem""")
def x34(spark, sf):
    """All variants of each rule's first source id."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.concat(F.lit("u"), "user_id", F.lit("-v"), F.col("event_id") % 4).alias("id"))
    stem = F.regexp_extract("id", "^(.*)-v", 1)
    first = e.groupBy("event_type").agg(F.min_by(stem, "event_id").alias("stem"))
    return e.withColumn("stem", stem).join(first, ["event_type", "stem"]).select("event_id", "event_type", "id")


@register("x09_verified_load", r"""
WITH d AS (SELECT source, doc_id, CAST('0x' || substr(md5(coalesce('=' || doc_id, '-') || chr(31) || coalesce('=' || text, '-')), 1, 8) AS BIGINT) AS part FROM documents),
g AS (SELECT source, count(*) AS rows, sum(part)::BIGINT AS digest FROM d GROUP BY source)
SELECT source, rows, digest, digest % 3 <> 0 AS verified, 0::BIGINT AS code_faults FROM g""")
def x09(spark, sf):
    """Documents by source against a lock, in which every third digest is an older one, and the code
    of all executors against the driver's (X9, X20, X42)."""
    from ..operators import identity as I

    d = table(spark, sf, "documents")
    columns = (F.col("doc_id"), F.col("text"))
    lock = I.group_digests(d, "source", *columns).withColumn("digest", F.when(F.col("digest") % 3 == 0, F.col("digest") - 1).otherwise(F.col("digest")))
    faults = I.attest(spark, "corpusloom", I.code_digests(I.package_root("corpusloom"))).count()
    return I.verified_load(d, "source", lock, *columns).withColumn("code_faults", F.lit(faults).cast("long"))


@register("x33_fingerprints", """
SELECT n_nationkey, sha256('build ' || n_name) AS builder, sha256(n_comment) AS sources, sha256(builder_line) AS spec,
 sha256('builder ' || sha256('build ' || n_name) || chr(10) || 'sources ' || sha256(n_comment) || chr(10) || 'spec ' || sha256(builder_line)) AS "all"
FROM (SELECT *, 'target ' || n_regionkey AS builder_line, n_name || ':' || n_nationkey AS n_comment FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation))""")
def x33(spark, sf):
    """Fingerprints of a preparation: of each part and of all."""
    n = table(spark, sf, "nation")
    parts = {"builder": F.concat(F.lit("build "), "n_name"), "sources": F.concat("n_name", F.lit(":"), "n_nationkey"), "spec": F.concat(F.lit("target "), "n_regionkey")}
    return n.select("n_nationkey", RC.fingerprint(parts).alias("f")).select("n_nationkey", "f.*")


@register("sf36_dates", """
SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, date_trunc('month', o_orderdate)::DATE AS month_start, (o_orderdate::DATE - DATE '1992-01-01')::INT AS days, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""")
def sf36(spark, sf):
    """Dates: parts, truncation, differences, ISO text (SF36)."""
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.trunc(d, "month").alias("month_start"), F.datediff(d, F.lit("1992-01-01").cast("date")).alias("days"), F.date_format(d, "yyyy-MM-dd").alias("iso"))


#: Frames of twelve moves at two levels: (move, lead, asks, opens, closes, claim). The words are examples; real tables are a parameter.
MOVES = [
    ("open", "none", [], [""], [""], True),
    ("answer", "ask", ["What news?", "Any word?"], [""], [""], True),
    ("remark", "heard", [], ["A fair day for it.", "So it goes."], [""], False),
    ("affirm", "heard", [], ["I heard the same.", "Just so."], [""], False),
    ("dispute", "heard", [], ["Not as I heard. ", "No: "], [" That is all.", " Ask again."], True),
    ("hedge", "own", ["Are you sure?"], ["Not wholly.", "Near enough."], [""], False),
    ("attribute", "own", ["Who said so?"], ["A traveller told me.", "It came by road."], [""], False),
    ("defer", "ask", ["I am not sure."], ["Then let us wait.", "We shall see."], [""], False),
    ("settle", "ask", ["Let us wait."], ["Agreed."], [""], False),
    ("part", "ask", ["Agreed."], ["Farewell.", "Go well."], [""], False),
    ("recall", "heard", [], ["That stays with me.", "I know that tale."], [" It is like an old song.", ""], False),
    ("muse", "none", [], ["", "Hm. "], ["I should watch this.", "Where will it end?"], False),
]
_FRAMES = [(m, level, lead, asks, [level[0].upper() + o if o and level == "high" else o for o in opens], closes, claim) for level in ("low", "high") for m, lead, asks, opens, closes, claim in MOVES]


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


_FRAMES_SQL = ", ".join(f"('{m}', '{level}', '{lead}', {_sql_list(asks)}, {_sql_list(opens)}, {_sql_list(closes)}, {claim})" for m, level, lead, asks, opens, closes, claim in _FRAMES)
_DRAW = "CAST('0x' || substr(md5('{what}:' || move || ':' || p_partkey), 1, 8) AS BIGINT)"


@register("g19_move_rows", f"""
WITH p AS (SELECT p_partkey, p_name || ' is gone.' AS own, p_type AS heard, CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END AS level FROM part),
f(move, level, lead, asks, opens, closes, claim) AS (VALUES {_FRAMES_SQL}),
j AS (SELECT p.*, move, lead, claim, CASE WHEN len(asks) > 0 THEN asks[1 + {_DRAW.format(what='ask')} % len(asks)] END AS ask,
  list_sort(list_distinct(flatten(list_transform(opens, lambda o: list_transform(closes, lambda c: o || CASE WHEN claim THEN own ELSE '' END || c))))) AS accepted FROM p JOIN f USING (level)),
t AS (SELECT *, accepted[1 + {_DRAW.format(what='target')} % len(accepted)] AS target FROM j)
SELECT p_partkey, move, accepted, target, CASE WHEN claim THEN (instr(target, own) - 1)::INT END AS "offset",
 CASE lead WHEN 'heard' THEN ['other: ' || heard] WHEN 'ask' THEN ['other: ' || ask] WHEN 'own' THEN ['self: ' || own, 'other: ' || ask] ELSE []::VARCHAR[] END AS history FROM t""")
def g19(spark, sf):
    """Twelve moves of every row, with all accepted wordings."""
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" is gone.")).alias("own"), F.col("p_type").alias("heard"), F.when(F.col("p_size") > 25, "high").otherwise("low").alias("level"))
    frames = spark.createDataFrame(_FRAMES, "move string, level string, lead string, asks array<string>, opens array<string>, closes array<string>, claim boolean")
    d = RC.move_rows(p, frames, "p_partkey", "level", "own", "heard")
    return d.select("p_partkey", "move", "accepted", "target", "offset", F.transform("history", lambda h: F.concat(h["speaker"], F.lit(": "), h["text"])).alias("history"))


_POOLS = {
    "actor": [f"{a}{b}" for a in ("Ansel", "Brida", "Corwin", "Delphine") for b in (" of the Upper Ford", " Marrow", "")],
    "recipient": [f"{a} {b}" for a in ("Edda", "Falk", "Greta") for b in ("Hollow", "Lindqvist", "Thorne")],
    "place": ["Quarry Hill", "the Long Meadow by the river", "Saltmarsh", "Élan Bridge"],
    "object": ["a brass lamp", "the old ledger", "two keys"],
    "detail": ["at dawn", "after the rains"],
}
_RULES = [
    G17.Rule("gift", ("actor", "recipient", "object"), "{0} gave {2} to {1}.", ("{0} gave {2} to {1}.", "{1} was given {2} by {0}."), partial=True),
    G17.Rule("flock", ("place", "quantity", "quantity"), "at {0} {1} sheep came and {2} left.", ("at {0} {1} came and {2} left.", "{2} of the sheep left {0}."), less_than=(1, 2)),
    G17.Rule("visit", ("actor", "place", "detail"), "{0} came to {1} {2}.", ("{0} came to {1} {2}.", "{2} {0} stood in {1}."), partial=True),
    G17.Rule("count", ("quantity", "detail"), "{0} were counted {1}.", ("{0} were counted {1}.", "{1} there were {0}.")),
]


def _pairs_sql() -> str:
    """The same pairs in SQL: rules as rows, draws by MD5."""
    text = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    words = lambda xs: "[" + ", ".join(map(text, xs)) + "]"
    h = lambda what, n: f"(CAST('0x' || substr(md5('{what}:' || k), 1, 8) AS BIGINT) % {n})"
    value = lambda role, what: f"CAST({h(what, 198)} + 2 AS VARCHAR)" if role == "quantity" else f"({words(_POOLS[role])})[{h(what, len(_POOLS[role]))} + 1]"
    fill = lambda t, v: f"replace(replace(replace({t}, '{{0}}', coalesce({v}[1], '')), '{{1}}', coalesce({v}[2], '')), '{{2}}', coalesce({v}[3], ''))"
    rows = []
    for at, r in enumerate(_RULES):
        v = [value(role, f"value{j}") for j, role in enumerate(r.roles)]
        if r.less_than:
            v[r.less_than[1]] = f"CAST(CAST({v[r.less_than[0]]} AS INT) + 1 + {h('more', 29)} AS VARCHAR)"
        e = _RULES[(at + 7) % len(_RULES)]
        earlier = fill(text(e.outputs[0]), "[" + ", ".join(value(role, f"earlier{j}") for j, role in enumerate(e.roles)) + "]")
        unknown = f"CASE WHEN {h('unknown', 7)} = 0 THEN {r.roles.index('actor')} END" if r.partial else "NULL::INT"
        bare = fill(text(r.source), "[" + ", ".join("''" if j in r.named() else f"drawn[{j + 1}]" for j in range(len(r.roles))) + "]")
        rows.append(f"SELECT *, {text(r.name)} AS rule, {words(r.roles)} AS roles, {list(r.named())}::INT[] AS named, {text(r.source)} AS source, {text(r.outputs[0])} AS o0, {text(r.outputs[1])} AS o1, least(20, (143 - strlen({bare})) // {max(1, len(r.named()))}) AS most FROM (SELECT k, [{', '.join(v)}] AS drawn, {unknown} AS unknown, {earlier} AS earlier FROM c WHERE k % {len(_RULES)} = {at})")
    pool = "CASE roles[changed + 1] " + " ".join(f"WHEN '{role}' THEN {words(w)}" for role, w in _POOLS.items()) + " END"
    return f"""
WITH c AS (SELECT c_custkey AS k FROM customer), r AS ({' UNION ALL '.join(rows)}),
v AS (SELECT *, list_transform(drawn, lambda x, i: CASE WHEN list_contains(named, i - 1) THEN rtrim(left(x, most)) ELSE x END) AS vals, list_filter(named, lambda j: j IS DISTINCT FROM unknown) AS free FROM r),
w AS (SELECT *, CASE WHEN len(free) > 0 THEN free[{h('changed', 'greatest(1, len(free))')} + 1] END AS changed FROM v),
x AS (SELECT *, list_filter({pool}, lambda p: rtrim(left(p, most)) <> vals[changed + 1]) AS others FROM w),
y AS (SELECT *, rtrim(left(others[{h('other', 'greatest(1, len(others))')} + 1], most)) AS other, unnest([0, 1]) AS member, CASE WHEN {h('sure', 4)} = 0 THEN 20 ELSE 80 END AS confidence, {h('retold', 3)} = 0 AS retold, {h('form', 2)} AS form FROM x),
z AS (SELECT *, list_transform(vals, lambda v, i: CASE WHEN i - 1 = unknown THEN 'someone' WHEN member = 1 AND i - 1 = changed THEN other ELSE v END) AS told FROM y),
s AS (SELECT *, {fill('source', 'told')} AS account, {fill('CASE form WHEN 0 THEN o0 ELSE o1 END', 'told')} AS said FROM z)
SELECT k AS pair, member, rule, CASE WHEN k % 3 <> 0 THEN '- ' || earlier || chr(10) ELSE '' END || '- ' || CASE WHEN confidence < 40 THEN '? ' ELSE '' END || CASE WHEN retold THEN '~ ' ELSE '' END || account || chr(10) AS prefix,
  rtrim(upper(left(said, 1)) || substr(said, 2), '.') || CASE WHEN confidence < 40 THEN ', or so I heard.' WHEN retold THEN ', they say.' ELSE '.' END AS output,
  changed, unknown, confidence, retold, k % 3 <> 0 AS distracted FROM s"""


@register("g17_rule_pairs", _pairs_sql())
def g17(spark, sf):
    """Counterfactual pairs over rules, with unknown actors and earlier accounts beside them."""
    return G17.rule_pairs(table(spark, sf, "customer"), "c_custkey", _RULES, _POOLS)


_PHRASES = {
    "questions": ["What is new?", "Any word from town?", "What have you heard?"],
    "certainty": ["Are you certain?", "How do you know?"],
    "connectors": [" It calls to mind ", " Much like "],
    "shaken": ["My voice fails me. ", "I cannot keep still. "],
    "thoughts": ["Best to wait.", "Someone ought to be told.", "I will look tomorrow."],
    "agree": "So I was told as well. Are you certain?", "differ": "It was told otherwise to me. ", "sure": " Are you certain?",
    "unsure": "I could not say. ", "passed": "It came to me through others. ", "held": "That is how I know it. ", "check": "Let us look for ourselves.",
    "ask": "Who might know?", "close": "Nobody here, I fear.", "who": "Who says so?", "end": "As you wish.",
    "say": {"resident": {"neutral": ["Well, well.", "So it goes."], "loss": ["A pity."]}, "guard": {"neutral": ["Noted.", "I shall report it."], "loss": ["Who took it?", "Search the gate."]}},
    "memory": {"neutral": ["I have seen the like."], "loss": ["I lost one, too.", "Things go missing."]},
}


def _acts_sql() -> str:
    from ..operators.acts import ACTS, DEPTHS

    p = _PHRASES
    text = lambda x: "'" + x.replace("'", "''") + "'"
    h = lambda what, n: f"(CAST('0x' || substr(md5('{what}:' || key), 1, 8) AS BIGINT) % {n})"
    pick = lambda xs, what: "([" + ", ".join(map(text, xs)) + f"])[{h(what, len(xs))} + 1]"
    turn = lambda who, t: f"{{'speaker': {who}, 'text': {t}}}"
    family = lambda lines, what: f"CASE family WHEN 'loss' THEN {pick(lines['loss'], what)} ELSE {pick(lines['neutral'], what)} END"
    own, other = "'self'", "'other'"
    first = "talk[1].speaker"
    told = turn(f"CASE {first} WHEN 'other' THEN 'self' ELSE 'other' END", f"CASE {first} WHEN 'other' THEN own ELSE heard END")
    asked = lambda i: turn(first, pick(p["questions"], f"before{i}"))
    return f"""
WITH r AS (SELECT p_partkey AS key, [{', '.join(map(text, ACTS))}][p_partkey % 13 + 1] AS act, p_name || ' is gone.' AS own, 'They say that ' || CASE WHEN p_size % 5 = 0 THEN 'it' ELSE p_name END || ' went missing.' AS heard,
  split_part(p_name, ' ', 1) AS name, list_transform(['amber', 'ivory', 'plum'], lambda x: x) AS others, p_size * 2 AS confidence, p_size % 3 = 0 AS retold, CASE WHEN p_size % 2 = 0 THEN 'guard' ELSE 'resident' END AS voice,
  CASE WHEN p_size > 25 THEN 'loss' ELSE 'other' END AS family, CASE WHEN p_size % 4 <> 0 THEN repeat(p_type || ' of ' || p_brand || ' ', 3) || 'once' END AS memory, CASE WHEN p_size % 7 < 3 THEN 'high' ELSE 'low' END AS stress FROM part),
a AS (SELECT *, list_filter(others, lambda x: x <> name) AS o FROM r),
b AS (SELECT * REPLACE (CASE act WHEN 'react' THEN 'high' ELSE stress END AS stress), CASE WHEN act = 'disagree' AND contains(heard, name) THEN o[{h('other', 'greatest(1, len(o))')} + 1] END AS changed FROM a),
c AS (SELECT * REPLACE (CASE WHEN act = 'disagree' AND changed IS NULL THEN 'agree' ELSE act END AS act, CASE WHEN changed IS NOT NULL THEN replace(heard, name, changed) ELSE heard END AS heard) FROM b),
t AS (SELECT *, CASE WHEN act IN ('start', 'question') THEN own WHEN act = 'agree' THEN {text(p['agree'])} WHEN act = 'disagree' THEN {text(p['differ'])} || own || {text(p['sure'])}
   WHEN act = 'certainty' THEN CASE WHEN confidence < 40 THEN {text(p['unsure'])} WHEN retold THEN {text(p['passed'])} ELSE {text(p['held'])} END || {text(p['check'])} WHEN act = 'source' THEN {text(p['held'] + p['check'])}
   WHEN act = 'check' THEN {text(p['ask'])} WHEN act = 'close' THEN {text(p['close'])} WHEN act = 'end' THEN {text(p['end'])}
   WHEN act IN ('say', 'react') THEN CASE voice WHEN 'guard' THEN {family(p['say']['guard'], 'line')} ELSE {family(p['say']['resident'], 'line')} END
   WHEN act = 'memory' THEN {family(p['memory'], 'recall')} || coalesce({pick(p['connectors'], 'connector')} || CASE WHEN length(memory) > 80 THEN regexp_replace(left(memory, 80), ' [^ ]*$', '') || '...' ELSE memory END, '')
   ELSE CASE WHEN stress = 'high' AND {h('shaken', 2)} = 1 THEN {pick(p['shaken'], 'shake')} ELSE '' END || {pick(p['thoughts'], 'thought')} END AS target,
  CASE WHEN act IN ('start', 'thought') THEN [] WHEN act = 'question' THEN [{turn(other, pick(p['questions'], 'question'))}] WHEN act IN ('agree', 'disagree', 'say', 'memory', 'react') THEN [{turn(other, 'heard')}]
   WHEN act = 'certainty' THEN [{turn(own, 'own')}, {turn(other, f"CASE WHEN {h('doubt', 2)} = 1 THEN {text(p['differ'])} || heard || ' ' ELSE '' END || " + pick(p['certainty'], 'certainty'))}] WHEN act = 'source' THEN [{turn(own, 'own')}, {turn(other, text(p['who']))}]
   WHEN act = 'check' THEN [{turn(own, pick(p['certainty'], 'certainty'))}, {turn(other, pick([p['unsure'], p['held'], p['passed']], 'answer') + ' || ' + text(p['check']))}]
   WHEN act = 'close' THEN [{turn(own, text(p['check']))}, {turn(other, text(p['ask']))}] ELSE [{turn(own, text(p['ask']))}, {turn(other, text(p['close']))}] END AS talk FROM c),
z AS (SELECT *, {list(DEPTHS)}[{h('depth', len(DEPTHS))} + 1] AS depth FROM t)
SELECT key, act, list_transform(CASE WHEN len(talk) = 0 OR depth = 0 THEN talk WHEN depth = 1 THEN list_concat([{asked(0)}, {told}], talk) ELSE list_concat([{asked(1)}, {told}, {asked(0)}, {told}], talk) END, lambda x: x.speaker || ': ' || x.text) AS history,
  target, CASE WHEN act IN ('start', 'question') THEN 0 WHEN act = 'disagree' THEN {len(p['differ'].encode())} END AS "offset", changed, stress, CASE act WHEN 'thought' THEN 'think' WHEN 'memory' THEN 'remember' ELSE 'say' END AS control FROM z"""


@register("g18_act_rows", _acts_sql())
def g18(spark, sf):
    """Answers by act, thirteen acts, with the talk before them."""
    from ..operators.acts import ACTS, act_rows

    size = F.col("p_size")
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"),
        F.get(F.array(*map(F.lit, ACTS)), (F.col("p_partkey") % 13).cast("int")).alias("act"),
        F.concat("p_name", F.lit(" is gone.")).alias("own"),
        F.concat(F.lit("They say that "), F.when(size % 5 == 0, "it").otherwise(F.col("p_name")), F.lit(" went missing.")).alias("heard"),
        F.get(F.split("p_name", " "), F.lit(0)).alias("name"),
        F.array(*map(F.lit, ("amber", "ivory", "plum"))).alias("others"),
        (size * 2).alias("confidence"),
        (size % 3 == 0).alias("retold"),
        F.when(size % 2 == 0, "guard").otherwise("resident").alias("voice"),
        F.when(size > 25, "loss").otherwise("other").alias("family"),
        F.when(size % 4 != 0, F.concat(F.repeat(F.concat("p_type", F.lit(" of "), "p_brand", F.lit(" ")), 3), F.lit("once"))).alias("memory"),
        F.when(size % 7 < 3, "high").otherwise("low").alias("stress"),
    )
    d = act_rows(rows, _PHRASES)
    return d.withColumn("history", F.transform("history", lambda x: F.concat(x["speaker"], F.lit(": "), x["text"])))


@register("w28_marker_records", """
WITH c AS (SELECT doc_id, string_split(text, '') AS s FROM documents WHERE length(text) > 0),
r AS (SELECT doc_id, unnest(list_filter(range(1, len(s) + 1), lambda i: s[i] = '.')) AS i FROM c)
SELECT doc_id, (i - 1)::BIGINT AS place, row_number() OVER (PARTITION BY doc_id ORDER BY i) > count(*) OVER (PARTITION BY doc_id) - count(*) OVER (PARTITION BY doc_id) // 20 AS held FROM r""")
def w28(spark, sf):
    """Records that start at a marker token, the last twentieth of a stream's held out."""
    d = table(spark, sf, "documents").select("doc_id", _ids(F.col("text")).alias("ids"))
    return RC.marker_records(d, "doc_id", "ids", ord(".")).select("doc_id", "place", "held")


@register("p35_encoded_rows")
def p35(spark, sf):
    """Conversation rows with span markers, a history budget and typed columns, as tokens and labels;
    rows whose messages or tokens exceed the budgets have that as their fault (P35)."""
    from ..operators.encoding import encoded

    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", _line(F.col("text")).alias("t")))), lambda x: x["t"])
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("t")).filter("size(t) > 1")
    name = F.get(F.split(F.element_at("t", -1), " "), F.lit(0))
    field = F.struct(F.lit(2).alias("field"), F.lit(1).alias("role"), F.lit(0).alias("knowledge"), F.lit(1).alias("provenance"), F.lit(True).alias("spoken"), name.alias("text"))
    history = F.transform(F.slice("t", 1, F.size("t") - 1), lambda x, i: F.struct(F.when(i % 2 == 0, "other").otherwise("self").alias("speaker"), x.alias("text")))
    copies = F.array(F.struct(F.lit(2).alias("field"), F.lit(0).alias("start"), F.octet_length(name).alias("end")))
    row = F.struct(F.array(F.concat(F.lit("# goal: "), F.col("conv_id").cast("string"))).alias("lines"), history.alias("history"), (F.col("conv_id") % 100).cast("int").alias("confidence"), (F.col("conv_id") % 2 == 0).alias("retold"), F.array(field).alias("fields"), copies.alias("copies"), F.element_at("t", -1).alias("output"), F.lit("say").alias("cue"), F.struct((F.col("conv_id") % 5).cast("int").alias("kind"), F.lit(3).alias("move")).alias("typed"))
    e = c.filter(F.length(name) > 0).select("conv_id", encoded(row, 1024).alias("e"))
    return e.select("conv_id", F.size("e.tokens").alias("size"), "e.prefix_length", F.sha2(F.to_json(F.struct("e.tokens", "e.labels", "e.copy_targets", "e.weights", "e.meta", "e.candidates")), 256).alias("digest"), "e.fault")


@register("sk07_record_preview")
def sk07(spark, sf):
    """Readable form of the first 40 channel records, as the sink shows them (SK7)."""
    from pyspark.sql import types as T

    from ..operators import dialogue as D

    import pyarrow as pa

    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("channel"), F.col("turn").cast("int").alias("pos"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.lit("").alias("reply"), F.col("role").alias("speaker"), "text", F.lit("").alias("summary"), F.lit("").alias("vibe"))
    first = D.channel_records(c, "U").orderBy("channel", "pos", F.desc("kind"), F.desc("style")).limit(40)
    show = F.arrow_udf(lambda x: pa.array([D.preview(t) for t in x.to_pylist()], pa.string()), T.StringType())
    return first.select("channel", "pos", "kind", "style", show("tokens").alias("preview"))
