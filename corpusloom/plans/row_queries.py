"""Queries of account rows: masking, naming, slots, minds, exchanges, batches, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rows as A
from .registry import register, table


def fields(*items):
    """Field structs from (role, text, spoken) triples."""
    return F.array(*(F.struct(r.alias("role"), t.alias("text"), s.alias("spoken")) for r, t, s in items))


@register("p23_mask_facts", r"""
SELECT c_custkey, regexp_replace(regexp_replace('Seen: ' || c_name || ' in ' || c_mktsegment || '; ' || lower(c_mktsegment), '(?i)' || c_name, '{who}', 'g'), '(?i)' || c_mktsegment, '{trade}', 'g') AS masked FROM customer""")
def p23(spark, sf):
    """Facts masked by name, longest first, ignoring case; and the slots a text needs."""
    d = table(spark, sf, "customer")
    facts = F.array(F.struct(F.lit("trade").alias("name"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("who").alias("name"), F.col("c_name").alias("value")))
    t = F.concat(F.lit("Seen: "), "c_name", F.lit(" in "), "c_mktsegment", F.lit("; "), F.lower("c_mktsegment"))
    return d.select("c_custkey", A.mask_facts(t, facts).alias("masked"))


@register("p26_full_names")
def p26(spark, sf):
    """Unique first names become full names (Unicode word bounds, a UDF)."""
    p = table(spark, sf, "part")
    names = F.array("p_name", F.concat(F.lit("Old "), F.col("p_type")))
    t = F.concat(F.lit("Old and "), F.element_at(F.split("p_name", " "), 1), F.lit(" met."))
    return p.select("p_partkey", A.full_names(t, names).alias("text"))


@register("p22_render_fields", "SELECT p_partkey, p_brand || ' saw ' || CASE WHEN p_size > 20 THEN p_type ELSE '{1}' END AS text, CASE WHEN p_size > 40 THEN p_name ELSE 'raiders' END || ' near the towns' AS filled FROM part")
def p22(spark, sf):
    """Slots filled with speakable fields only (P22), and defaults."""
    big = F.col("p_size") > 40
    d = table(spark, sf, "part")
    said = fields((F.lit(2), F.col("p_brand"), F.lit(True)), (F.lit(0), F.col("p_type"), F.col("p_size") > 20))
    named = fields((F.lit(2), F.col("p_brand"), F.lit(True)), (F.when(big, 1).otherwise(0), F.col("p_name"), F.lit(True)))
    return d.select("p_partkey", A.render_fields(F.lit("{0} saw {1}"), said).alias("text"), A.fill_actor_place(F.lit("{actor} near {place}"), named).alias("filled"))


@register("g26_exchange_rows", """
WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
h AS (SELECT a.conv_id, a.turn, string_agg((CASE WHEN b.n % 2 = a.n % 2 THEN 'self' ELSE 'other' END) || ':' || b.text, '|' ORDER BY b.n) AS history FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 4 AND a.n - 1 GROUP BY 1, 2)
SELECT n.conv_id, n.turn, n.text AS output, coalesce(history, '') AS history FROM n LEFT JOIN h USING (conv_id, turn)""")
def g26(spark, sf):
    """Four-turn histories with speakers."""
    d = A.turn_rows(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")
    return d.select("conv_id", "turn", "output", F.array_join(F.transform("history", lambda m: F.concat(m["speaker"], F.lit(":"), m["text"])), "|").alias("history"))


def _pick_sql(name, options):
    return f"[{', '.join(repr(o) for o in options)}][1 + CAST('0x' || substr(md5('{name}:' || doc_id), 1, 8) AS BIGINT) % {len(options)}]"


VOICES, GOALS, LEVELS = ["resident", "merchant", "soldier"], ["shelter", "trade", "safety", "news"], ["low", "medium", "high"]


@register("p37_bridged_rows", f"SELECT doc_id, {_pick_sql('voice', VOICES)} AS voice, {_pick_sql('goal', GOALS)} AS goal, {_pick_sql('stress', LEVELS)} AS stress, {_pick_sql('courage', LEVELS)} AS courage FROM documents")
def p37(spark, sf):
    """Rows under a mind drawn by hash."""
    d = A.bridged(table(spark, sf, "documents").select("doc_id"), "doc_id", VOICES, GOALS, LEVELS)
    return d.select("doc_id", "voice", "mind.goal", "mind.stress", "mind.courage")


@register("g20_marked_openings", """
SELECT doc_id, list_sort(flatten(list_transform(CASE WHEN lang = 'en' AND n_chars > 2000 THEN ['I am hungry. ', 'Food first. '] WHEN lang = 'fr' AND n_chars <= 2000 THEN ['We have a roof. '] ELSE [''] END,
 lambda a: list_transform(CASE source WHEN 'src0' THEN ['Yes.', 'Quite so.'] WHEN 'src1' THEN ['Who says?'] ELSE ['Farewell.'] END, lambda b: a || b)))) AS accepted FROM documents""")
def g20(spark, sf):
    """Openings of a predicament before every wording of a cell."""
    from ..operators.generate import products

    d = table(spark, sf, "documents")
    table_ = {("hungry", True, "en"): ["I am hungry. ", "Food first. "], ("hungry", False, "fr"): ["We have a roof. "]}
    cells = spark.createDataFrame([("src0", ["Yes.", "Quite so."]), ("src1", ["Who says?"])], "source string, forms array<string>")
    d = A.with_cell(d.select("doc_id", "lang", "n_chars", "source"), cells, ["source"])
    forms = F.coalesce("forms", F.array(F.lit("Farewell.")))
    return d.select("doc_id", F.sort_array(products(A.marks(table_, F.col("lang"), {"hungry": F.col("n_chars") > 2000}), forms)).alias("accepted"))


@register("g15_hash_acts", "SELECT doc_id, CAST('0x' || substr(sha256('acts-1:' || doc_id), 1, 8) AS BIGINT) % 13 AS act FROM documents")
def g15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.hash_act("acts-1", F.col("doc_id"), 13).alias("act"))


@register("g28_rehearsal_rows", """
SELECT doc_id, source, false AS response FROM documents UNION ALL SELECT doc_id, source, true FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es')""")
def g28(spark, sf):
    """A response beside each row whose rule is not covered."""
    d = table(spark, sf, "documents")
    return A.rehearsal(d.select("doc_id", "source"), d.filter("lang = 'es'"), "source")


@register("g13_mixed_batches", """
WITH b AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // (CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 2 ELSE 1 END) AS batch FROM documents WHERE lang IN ('en', 'fr', 'de')),
f AS (SELECT min(n) AS n FROM (SELECT lang, count(*) // (CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 2 ELSE 1 END) AS n FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY lang))
SELECT doc_id, lang, batch FROM b, f WHERE batch < f.n""")
def g13(spark, sf):
    """Batches of five, two and one rows of three sources."""
    return A.mixed_batches(table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["doc_id"], {"en": 5, "fr": 2, "de": 1})


@register("x11_reference_scores", """
SELECT lang, count(*) AS n, count(*) FILTER (WHERE text = b) AS exact, count(*) FILTER (WHERE contains(text, split_part(b, ' ', 1))) AS all_names
FROM (SELECT a.lang, a.text, b.text AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) GROUP BY lang""")
def x11(spark, sf):
    """Texts against references, with required names."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    r = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("ref"))
    j = d.join(r, "doc_id").withColumn("names", F.array(F.get(F.split("ref", " "), F.lit(0))))
    return A.reference_scores(j, ["lang"], "text", "ref", "names")


@register("x15_history_pairs", """
SELECT a.doc_id // 2 AS pair, a.n_chars > 500 AND b.n_chars > 500 AS both_ok, a.text <> b.text AS changed FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0""")
def x15(spark, sf):
    """Pairs of counterfactual histories."""
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("side"), "text", (F.col("n_chars") > 500).alias("ok"))
    return A.history_pairs(d, "pair", "side", "text", "ok").withColumnRenamed("both", "both_ok")


@register("x26_replacement_pools", "SELECT p_brand, list_sort(list(DISTINCT p_type)) AS pool FROM part GROUP BY p_brand")
def x26(spark, sf):
    return A.replacement_pool(table(spark, sf, "part"), "p_brand", "p_type")


@register("x08_run_pair_faults", """
WITH f AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS arm, lang, source, n_chars // 1000 AS budget FROM documents)
SELECT a.pair, unnest(list_filter([CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.source IS DISTINCT FROM b.source THEN 'source' END, CASE WHEN a.budget IS DISTINCT FROM b.budget THEN 'budget' END], lambda x: x IS NOT NULL)) AS field
FROM f a JOIN f b ON a.pair = b.pair AND a.arm = 0 AND b.arm = 1""")
def x08(spark, sf):
    """Fields that must agree between the arms of a run pair."""
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 2).alias("pair"), F.when(F.col("doc_id") % 2 == 0, "B").otherwise("C").alias("arm"), "lang", "source", F.floor(F.col("n_chars") / 1000).alias("budget"))
    return A.run_pair_faults(d, "pair", "arm", ["lang", "source", "budget"])


@register("x28_packet_rows", "SELECT doc_id, strlen(source) + 2 AS start, strlen(source) + 2 + strlen(lang) AS stop, 'x: ' || lang AS said FROM documents")
def x28(spark, sf):
    """Packets as rows with shifted spans."""
    from ..operators.spans import replace_fields

    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat("source", F.lit(": "), "lang").alias("text"))
    n, m = F.octet_length("source"), F.octet_length("lang")
    d = d.withColumn("spans", F.array(F.struct(F.lit("who").alias("field"), F.lit(0).alias("start"), n.alias("end")), F.struct(F.lit("what").alias("field"), (n + 2).alias("start"), (n + 2 + m).alias("end"))))
    new = replace_fields(F.col("text"), F.col("spans"), F.create_map(F.lit("who"), F.lit("x")))
    return d.select("doc_id", F.col("spans")[1]["start"].alias("start"), F.col("spans")[1]["end"].alias("stop"), new["text"].alias("said"))


@register("sk08_report", """SELECT '{"documents":' || count(*) || ',"languages":' || count(DISTINCT lang) || '}' AS report FROM documents""")
def sk08(spark, sf):
    """A one-row JSON report (SK8, D18)."""
    d = table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages"))
    return d.select(F.to_json(F.struct("documents", "languages")).alias("report"))


@register("sk17_csv_metrics", "SELECT event_id AS generation, value AS audit FROM events")
def sk17(spark, sf):
    """CSV metrics with comment lines, written and read (SK17)."""
    from ..session import scratch_path
    from ..sources.text_files import read_metrics

    path = scratch_path(spark, "metrics")
    e = table(spark, sf, "events").select(F.col("event_id").alias("generation"), F.col("value").alias("audit"))
    e.write.option("header", True).csv(path)
    return read_metrics(spark, path, "generation long, audit double")


@register("sk13_semantic_index", "SELECT vec_id, label, len(embedding) AS dims FROM embeddings")
def sk13(spark, sf):
    """A semantic index as Parquet with its vectors (SK13)."""
    from ..session import scratch_path

    path = scratch_path(spark, "index")
    d = table(spark, sf, "embeddings")
    d.write.parquet(path)
    return spark.read.schema(d.schema).parquet(path).select("vec_id", "label", F.size("embedding").alias("dims"))


_DEMO = ("The lamp was lit.", "Who goes there?", "A friend, said the voice.")


@register("sc21_demo_corpus", "SELECT id, text, (SELECT count(*) FROM documents d WHERE contains(d.text, split_part(lower(t.text), ' ', 2)))::BIGINT AS documents FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_DEMO)) + ") t(id, text)")
def sc21(spark, sf):
    """A small embedded corpus, and the documents in which the second word of each of its texts stands (SC21)."""
    demo = spark.createDataFrame(list(enumerate(_DEMO)), "id int, demo string")
    d = table(spark, sf, "documents")
    counts = d.agg(*(F.count_if(F.contains("text", F.lit(t.lower().split(" ")[1]))).alias(str(i)) for i, t in enumerate(_DEMO)))
    counts = counts.select(F.posexplode(F.array(*(F.col(str(i)) for i in range(len(_DEMO))))).alias("at", "documents"))
    return demo.join(counts, F.col("id") == F.col("at")).select("id", F.col("demo").alias("text"), "documents")
