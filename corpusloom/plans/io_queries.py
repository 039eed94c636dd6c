"""Queries that go through sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..session import scratch_path
from ..sources import binary as B
from ..sources import text_files as S
from .agg_queries import EFFECTIVE_SQL, votes
from .registry import register, table


@register("sc01_jsonl_round_trip", "SELECT event_id, user_id, event_type, value FROM events")
def sc01(spark, sf):
    """JSON lines written and read with a declared schema (SC1, SK1)."""
    path = scratch_path(spark, "jsonl")
    S.write_jsonl(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), path)
    return S.read_jsonl(spark, path, "event_id long, user_id long, event_type string, value double")


@register("sc02_event_files", """
SELECT 'e' || event_id AS event_id, 'r' || user_id AS reviewer_id, (event_id % 200)::INT AS case_id, event_type AS choice FROM events""")
def sc02(spark, sf):
    """Event files in three shapes: exports, single events, JSON lines (SC2, D12)."""
    path = scratch_path(spark, "events")
    e = table(spark, sf, "events").select(F.concat(F.lit("e"), "event_id").alias("event_id"), F.lit("p").alias("packet_id"), F.concat(F.lit("r"), "user_id").alias("reviewer_id"), (F.col("event_id") % 200).cast("int").alias("case_id"), F.col("event_type").alias("choice"), (F.col("event_id") % 3).alias("k"))
    one = F.to_json(F.struct("event_id", "packet_id", "reviewer_id", "case_id", "choice"))
    e.filter("k > 0").select(one.alias("value")).write.text(path + "/lines")
    e.filter("k = 0").groupBy(F.xxhash64("event_id") % 8).agg(F.concat(F.lit('{"events":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path + "/export")
    both = S.read_events(spark, path + "/lines").unionByName(S.read_events(spark, path + "/export"))
    return both.select("event_id", "reviewer_id", "case_id", "choice")


@register("sc03_whole_documents", "SELECT doc_id, text, length(text) AS chars FROM documents")
def sc03(spark, sf):
    """Line ends normalised, a byte order mark dropped."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("raw"))
    t = X.line_ends(F.col("raw"))
    return d.select("doc_id", t.alias("text"), F.length(t).alias("chars"))


@register("sc04_token_files", """
WITH d AS (SELECT lang, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS t FROM documents)
SELECT lang, count(t) AS records, coalesce(sum(length(t)), 0)::BIGINT AS tokens, coalesce(sum(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT)), 0)::BIGINT AS digest FROM d GROUP BY lang""".replace("\\\\", "\\"))
def sc04(spark, sf):
    """16-bit token files by language, whatever languages there are: written by the token sink, read in chunks and
    as records; the digests of the records say that every id came back in its place (SC4, SC5, SC9, SC10, SK4, SK5, D4)."""
    path, end = scratch_path(spark, "tokens"), 128
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    ids = F.transform(F.filter(F.split(ascii_only, ""), lambda c: c != ""), lambda c: F.ascii(c))
    d = table(spark, sf, "documents")
    B.write_tokens(d.select("lang", ids.alias("tokens")), path, end, label="lang")
    label = B.folder_label(F.col("path")).alias("label")
    chunks = B.read_tokens(spark, path, limit=end + 1).groupBy(label).agg(F.sum(F.size(F.filter("tokens", lambda x: x != end))).alias("tokens"))
    text = F.array_join(F.transform("tokens", lambda x: F.char(x)), "")
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    records = B.read_records(spark, path, end).groupBy(label).agg(F.count(F.lit(1)).alias("records"), F.sum(digest).alias("digest"))
    same = chunks["label"].eqNullSafe(records["label"])
    read = records.join(chunks, same).select(records["label"], "records", "tokens", "digest")
    seen = d.select("lang").distinct()  # a language may have no text, and then no record
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return seen.join(read, seen["lang"].eqNullSafe(read["label"]), "left").select("lang", zero("records"), zero("tokens"), zero("digest"))


@register("sc06_chat_rows", r"""
SELECT 'c' || conv_id AS c, turn::INT AS pos, trim(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '[\x00-\x1F]+', ' ', 'g'), ' ') AS text FROM conversations""")
def sc06(spark, sf):
    """Chat tables parsed line by line, threads by run length."""
    row = F.concat_ws("\t", F.concat(F.lit("c"), "conv_id"), F.concat(F.lit("m"), "turn"), F.lit(""), "role", F.regexp_replace("text", r"[\x00-\x1F]+", " "))
    d = table(spark, sf, "conversations").withColumn("row", row).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "row"))), lambda x: x["row"]), "\n").alias("text"))
    r = S.chat_rows(d, "conv_id", "text")
    return r.select(F.element_at(F.split("channel", "#"), -1).alias("c"), "pos", "text")


def _play(spark, sf):
    head = F.concat(F.lit("SCENE "), "conv_id")
    speech = F.concat(F.upper("role"), F.lit(".\nEnter a ghost\n"), F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf, "conversations").withColumn("s", speech).groupBy("conv_id").agg(F.concat(F.first(head), F.lit("\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), "\n\n")).alias("text"))


@register("sc07_play_rows", r"""
SELECT conv_id::VARCHAR AS scene, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS pos, upper(role) AS speaker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations WHERE trim(text) <> ''""")
def sc07(spark, sf):
    """Plays: scenes, speakers, speeches; stage directions dropped."""
    r = S.play_rows(_play(spark, sf), "conv_id", "text")
    return r.select(F.get(F.split("channel", "#"), F.lit(0)).alias("scene"), "pos", "speaker", "text")


@register("sc08_verse_rows", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
t AS (SELECT doc_id, n, regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line FROM l)
SELECT doc_id::VARCHAR AS doc, count(*) AS lines FROM t WHERE line <> '' AND length(line) <= 240 AND NOT regexp_matches(line, '^(\[|Enter |Exit |Exeunt|Re-enter )') GROUP BY 1""")
def sc08(spark, sf):
    """Verse lines by stanza, two voices in turn."""
    r = S.verse_rows(table(spark, sf, "documents"), "doc_id", "text")
    return r.groupBy(F.get(F.split("channel", "#"), F.lit(0)).alias("doc")).agg(F.count("*").alias("lines"))


@register("sc11_packed_tokens", "SELECT doc_id, strlen(coalesce(text, '')) AS tokens, md5(coalesce(text, '')) AS digest FROM documents")
def sc11(spark, sf):
    """Packed-token containers of whole texts, one per document, written and read back, with the
    digest of the ids that came back (SC11)."""
    path, d = scratch_path(spark, "packs"), table(spark, sf, "documents")
    B.write_packs(B.pack_texts(d, "doc_id", "text", width=1), path)
    key = F.get_json_object("metadata", "$.document").cast(d.schema["doc_id"].dataType)
    size = F.floor(F.octet_length("ids") / F.col("width")).cast("int")
    return B.read_pack_bytes(spark, path).select(key.alias("doc_id"), size.alias("tokens"), F.md5("ids").alias("digest"))


@register("sc14_logic_records")
def sc14(spark, sf):
    """Proof records parsed from text and verified (SC14, K11)."""
    from ..operators.logic import generate_proofs

    d = generate_proofs(table(spark, sf, "documents").select("doc_id"), "doc_id")
    block = F.concat_ws("\n", F.lit("@logic hf1"), F.concat(F.lit("@task "), "task"), F.concat(F.lit("@theorem "), "theorem"), F.concat(F.lit("@proof "), "proof"), F.concat(F.lit("@result "), "result"), F.lit("@end"))
    files = d.select(F.floor(F.col("doc_id") / 64).alias("file"), block.alias("b")).groupBy("file").agg(F.array_join(F.collect_list("b"), "\n").alias("text"))
    return S.logic_records(files, "file", "text").groupBy("file").agg(F.count("*").alias("records"), F.count("fault").alias("faults"))


@register("sc20_verified_inventory", """
WITH s AS (SELECT source, count(*) AS n, sum(n_chars) % 3 AS r FROM documents GROUP BY source)
SELECT source, CASE r WHEN 0 THEN 'changed' WHEN 1 THEN 'extra' ELSE 'missing' END AS fault, CASE r WHEN 2 THEN n ELSE 0 END::BIGINT AS absent FROM s""")
def sc20(spark, sf):
    """Files by source against a lock of digests: of the locked files some have changed, some are
    gone, and some are there that no lock has, by a rule of each source's own; every fault is found (SC20, SK12, J21, X32)."""
    path, d = scratch_path(spark, "files"), table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    d.write.partitionBy("source").option("maxRecordsPerFile", 1000).json(path)
    found = S.inventory(spark, path).filter("path like '%.json'").withColumn("of", F.regexp_extract("path", "source=([^/]*)/", 1))
    rule = d.groupBy("source").agg(F.count("*").alias("n"), (F.sum("n_chars") % 3).alias("r"))
    locked = found.join(rule, F.col("of") == F.col("source"))
    lock = locked.filter("r <> 1").select("path", F.when(F.col("r") == 0, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    gone = locked.filter("r = 2").select("path", "of")
    faults = S.verify_inventory(found.join(gone, "path", "left_anti"), lock).withColumn("of", F.regexp_extract("path", "source=([^/]*)/", 1))
    one = faults.groupBy("of", "fault").agg(F.count("*").alias("files"))
    return one.join(rule, F.col("of") == F.col("source")).select("source", "fault", F.when(F.col("fault") == "missing", F.col("n")).otherwise(0).cast("long").alias("absent"))


@register("sk02_text_corpus", "SELECT lang, count(*) AS chunks, sum(length(text) + 2)::BIGINT AS chars FROM (SELECT lang, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM documents) GROUP BY lang".replace("\\\\", "\\"))
def sk02(spark, sf):
    """Text corpora per split, ordered chunks apart by a blank line."""
    path = scratch_path(spark, "corpus")
    t = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    d = table(spark, sf, "documents").select("doc_id", "lang", t.alias("t"))
    S.write_corpus(d, path, "lang", ["doc_id"], "t")
    back = spark.read.text(path, wholetext=True).select("lang", F.length("value").alias("n"))
    n = d.groupBy("lang").agg(F.count("*").alias("chunks"))
    return back.groupBy("lang").agg(F.sum("n").alias("chars")).join(n, "lang").select("lang", "chunks", "chars")


@register("sk03_text_offsets", """
WITH d AS (SELECT doc_id, strlen(source || text) AS n, strlen(source) AS p FROM documents)
SELECT doc_id, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS text_start, (sum(n) OVER (ORDER BY doc_id) - n + p)::BIGINT AS output_start, n AS text_bytes FROM d""")
def sk03(spark, sf):
    """Byte offsets of prefix and output in the concatenated file (SK3, X1)."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    return S.with_text_offsets(d, "doc_id", "source", "text").select("doc_id", "text_start", "output_start", "text_bytes")


@register("sk09_atomic_report", "SELECT lang, count(*) AS documents, sum(length(text))::BIGINT AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def sk09(spark, sf):
    """A JSON report (a row per language) that replaces an older one as a whole, read back (SK9, SK8)."""
    from ..sources.commit import put, write_report

    path = scratch_path(spark, "report")
    rows = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.countDistinct("source").alias("sources"))
    put(spark, f"{path}/report.json", b'[{"lang": "old"}]')
    write_report(spark, f"{path}/report.json", [r.asDict() for r in rows.collect()])
    return spark.read.schema(rows.schema).option("multiLine", True).json(path)


@register("sk18_int8_tensor", """
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS top FROM embeddings WHERE embedding IS NOT NULL)
SELECT row, CAST(CASE WHEN top > 0 THEN top / 127 ELSE 1 END AS FLOAT) AS scale,
  list_transform(v, lambda x: CAST(greatest(-127, least(127, round_even(x / CASE WHEN top > 0 THEN top / 127 ELSE 1 END, 0))) AS TINYINT)) AS q FROM e""")
def sk18(spark, sf):
    """All vectors as an int8 tensor with row scales, written in blocks of rows and read back (SK18)."""
    from ..sources.tensors import read_int8, write_int8

    path = scratch_path(spark, "tensor")
    write_int8(table(spark, sf, "embeddings"), path, "vec_id", "embedding", block_rows=4096)
    return read_int8(spark, path)


@register("x29_external_texts", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g') AS t FROM documents)
SELECT doc_id, least(length(t), 257) AS tokens, md5(left(t, 257)) AS digest FROM d WHERE t <> ''""")
def x29(spark, sf):
    """Texts of external packs: empty ones left out, the others cut to a context of 256 and one more."""
    path, d = scratch_path(spark, "external"), table(spark, sf, "documents")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "")
    B.write_packs(B.pack_texts(d.select("doc_id", text.alias("text")), "doc_id", "text"), path)
    cut = B.read_packs(spark, path).filter(F.size("tokens") > 0).withColumn("tokens", F.slice("tokens", 1, 257))
    text = F.array_join(F.transform("tokens", lambda x: F.char(x)), "")
    key = F.get_json_object("metadata", "$.document").cast(d.schema["doc_id"].dataType)
    return cut.select(key.alias("doc_id"), F.size("tokens").alias("tokens"), F.md5(text).alias("digest"))


@register("sk11_pending_work", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def sk11(spark, sf):
    """Resumable work: finished keys are skipped, another identity is an error (SK11, ST6)."""
    w = table(spark, sf, "documents").select("doc_id", F.lit("run-1").alias("identity"))
    return S.pending(w, w.filter("doc_id % 3 = 0"), ["doc_id"], "identity").select("doc_id")


def _stream(spark, df, name):
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path), scratch_path(spark, name + "-out")


@register("st01_vote_store", f"""
WITH v AS (SELECT event_id, packet_id, reviewer_id, case_id, choice, arrival FROM (SELECT 'p' || (user_id % 2) AS packet_id, 'r' || (user_id % 17) AS reviewer_id, 'e' || (event_id - event_id % 3) AS event_id,
 (event_id * 7) % 200 AS case_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'withdraw' ELSE 'skip' END AS choice, event_id AS arrival FROM events)),
f AS (SELECT *, first_value((packet_id, reviewer_id, case_id, choice)) OVER (PARTITION BY event_id ORDER BY arrival) AS kept, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS n FROM v)
SELECT CASE WHEN n = 1 THEN 'stored' ELSE 'conflict' END AS status, count(*) AS n FROM f WHERE n = 1 OR (packet_id, reviewer_id, case_id, choice) <> kept GROUP BY 1""")
def st01(spark, sf):
    """Idempotent vote store as a stream, conflicts reported (ST1, SK10)."""
    from ..streaming.state import run_once, vote_store

    s, out = _stream(spark, votes(spark, sf).repartitionByRange(3, "arrival").withColumn("case_id", F.col("case_id").cast("long")), "votes")
    return run_once(vote_store(s), "vote_store", out).groupBy("status").agg(F.count("*").alias("n"))


@register("sk10_fenced_log", f"""
WITH v AS (SELECT 'e' || (event_id - event_id % 3) AS event_id, event_id AS arrival, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' WHEN 'purchase' THEN 'withdraw' ELSE 'skip' END AS choice FROM events)
SELECT event_id, count(*) AS events, arg_min(choice, arrival) AS choice FROM v GROUP BY event_id""")
def sk10(spark, sf):
    """Votes appended to a durable log by a stream that another writer takes over half-way: the first
    is fenced, no event is lost or doubled (SK10, ST1)."""
    from ..sources.commit import EventLog, Fenced

    v = votes(spark, sf).repartitionByRange(6, "arrival")
    s, path = _stream(spark, v, "log")
    log, taken = EventLog(spark, path).open(), []

    def append(batch, i):
        writer = log
        if i >= 1:  # a second process has opened the log meanwhile
            if not taken:
                taken.append(EventLog(spark, path).open())
                taken[0].append(batch, f"votes-{i}")
                try:
                    log.append(batch, f"late-{i}")
                    raise AssertionError("two writers at once")
                except Fenced:
                    pass
            writer = taken[0]
        writer.append(batch, f"votes-{i}")

    q = s.writeStream.queryName("fenced").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(append).start()
    q.awaitTermination()
    return EventLog(spark, path).replay(v.schema).groupBy("event_id").agg(F.count("*").alias("events"), F.min_by("choice", "arrival").alias("choice"))


@register("st02_effective_stream", f"SELECT packet_id, reviewer_id, case_id, choice FROM {EFFECTIVE_SQL}")
def st02(spark, sf):
    """Effective votes as a stream of updates; equals the batch view (ST2)."""
    from ..operators.sequence import first_per_key
    from ..streaming.state import effective_stream, run_once

    once = first_per_key(votes(spark, sf), ["event_id"], ["arrival"]).withColumn("case_id", F.col("case_id").cast("long"))
    s, out = _stream(spark, once.repartitionByRange(3, "arrival"), "stored")
    u = run_once(effective_stream(s), "effective", out, mode="update")
    last = u.groupBy("packet_id", "reviewer_id", "case_id").agg(F.max_by("choice", "arrival").alias("choice"))
    return last.filter("choice <> 'withdraw'")


@register("st03_episodic_memory")
def st03(spark, sf):
    """Ring memory of 32 vectors per stream: recall, then remember (ST3, K2, D19)."""
    from ..streaming.state import episodic_memory, run_once

    d = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("stream"), F.col("vec_id").alias("arrival"), F.col("embedding").alias("vector"))
    s, out = _stream(spark, d.repartitionByRange(2, "arrival"), "memory")
    return run_once(episodic_memory(s), "memory", out).withColumn("score", F.round("score", 5))


@register("st04_vector_exchange")
def st04(spark, sf):
    """Signed vector exchange: bad signatures are rejected (ST4, K4-K6)."""
    from ..functions.kernels import sign_vector
    from ..streaming.state import run_once, vector_exchange

    e = F.col("embedding").cast("array<float>")
    d = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("stream"), F.col("vec_id").alias("arrival"), e.alias("vector"), (sign_vector(e) + F.when(F.col("vec_id") % 10 == 3, 1).otherwise(0)).alias("signature"))
    s, out = _stream(spark, d.repartitionByRange(2, "arrival"), "packets")
    return run_once(vector_exchange(s), "exchange", out).withColumn("score", F.round("score", 5))


@register("st05_rolling_memory")
def st05(spark, sf):
    """Rolling summaries per conversation (ST5)."""
    from ..streaming.state import rolling_memory, run_once

    d = table(spark, sf, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("arrival"), "text")
    s, out = _stream(spark, d.repartitionByRange(2, "arrival"), "chat")
    return run_once(rolling_memory(s), "rolling", out)


@register("ext_windowed_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def ext_windows(spark, sf):
    """Extension: event-time windows with a watermark, in batch form."""
    from ..streaming.state import windowed_counts

    w = windowed_counts(table(spark, sf, "events"))
    return w.select(F.col("w.start").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


@register("ext_pricing_summary", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-09-02' GROUP BY 1, 2""")
def ext_pricing(spark, sf):
    """Extension: a pricing summary over the star schema."""
    d = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1999-09-02").cast("timestamp"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
