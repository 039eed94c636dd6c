"""Text sources and sinks: JSON lines, whole documents, event exports, chat tables, plays,
verse, proof records, corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_speaker_line, line_ends
from ..operators.dialogue import OTHER_SUMMARY, STYLE_SUMMARY
from ..operators.sequence import run_ids

EVENT = "event_id string, packet_id string, reviewer_id string, case_id int, choice string"
LIMIT = 20_000_000


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line, with a declared schema; a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, text, with line ends normalised and byte order marks dropped."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), line_ends(F.col("value")).alias("text"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Vote events from an export ({"events": [...]}), a single event, or JSON lines; anything
    else raises. Files are small review exports; ``arrival`` is (file, place)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    whole = F.from_json("value", f"struct<events: array<struct<{_fields(EVENT)}>>, event_id: string>")
    lines = F.transform(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{_fields(EVENT)}>"))
    single = F.array(F.from_json("value", f"struct<{_fields(EVENT)}>"))
    many = (F.size(lines) > 1) & F.forall(lines, lambda e: e["event_id"].isNotNull())
    one_value = ~many & F.try_parse_json("value").isNotNull()
    events = F.when(one_value & whole["events"].isNotNull(), whole["events"]).when(one_value & whole["event_id"].isNotNull(), single).when(many, lines).otherwise(F.raise_error(F.concat(F.lit("not an event file: "), F.col("file"))))
    return raw.select("file", F.posexplode(events).alias("place", "e")).select("file", "place", "e.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split() for x in ddl.split(", ")))


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line) of every document."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))


def chat_rows(docs: DataFrame, key: str, text: str, style: str = "U") -> DataFrame:
    """Chat tables: tab-separated channel, id, reply, speaker, text, and optional vibe and
    memory. Empty and ``#`` lines are skipped, other field counts raise, a channel that
    returns starts another thread.

    Returns channel (unique per thread), pos, id, reply, speaker, text, summary, vibe: the
    input of ``channel_records``.
    """
    clean = F.regexp_replace(F.regexp_replace("line", r"[^\x00-\x7F]", "?"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    lines = numbered_lines(docs, key, text).withColumn("line", clean).filter("line <> '' and not startswith(line, '#')")
    f = lines.withColumn("f", F.split("line", "\t", 7))
    ok = F.size("f") >= 5
    f = f.filter(F.assert_true(ok, F.lit("a chat row has 5 to 7 fields")).isNull())
    get = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    trim = lambda c: F.regexp_replace(c, r"^[ \t\r]+|[ \t\r]+$", "")
    d = f.select(key, "n", get(0).alias("c"), get(1).alias("id"), get(2).alias("reply"), get(3).alias("speaker"), trim(get(4)).alias("text"), get(5).alias("v"), trim(get(6)).alias("summary"))
    d = run_ids(d, [key], ["n"], "c", "run")
    first = F.first("v").over(Window.partitionBy(key, "run").orderBy("n"))
    d = d.withColumn("vibe", F.when(first != "", first).otherwise(STYLE_SUMMARY.get(style, OTHER_SUMMARY)))
    return d.select(F.concat_ws("#", F.col(key).cast("string"), F.col("run").cast("string"), "c").alias("channel"), F.col("n").alias("pos"), "id", "reply", "speaker", "text", "summary", "vibe")


def _trimmed(docs, key, text):
    return numbered_lines(docs, key, text).withColumn("line", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", ""))


def _stage(line):
    return line.startswith("[") | line.startswith("Enter ") | line.startswith("Exit ") | line.startswith("Exeunt") | line.startswith("Re-enter ")


def play_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Plays: scenes at ACT or SCENE lines, speeches under speaker lines, stage directions left
    out. A thread per scene; each speech replies to the one before."""
    d = _trimmed(docs, key, text)
    line = F.col("line")
    scene = line.startswith("ACT ") | line.startswith("SCENE ") | line.isin("ACT", "SCENE")
    speaker = ~scene & is_speaker_line(line) & ~line.startswith("SCENE")
    w = Window.partitionBy(key).orderBy("n")
    d = d.withColumn("is_scene", scene).withColumn("is_speaker", speaker)
    d = d.withColumn("scene", F.sum(F.col("is_scene").cast("int")).over(w)).filter("scene > 0")
    s = Window.partitionBy(key, "scene").orderBy("n")
    d = d.withColumn("title", F.first("line").over(s)).withColumn("speech", F.sum(F.col("is_speaker").cast("int")).over(s))
    named = d.withColumn("who", F.last(F.when(F.col("is_speaker"), line), ignorenulls=True).over(s)).filter("speech > 0")
    body = named.filter((line != "") & ~F.col("is_speaker") & ~_stage(line))
    g = body.groupBy(key, "scene", "speech").agg(F.first("title").alias("vibe"), F.first("who").alias("who"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("text"))
    pos = F.row_number().over(Window.partitionBy(key, "scene").orderBy("speech"))
    g = g.withColumn("pos", pos)
    ident = lambda c: c.cast("string")
    return g.select(F.concat_ws("#", ident(F.col(key)), ident(F.col("scene"))).alias("channel"), "pos", ident(F.col("pos")).alias("id"), F.when(F.col("pos") > 1, ident(F.col("pos") - 1)).otherwise("").alias("reply"), F.regexp_replace("who", r"\.$", "").alias("speaker"), "text", F.lit("").alias("summary"), "vibe")


def verse_rows(docs: DataFrame, key: str, text: str, style: str = "B") -> DataFrame:
    """Verse: a blank line ends a stanza, lines alternate two voices, stage directions and lines
    over 240 characters are skipped. A thread per stanza."""
    d = _trimmed(docs, key, text)
    w = Window.partitionBy(key).orderBy("n")
    d = d.withColumn("stanza", F.sum((F.col("line") == "").cast("int")).over(w)).filter((F.col("line") != "") & ~_stage(F.col("line")) & (F.length("line") <= 240))
    d = d.withColumn("pos", F.row_number().over(Window.partitionBy(key, "stanza").orderBy("n")))
    return d.select(F.concat_ws("#", F.col(key).cast("string"), F.col("stanza").cast("string")).alias("channel"), "pos", F.col("pos").cast("string").alias("id"), F.when(F.col("pos") > 1, (F.col("pos") - 1).cast("string")).otherwise("").alias("reply"), F.when(F.col("pos") % 2 == 1, "VOICE-A").otherwise("VOICE-B").alias("speaker"), F.col("line").alias("text"), F.lit("").alias("summary"), F.lit(STYLE_SUMMARY.get(style, OTHER_SUMMARY)).alias("vibe"))


def logic_records(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Proof records between ``@logic hf1`` and ``@end``: key, record, task, theorem, proof,
    result, fault (null, or what is wrong with the record's frame)."""
    d = numbered_lines(docs, key, text).filter("line <> ''")
    w = Window.partitionBy(key).orderBy("n")
    opens, ends = F.col("line") == "@logic hf1", F.col("line") == "@end"
    d = d.withColumn("record", F.sum(opens.cast("int")).over(w)).withColumn("closed", F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    field = lambda name: F.max(F.regexp_extract("line", rf"^@{name} (.*)$", 1))
    known = opens | ends | F.col("line").rlike("^@(task|theorem|proof|result) ")
    g = d.groupBy(key, "record").agg(*(field(n).alias(n) for n in ("task", "theorem", "proof", "result")), F.count_if(ends).alias("ends"), F.count_if(~known).alias("unknown"), F.max("closed").alias("c"), F.count(F.lit(1)).alias("lines"))
    fault = F.when(F.col("record") == 0, "stray line").when(F.col("unknown") > 0, "unknown line").when(F.col("ends") == 0, "not ended or nested").when(F.col("ends") > 1, "stray end").when(F.col("lines") != 6, "fields missing or repeated")
    return g.select(key, "record", "task", "theorem", "proof", "result", fault.alias("fault"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_corpus(chunks: DataFrame, path: str, split: str, order: list, text: str) -> None:
    """Text corpora, a folder per split, chunks in order and apart by a blank line. Ranges of
    the order are the files, so a large split needs no single task; non-ASCII text raises."""
    ok = F.assert_true(F.col(text).rlike(r"^[\x00-\x7F]*$"), F.lit("a chunk is not ASCII")).isNull()
    d = chunks.filter(ok).repartitionByRange(split, *order).sortWithinPartitions(split, *order)
    d.select(split, F.concat(text, F.lit("\n")).alias("value")).write.partitionBy(split).text(path)


def with_text_offsets(rows: DataFrame, order: str, prefix: str, output: str) -> DataFrame:
    """Adds text_start, output_start and text_bytes of the rows' concatenation, in bytes."""
    from ..operators.sequence import distributed_offsets

    n = F.octet_length(F.encode(F.concat(prefix, output), "UTF-8"))
    d = distributed_offsets(rows.withColumn("text_bytes", n), order, "text_bytes", name="text_start")
    return d.withColumn("output_start", F.col("text_start") + F.octet_length(F.encode(prefix, "UTF-8")))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a path."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return d.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_inventory(found: DataFrame, lock: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed against a lock table of (path, sha256)."""
    j = found.select("path", F.col("sha256").alias("found")).join(lock.select("path", F.col("sha256").alias("locked")), "path", "full")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("locked").isNull(), "extra").when(F.col("found") != F.col("locked"), "changed")
    return j.select("path", fault.alias("fault")).filter("fault is not null")


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV metrics whose comment lines start with ``#``."""
    return spark.read.schema(schema).option("comment", "#").option("header", True).csv(path)


def pending(work: DataFrame, done: DataFrame, key: list[str], identity: str) -> DataFrame:
    """Work whose key is not finished; finished work under another identity raises (resumable jobs)."""
    other = F.col("__have") != F.col(identity)
    j = work.join(done.select(*key, F.col(identity).alias("__have")), key, "left")
    return j.filter(F.assert_true(F.col("__have").isNull() | ~other, F.lit("finished under another identity")).isNull()).filter("__have is null").drop("__have")
