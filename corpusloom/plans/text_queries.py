"""Queries of the text transforms and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .registry import register, table

DOCS = "documents"


def docs(spark, sf, *cols):
    return table(spark, sf, DOCS).select("doc_id", *(cols or ("text",)))


def text_query(name, expr, sql=None, column="out", where=""):
    """A query that maps every document's text through one expression."""

    @register(name, f"SELECT doc_id, {sql} AS {column} FROM documents {where}" if sql else None)
    def run(spark, sf):
        d = docs(spark, sf)
        return d.select("doc_id", expr(F.col("text")).alias(column))

    return run


WORDS_SQL = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"
# Latin text exercises the normalisers; accents, quotes and dashes are added in front.
SAMPLE = "“‘Æœ’”–—… ñß"

text_query("p02_ascii_strict", lambda t: X.ascii_strict(F.concat(F.lit(SAMPLE), t)),
           "regexp_replace(translate(replace(replace(replace(replace(replace('" + SAMPLE + "' || text, '…', '...'), 'Æ', 'AE'), 'æ', 'ae'), 'Œ', 'OE'), 'œ', 'oe'), '"
           + "‘’‚‛“”„‟–—−    " + X.LATIN_FROM + "', '''''''''\"\"\"\"---    " + X.LATIN_TO + "'), '[^\\x00-\\x7F]', '?', 'g')")
text_query("p01_book_paragraphs", lambda t: X.collapse_paragraphs(X.book_ascii(t)))
text_query("p03_generalist_ascii", X.generalist_ascii)
text_query("p04_browser_ascii", lambda t: X.browser_ascii(F.concat(F.lit(SAMPLE), t)))
text_query("p05_chat_bytes", X.chat_bytes, "regexp_replace(regexp_replace(regexp_replace(text, '[\\x{80}-\\x{7FF}]', '??', 'g'), '[\\x{800}-\\x{FFFF}]', '???', 'g'), '[\\x00-\\x1F]', ' ', 'g')")
text_query("p20_compact_message", X.compact_message, "right(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 150)")
text_query("p20_compact_summary", X.compact_summary, "left(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 100)")
text_query("p25_account_key", X.account_key, "regexp_replace(lower(text), '[0-9]+', 'N', 'g')")
text_query("p10_split_lines", lambda t: X.split_lines(t), "regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+$')")
text_query("p32_trim_continuation", X.trim_continuation, "CASE WHEN regexp_extract(text, '(?s)^(.*[.!?][\"'']?)(\\s.*)?$', 1) = '' THEN text ELSE regexp_extract(text, '(?s)^(.*[.!?][\"'']?)(\\s.*)?$', 1) END")
text_query("f04_word_count", lambda t: X.word_count(t) >= 100, f"len({WORDS_SQL}) >= 100", "long_enough")
text_query("f15_is_ascii", X.is_ascii, "regexp_full_match(text, '[\\x00-\\x7F]*')", "ascii")
text_query("sf12_capitalise", lambda t: X.capitalise(X.simple_lower(t)), "upper(left(lower(text), 1)) || substr(lower(text), 2)")
text_query("sf34_html_escape", lambda t: X.html_escape(F.concat(F.lit("<a&b>"), t)), "replace(replace(replace('<a&b>' || text, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')")
text_query("sf01_sha256", lambda t: F.sha2(t, 256), "sha256(text)")
text_query("sf13_trims", lambda t: F.concat(F.rtrim(t, F.lit(".")), F.lit("|"), F.trim(t, F.lit("T."))), "rtrim(text, '.') || '|' || trim(text, 'T.')")
text_query("sf16_byte_length", lambda t: F.octet_length(t).cast("long"), "strlen(text)")
text_query("sf35_hex", lambda t: F.hex(F.encode(t, "UTF-8")), "hex(encode(text))")
text_query("sf08_tokens_unicode", lambda t: F.size(F.regexp_extract_all(t, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))), "len(regexp_extract_all(text, '[\\pL\\pM\\p{Nd}\\p{Pc}]+|[^\\pL\\pM\\p{Nd}\\p{Pc}\\s]'))")


@register("p06_layout_noise", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || repeat('-+=', 8) || chr(10) || '[]', chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE
    (length(regexp_replace(line, '[ \t\r]', '', 'g')) >= 20 AND length(regexp_replace(line, '[^-+=]', '', 'g')) = length(regexp_replace(line, '[ \t\r]', '', 'g')))
    OR (length(line) > 100 AND contains(line, '|'))
    OR regexp_replace(line, '^[ \t]+|[ \t\r]+$', '', 'g') IN ('[]', 'Graphics and textual content produced by Lolaness.')) AS noise
FROM l GROUP BY doc_id""")
def p06(spark, sf):
    """Layout-noise lines per document."""
    lines = docs(spark, sf).select("doc_id", F.explode(F.split(F.concat("text", F.lit("\n" + "-+=" * 8 + "\n[]")), "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(X.is_layout_noise(F.col("line"))).alias("noise"))


@register("p07_editorial_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
c AS (SELECT doc_id, pos, regexp_matches(line, '^[ \t\r]+[^ \t\r]') AS ind,
  trim(regexp_replace(regexp_replace(replace(line, '_', ''), '\\([!?.])', '\1', 'g'), '[ \t\r]+', ' ', 'g')) AS body FROM l)
SELECT doc_id, pos::INT AS pos, CASE WHEN body = '' THEN '' WHEN ind THEN '    ' || body ELSE body END AS line FROM c""")
def p07(spark, sf):
    """Editorial cleaning, line by line."""
    lines = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", X.editorial_line(F.col("line")).alias("line"))


@register("w32_blank_runs", r"""
WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || repeat(chr(10), 4)), chr(10))) AS line,
  generate_subscripts(string_split(replace(text, '. ', '.' || repeat(chr(10), 4)), chr(10)), 1) - 1 AS pos FROM documents),
g AS (SELECT *, trim(line) = '' AS blank, sum(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l),
r AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id, run ORDER BY pos) AS k FROM g)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE NOT blank OR k <= 2) AS kept FROM r GROUP BY doc_id""")
def w32(spark, sf):
    """At most two blank lines in a row."""
    from ..operators.sequence import limit_blank_runs

    d = docs(spark, sf).select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit("." + "\n" * 4)), "\n")).alias("pos", "line"))
    kept = limit_blank_runs(d, "doc_id", "pos", "line")
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("keep").alias("kept"))


@register("p11_char_vocabulary", """
WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents)
SELECT ch, row_number() OVER (ORDER BY encode(ch)) - 1 AS id FROM c WHERE ch <> ''""")
def p11(spark, sf):
    """Sorted distinct characters and their ids."""
    from ..operators.tokens import char_vocabulary

    return char_vocabulary(docs(spark, sf), "text")


@register("p12_encode_characters", """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents WHERE text <> ''),
v AS (SELECT ch, row_number() OVER (ORDER BY encode(ch)) - 1 AS id FROM (SELECT DISTINCT ch FROM c))
SELECT doc_id, count(*) AS tokens, sum((pos % 97) * id)::BIGINT AS checksum FROM c JOIN v USING (ch) GROUP BY doc_id""")
def p12(spark, sf):
    """Character ids of every document, as a count and a positional checksum."""
    from ..operators.tokens import char_vocabulary, encode_characters

    d = docs(spark, sf)
    ids = encode_characters(d, char_vocabulary(d, "text"), "doc_id", "text")
    weight = F.aggregate(F.transform("ids", lambda x, i: ((i + 1) % 97) * x), F.lit(0).cast("long"), lambda a, x: a + x)
    return ids.filter(F.size("ids") > 0).select("doc_id", F.size("ids").cast("long").alias("tokens"), weight.alias("checksum"))


@register("p19_clip", r"""
WITH t AS (SELECT doc_id, text, right(text, 60) AS tail, left(text, 61) AS head FROM documents),
u AS (SELECT *, CASE WHEN instr(tail, ' ') > 0 THEN substr(tail, instr(tail, ' ') + 1) ELSE '' END AS word, length(head) - instr(reverse(head), ' ') AS cut FROM t)
SELECT doc_id, CASE WHEN length(text) <= 60 THEN text WHEN length(word) < 30 THEN tail ELSE word END AS tail,
  CASE WHEN length(text) <= 60 THEN text WHEN instr(head, ' ') > 0 AND cut > 30 THEN left(text, cut) ELSE left(text, 60) END AS head FROM u""")
def p19(spark, sf):
    """Message clipping from either end."""
    return docs(spark, sf).select("doc_id", X.clip_tail(F.col("text"), 60).alias("tail"), X.clip_head(F.col("text"), 60).alias("head"))


@register("p24_shape", """
SELECT doc_id, replace(replace(text, split_part(text, ' ', 1), '<>'), split_part(text, ' ', 2), '<>') AS shape
FROM documents WHERE split_part(text, ' ', 1) <> '' AND split_part(text, ' ', 2) <> ''""")
def p24(spark, sf):
    """Copied spans (the first two words) masked in the text."""
    w = F.split("text", " ")
    d = docs(spark, sf).withColumn("spans", F.array(F.get(w, F.lit(0)), F.coalesce(F.get(w, F.lit(1)), F.lit("")))).filter("spans[0] <> '' and spans[1] <> ''")
    return d.select("doc_id", X.shape(F.col("text"), F.col("spans")).alias("shape"))


@register("p27_normalise_directions", r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '\bto the north(ern)? of\b', 'north of', 'g'), '\bto the south(ern)? of\b', 'south of', 'g') AS out
FROM (SELECT doc_id, 'It lies to the northern of here and to the south of there. ' || text AS text FROM documents)""")
def p27(spark, sf):
    """Direction phrases rewritten to one form."""
    t = F.concat(F.lit("It lies to the northern of here and to the south of there. "), F.col("text"))
    for way in ("north", "south"):
        t = F.regexp_replace(t, rf"\bto the {way}(ern)? of\b", f"{way} of")
    return docs(spark, sf).select("doc_id", t.alias("out"))


@register("p29_cue_prefix", """
SELECT doc_id, (CASE WHEN n_chars % 100 < 40 THEN '? ' ELSE '' END) || (CASE WHEN n_chars % 7 >= 4 THEN '~ ' ELSE '' END) || text AS cue,
 CASE WHEN n_chars % 100 < 40 THEN rtrim(text, '.') || ', or so I heard.' WHEN n_chars % 2 = 0 THEN rtrim(text, '.') || ', they say.' ELSE rtrim(text, '.') || '.' END AS answer
FROM documents""")
def p29(spark, sf):
    """Confidence cues (P29) and answer suffixes."""
    d, head = docs(spark, sf, "text", "n_chars"), F.col("text")
    conf = F.col("n_chars") % 100
    return d.select("doc_id", X.cue_prefix(head, conf, F.col("n_chars") % 7).alias("cue"), X.answer_suffix(head, conf, F.col("n_chars") % 2 == 0).alias("answer"))


@register("p30_styled_spans", """
SELECT doc_id, 'Élan: ' || split_part(text, '.', 1) || '!' AS styled, strlen('Élan: ')::INT AS first_start, (strlen('Élan: ') + strlen(split_part(text, ' ', 1)) + 1)::INT AS second_start FROM documents""")
def p30(spark, sf):
    """Opener and ending around a text; byte spans shift by the opener's bytes."""
    from ..operators.spans import shift_spans

    first = F.octet_length(F.get(F.split("text", " "), F.lit(0)))
    spans = F.array(F.struct(F.lit(0).alias("start")), F.struct((first + 1).alias("start")))
    d = docs(spark, sf).withColumn("spans", shift_spans(spans, F.lit("Élan: ")))
    return d.select("doc_id", F.concat(F.lit("Élan: "), F.get(F.split("text", r"\."), F.lit(0)), F.lit("!")).alias("styled"), F.col("spans")[0]["start"].alias("first_start"), F.col("spans")[1]["start"].alias("second_start"))


@register("p21_render_spans", """
SELECT doc_id, source || ' wrote in ' || lang || ' about ' || split_part(text, ' ', 1) || '.' AS text,
  0 AS s0, strlen(source)::INT AS e0, (strlen(source) + 10)::INT AS s1, (strlen(source) + 10 + strlen(lang))::INT AS e1,
  (strlen(source) + 17 + strlen(lang))::INT AS s2, (strlen(source) + 17 + strlen(lang) + strlen(split_part(text, ' ', 1)))::INT AS e2
FROM documents""")
def p21(spark, sf):
    """Template rendering with byte spans of its slots."""
    from ..operators.spans import render_template

    d = docs(spark, sf, "source", "lang", "text").withColumn("topic", F.get(F.split("text", " "), F.lit(0)))
    r = render_template("{source} wrote in {lang} about {topic}.", ["source", "lang", "topic"])
    d = d.select("doc_id", r.alias("r"))
    at = lambda i, f: F.col("r.spans")[i][f]
    return d.select("doc_id", F.col("r.text").alias("text"), *(at(i, f).cast("int").alias(f"{f[0]}{i}") for i in range(3) for f in ("start", "end")))


@register("p33_drop_prompt", "SELECT doc_id, substr(text, length(left(text, 20)) + 1) AS continuation FROM documents")
def p33(spark, sf):
    """Output without its prompt."""
    return docs(spark, sf).select("doc_id", X.drop_prompt(F.col("text"), F.left("text", F.lit(20))).alias("continuation"))


@register("p34_masked_labels", f"""
SELECT doc_id, list_sum(list_concat(list_transform(range(0, least(8, n)), lambda x: -100), range(least(8, n), n)))::BIGINT AS total, n AS size
FROM (SELECT doc_id, len({WORDS_SQL}) AS n FROM documents)""")
def p34(spark, sf):
    """Labels with -100 over the prefix."""
    from ..operators.tokens import masked_labels

    ids = F.transform(X.words(F.col("text")), lambda w, i: i)
    d = docs(spark, sf).select("doc_id", masked_labels(ids, F.lit(8)).alias("labels"))
    total = F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("doc_id", F.when(F.size("labels") > 0, total).alias("total"), F.size("labels").cast("long").alias("size"))


@register("f01_has_word", r"""
SELECT doc_id, w AS name, regexp_matches(text, '(?i)(^|[^\pL\pM\p{Nd}\p{Pc}])' || w || '($|[^\pL\pM\p{Nd}\p{Pc}])') AS found
FROM documents, (VALUES ('the'), ('La'), ('und'), ('él')) v(w)""")
def f01(spark, sf):
    """Names at word bounds (F1, F2)."""
    names = F.array(*(F.lit(x) for x in ("the", "La", "und", "él")))
    d = docs(spark, sf).withColumn("name", F.explode(names))
    return d.select("doc_id", "name", X.has_word(F.col("text"), F.col("name")).alias("found"))


@register("f03_style_sentences", r"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE length(s) BETWEEN 35 AND 180 AND NOT regexp_matches(s, '[0-9]')
  AND len(regexp_extract_all(regexp_replace(s, '^[^ \t\n\r\f\v]+', ''), '\b[A-Z]')) <= 1
  AND length(s) - length(replace(s, ';', '')) <= 1 AND length(s) - length(replace(s, ':', '')) <= 1) AS styled
FROM s GROUP BY doc_id""")
def f03(spark, sf):
    """Narrative sentences that may serve as style samples."""
    s = docs(spark, sf).select("doc_id", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(X.is_style_sentence(F.col("s"))).alias("styled"))


@register("f05_degenerate", f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, len(w) > 3 AND len(list_distinct(w)) * 2 < len(w) AS few_words FROM w""")
def f05(spark, sf):
    """Replies in which fewer than half of the words differ."""
    w = X.words(F.lower("text"))
    return docs(spark, sf).select("doc_id", ((F.size(w) > 3) & (F.size(F.array_distinct(w)) * 2 < F.size(w))).alias("few_words"))


@register("f05_repeated_word")
def f05b(spark, sf):
    """Degenerate replies with a word three times in a row (a back reference, beyond RE2)."""
    return docs(spark, sf).select("doc_id", X.is_degenerate(F.col("text")).alias("degenerate"))


@register("f06_leak_markers", "SELECT doc_id, contains(text, '# ') AS leak, trim(text) = '' AS empty, regexp_matches(text, '[.!?]$') AS stopped FROM documents")
def f06(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", t.contains("# ").alias("leak"), (F.trim(t) == "").alias("empty"), t.rlike(r"[.!?]\z").alias("stopped"))


@register("f07_all_spans_present", f"""
SELECT doc_id, CASE WHEN len(w) > 0 THEN len(list_filter(w[1:3], lambda x: contains(lower(text), x))) = len(w[1:3]) END AS present
FROM (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents)""")
def f07(spark, sf):
    """Whether all copied spans (the first three words) occur in the lower-cased text."""
    spans = F.slice(X.words(F.col("text")), 1, 3)
    return docs(spark, sf).select("doc_id", X.all_present(F.lower("text"), spans).alias("present"))


@register("f08_speaker_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(upper(replace(text, 'ß', 'ss')), ' ')) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^[A-Z0-9 ''&,.-]{1,63}\.$') AND regexp_matches(line, '[A-Z]') AND NOT regexp_matches(line, '^(ACT|SCENE)')) AS speakers
FROM l GROUP BY doc_id""")
def f08(spark, sf):
    """Speaker-line test over upper-cased words."""
    lines = docs(spark, sf).select("doc_id", F.explode(F.split(F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))), " ")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(X.is_speaker_line(F.col("line"))).alias("speakers"))


@register("f09_boundary_lines", r"""
SELECT page_id, starts_with(url, 'https://') OR starts_with(url, 'http://') AS boundary FROM pages""")
def f09(spark, sf):
    """Prefix tests (stage directions, scene boundaries) as one disjunction."""
    return table(spark, sf, "pages").select("page_id", (F.startswith("url", F.lit("https://")) | F.startswith("url", F.lit("http://"))).alias("boundary"))


@register("sc16_string_literals", r"""
WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '"([^"\n]{3,60})"', 1)) AS s FROM pages)
SELECT page_id, count(*) AS literals, count(*) FILTER (WHERE contains(s, ' ')) AS spaced FROM m WHERE NOT regexp_matches(s, '[{}<>]') GROUP BY page_id""")
def sc16(spark, sf):
    """Quoted literals in source text, by length and metacharacters."""
    s = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'"([^"\n]{3,60})"'), F.lit(1))).alias("s"))
    return s.filter(~F.col("s").rlike("[{}<>]")).groupBy("page_id").agg(F.count("*").alias("literals"), F.count_if(F.col("s").contains(" ")).alias("spaced"))


@register("sc17_tagged_prompts", r"""
SELECT doc_id, regexp_extract(l, '^(.*) > (.*)$', 1) AS prompt, regexp_extract(l, '^(.*) > (.*)$', 2) AS label
FROM (SELECT doc_id, split_part(text, chr(10), 1) || ' > ' || source || ' > ' || lang AS l FROM documents)""")
def sc17(spark, sf):
    """``prompt > label`` lines, cut at the last separator."""
    line = F.concat_ws(" > ", F.get(F.split("text", "\n"), F.lit(0)), F.col("source"), F.col("lang"))
    return docs(spark, sf, "text", "source", "lang").select("doc_id", X.tagged_prompt(line).alias("p")).select("doc_id", "p.prompt", "p.label")


@register("sc18_log_updates", r"""
WITH l AS (SELECT event_id, 'update ' || event_id || ' loss ' || round(value, 3) AS line FROM events)
SELECT event_id, CAST(regexp_extract(line, '^update (\d+) loss (\S+)', 1) AS BIGINT) AS step, CAST(regexp_extract(line, '^update (\d+) loss (\S+)', 2) AS DOUBLE) AS loss FROM l""")
def sc18(spark, sf):
    """Training-log lines read by pattern."""
    line = F.concat(F.lit("update "), F.col("event_id").cast("string"), F.lit(" loss "), F.round("value", 3).cast("string"))
    p = r"^update (\d+) loss (\S+)"
    d = table(spark, sf, "events").select("event_id", line.alias("line"))
    return d.select("event_id", F.regexp_extract("line", p, 1).cast("long").alias("step"), F.regexp_extract("line", p, 2).cast("double").alias("loss"))
