"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Reading does not trust the record magic, which payloads may contain. Each task looks at its
archives, takes every magic at the start of a line as a candidate record, and emits its
offset with the offset of its successor (header end + Content-Length + the closing line
feeds). Candidates that follow one another from offset 0 are the records; pointer jumping
finds them in a number of shuffled steps that is the logarithm of the records in an archive,
so a candidate inside a payload, which no chain from the start meets, is dropped.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, materialize, new_path, small

MAGIC = b"WARC/1.0\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes of records that an archive holds, on average.
ARCHIVE_BYTES = 8 << 20
#: Bytes that no archive passes, but for a single record above it: the reader takes files of up to 2 GB.
MOST_BYTES = 1 << 30
#: Pages above this many bytes go to archives of their own kind, so that they do not cut the others short.
LARGE_PAGE = 1 << 20
#: Repeated payloads up to this many (some 40 MB) are broadcast to the pages; more are joined by shuffle.
REPEATED = 400_000
#: Revisits of one page beyond which they take a second key, and so on up to MOST_SALTS.
HOT, MOST_SALTS = 50_000, 999


def plan(pages: DataFrame, *, page_id="page_id", url="url", html="html") -> tuple[DataFrame, int, int]:
    """Records to write: page_id, url, html, payload_bytes, digest, refers_to (null: a response);
    and the mean and the most bytes of a payload. Texts are read once for this and once to be written."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    kinds = materialize(p.groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "payloads")
    mean, most = kinds.select(F.sum(F.col("n") * F.col("payload_bytes")) / F.sum("n"), F.max("payload_bytes")).first()
    first = kinds.filter((F.col("n") > 1) & (F.col("payload_bytes") >= LEAST_REVISIT)).select("digest", "first")
    rows = p.join(small(first, first.count(), REPEATED), "digest", "left").withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first"))).drop("first")
    return rows, int(mean or 0), int(most or 0)


def record(rows: DataFrame) -> Column:
    """Text of one record without its last line feed. A revisit carries headers alone."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    uri = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(MAGIC.decode()),
        head("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        head("WARC-Record-ID", urn(F.col("page_id"))),
        head("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        F.coalesce(head("WARC-Target-URI", uri), F.lit("")),
        head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(head("WARC-Refers-To", urn(F.col("refers_to"))), head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        head("Content-Type", F.lit("application/http;msgtype=response")),
        head("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),
    )


def write(pages: DataFrame, path: str, **names) -> None:
    """Write archives below ``path``, one record per row, where the rows are read: pages are only
    shuffled where repeated payloads are too many to be broadcast. Spark's own writer commits them, so any store will do and a lost task leaves
    nothing behind."""
    rows, mean, most = plan(pages, **names)
    head = 2048  # headers of a record, generously; a longer url only shortens the archive's slack

    def save(part: DataFrame, mean: int, most: int, mode: str) -> None:
        n = max(1, min(ARCHIVE_BYTES // (mean + head), MOST_BYTES // (most + head)))
        part.select(record(part).alias("value")).write.mode(mode).option("lineSep", "\r\n").option("maxRecordsPerFile", n).text(path)

    large = F.col("payload_bytes") > LARGE_PAGE
    save(rows if most <= LARGE_PAGE else rows.filter(~large), mean, min(most, LARGE_PAGE), "error")
    if most > LARGE_PAGE:
        save(rows.filter(large), most, most, "append")


_CAND = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("next", T.LongType()), T.StructField("page_id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("said", T.StringType())])


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def candidates(content: bytes):
    """Every magic at a line's start with a parsable header: (offset, next, page_id, type,
    refers_to, url, payload bytes, SHA-256 of the payload, digest that the header states).
    ``next`` is -1 where the record would pass the end of the archive.

    A header ends at a blank line and has no line that is a magic (it lacks the colon of a
    field), so of several magics before a blank line the last alone can be a record, and each
    byte is searched once.
    """
    at = content.find(MAGIC)
    while at >= 0:
        after = content.find(b"\n" + MAGIC, at + 1)
        follow = after + 1 if after >= 0 else -1
        end = content.find(b"\r\n\r\n", at, follow if follow >= 0 else len(content))
        if end >= 0 and (at == 0 or content[at - 1 : at] == b"\n"):
            fields = {}
            for line in content[at + len(MAGIC) : end].split(b"\r\n"):
                k, _, v = line.partition(b":")
                fields.setdefault(k.strip().lower(), v.strip().decode("utf-8", "replace"))
            length = fields.get(b"content-length", "")
            if length.isascii() and length.isdigit():
                a, b = end + 4, end + 4 + int(length)
                whole = content[b : b + 4] == b"\r\n\r\n"
                cut = content.find(b"\r\n\r\n", a, b) if whole and content.startswith(b"HTTP/", a) else -1
                body = memoryview(content)[cut + 4 if cut >= 0 else a : b] if whole else b""
                said = fields.get(b"warc-payload-digest", "")
                yield at, b + 4 if whole else -1, _page(fields.get(b"warc-record-id")), fields.get(b"warc-type"), _page(fields.get(b"warc-refers-to")), fields.get(b"warc-target-uri"), len(body), hashlib.sha256(body).hexdigest(), said.removeprefix("sha256:") if said.startswith("sha256:") else None
        at = follow


def _scan(batches):
    schema = to_arrow_schema(_CAND)
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = [(file, *c) for c in candidates(content.as_py())]
            for lo in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 4096]), schema.types)], schema=schema)


def reachable(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(file, offset) of the candidates on the chain from offset 0, by pointer jumping.

    ``nodes`` is (file, offset, next). In round k every pointer spans 2^k records; the
    reached set takes in what its members point at, and pointers double.
    """
    key = ["file", "offset"]
    # sides grow with the archives: merge joins at every size, no broadcast
    jump = materialize(nodes, "jump")
    reached = materialize(jump.filter("offset = 0").select(*key), "reached")
    n = reached.count()
    for _ in range(max_rounds):
        ahead = jump.join(reached.hint("merge"), key).select("file", F.col("next").alias("offset"))
        grown = materialize(reached.union(ahead.join(nodes.select(*key).hint("merge"), key, "left_semi")).distinct(), "reached")
        discard(reached)
        reached, before, n = grown, n, grown.count()
        if n == before:
            return reached
        far = jump.select("file", F.col("offset").alias("at"), F.col("next").alias("offset")).join(jump.hint("merge"), key)
        far = materialize(far.select("file", F.col("at").alias("offset"), "next"), "jump")
        discard(jump)
        jump = far
    raise RuntimeError(f"chains did not end in {max_rounds} rounds")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``: page_id, url, record_type, refers_to,
    payload_bytes and payload_digest (bare hex SHA-256) of the full payload; a revisit's
    payload is that of the record it refers to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    with_batches = files.mapInArrow(_scan, _CAND)
    cands = materialize(with_batches, "candidates")
    nodes = cands.select("file", "offset", "next").filter("next > 0")
    rows = cands.join(reachable(nodes), ["file", "offset"], "left_semi")
    revisits = rows.filter("type = 'revisit'").drop("payload_bytes", "digest")
    held = materialize(_referred(rows, revisits), "referred")
    met = F.col("refers_to").eqNullSafe(F.col("of")) & F.col("said").eqNullSafe(F.col("stated"))
    count, n_hot = held.agg(F.count(F.lit(1)), F.count_if(F.col("revisits") >= HOT)).first()
    if count > REPEATED and n_hot:  # they meet by shuffle: the many revisits of one page are spread over keys, by their places in the archives
        last = F.least(F.lit(MOST_SALTS), F.floor(F.col("revisits") / HOT)).cast("long")
        hot = held.filter(F.col("revisits") >= HOT).select(F.col("of").alias("hot"), F.col("stated").alias("hot_stated"), (last + 1).alias("salts"))
        known = F.col("refers_to").eqNullSafe(F.col("hot")) & F.col("said").eqNullSafe(F.col("hot_stated"))
        revisits = revisits.join(small(hot, n_hot, REPEATED), known, "left")  # one for each HOT revisits at most
        held = held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        met = met & (F.pmod(F.xxhash64("file", "offset"), F.coalesce("salts", F.lit(1))) == F.col("salt"))
    again = revisits.join(small(held, count, REPEATED), met, "left").select("page_id", "url", "type", "refers_to", F.col("b").alias("payload_bytes"), F.col("d").alias("digest"))
    plain = rows.filter("type <> 'revisit' or type is null").select("page_id", "url", "type", F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "digest")
    both = plain.union(again)
    return both.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "url")


def _referred(rows: DataFrame, revisits: DataFrame) -> DataFrame:
    """(of, stated, revisits, b, d): bytes and digest of the payload that so many revisits of page
    ``of`` with the header digest ``stated`` stand for. A page stored more than once with unlike payloads is
    told apart by the digest; where a revisit states none, the page's smallest digest counts."""
    asked = revisits.select(F.col("refers_to").alias("of"), F.col("said").alias("stated"))
    asked = asked.groupBy("of", "stated").agg(F.count(F.lit(1)).alias("revisits"))
    responses = rows.filter("type = 'response'").select(F.col("page_id").alias("of"), F.col("payload_bytes").alias("b"), F.col("digest").alias("d")).distinct()
    found = asked.join(responses, "of").filter("stated is null or stated = d")
    found = found.groupBy("of", "stated").agg(F.first("revisits").alias("revisits"), F.min(F.struct("d", "b")).alias("x"))
    return found.select("of", "stated", "revisits", "x.b", "x.d")


def round_trip(pages: DataFrame, *, path: str | None = None, **names) -> DataFrame:
    """Write every page, read the archives back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url.

    A null html is an empty payload. Of equal payloads of at least 100 bytes the smallest
    page_id is the response and the others revisit it; rows that repeat that page_id are all
    responses; a page_id that is stored with unlike payloads keeps each row's own payload; a
    null page_id stays null and is a response. A null url has no header; other columns are
    ignored; no rows give no rows.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path, **names)
    return read(spark, path)
