"""Binary sources and sinks: token streams, packed tokens, merge vocabularies.

Readers go through Spark's own binary reader and unpack in Arrow batches. Sinks go through
Spark's own text writer, which writes a row's bytes as they are and a separator after each: for
token streams the separator is the id that closes a record, for containers the last byte of the
spare id that ends each of them. So any store that Spark writes to will do, files appear under
their names only when the job commits, and what a lost task has written is never seen.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commit import put

# Fixed values of the file formats.
PACK_MAGIC, VOCABULARY_MAGIC = b"BRAIDPK1", b"LITBPE1\0"
PACK_HEADER, PACK_FIELDS = 64, 16
CHUNK = 32_768
BASE_TOKENS = 128
#: Records that a file holds at most, so that a reader holds little at a time.
FILE_RECORDS = 1000
#: Ids that a batch of read containers holds before it is passed on.
READ_IDS = 1 << 20


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def read_tokens(spark: SparkSession, path: str, width: int = 2, limit: int | None = None) -> DataFrame:
    """Token files as (path, chunk, tokens) of up to 32,768 little-endian unsigned ids.

    A size that is no multiple of ``width`` raises, and so does an id of ``limit`` or more.
    """
    schema = "path string, chunk long, tokens array<int>"

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                raw = c.as_py()
                if len(raw) % width:
                    raise ValueError(f"{p}: {len(raw)} bytes are no multiple of {width}")
                ids = np.frombuffer(raw, f"<u{width}").astype(np.int32)
                if limit is not None and len(ids) and ids.max() >= limit:
                    raise ValueError(f"{p}: an id is not below {limit}")
                for k in range(0, len(ids), CHUNK):
                    part = ids[k : k + CHUNK]
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([k // CHUNK], pa.int64()), pa.array([part], pa.list_(pa.int32()))], ["path", "chunk", "tokens"])

    return _files(spark, path).mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str, end: int) -> DataFrame:
    """Records of 16-bit token files as (path, tokens): the ids before each ``end``. A file whose
    last record is not closed, or with an odd size, raises."""

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                raw = c.as_py()
                if len(raw) % 2:
                    raise ValueError(f"{p}: {len(raw)} bytes are no multiple of 2")
                ids = np.frombuffer(raw, "<u2")
                closed = ids == end
                if len(ids) and not closed[-1]:
                    raise ValueError(f"{p}: the last record is not closed")
                ends = np.flatnonzero(closed)
                sizes = np.diff(ends, prepend=-1) - 1
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids[~closed].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(ends), pa.string()), tokens], ["path", "tokens"])

    return _files(spark, path).mapInArrow(run, "path string, tokens array<int>")


def save_vocabulary(spark: SparkSession, merges: list[tuple[int, int]], path: str) -> None:
    """A merge vocabulary as a file of its own, whole or not at all."""
    put(spark, path, vocabulary_bytes(merges))


def load_vocabulary(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Merges of a vocabulary file, which is small by its format."""
    return read_vocabulary(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def _ids_bytes(ids, width: int) -> bytes:
    if width not in (1, 2, 4, 8):
        return b"".join(int(i).to_bytes(width, "little") for i in ids)
    if len(a := np.asarray(ids, np.int64)) and (a.min() < 0 or a.max() >> 8 * width):
        raise OverflowError(f"an id does not fit {width} bytes")
    return a.astype(f"<u{width}").tobytes()


def _ids_array(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    if width not in (1, 2, 4, 8):
        return np.array([int.from_bytes(raw[at + i * width : at + (i + 1) * width], "little") for i in range(n)], np.int64)
    return np.frombuffer(raw, f"<u{width}", n, at)


def pack_bytes(ids, width: int = 2, **metadata) -> bytes:
    """A packed-token container: the active ids and one spare id, zero, behind them."""
    meta = json.dumps({**metadata, "activeTokens": len(ids)}).encode()
    head = PACK_MAGIC.ljust(PACK_FIELDS, b"\0") + struct.pack("<III", len(meta), len(ids) + 1, width)
    return head.ljust(PACK_HEADER, b"\0") + meta + _ids_bytes(ids, width) + bytes(width)


def _container_at(raw, at: int) -> tuple[int, int, dict, int]:
    """Where the ids of the container that starts at ``at`` begin, their width, its metadata, and
    where it ends."""
    if raw[at : at + len(PACK_MAGIC)] != PACK_MAGIC:
        raise ValueError("not a packed-token container")
    size, count, width = struct.unpack_from("<III", raw, at + PACK_FIELDS)
    meta, start = json.loads(bytes(raw[at + PACK_HEADER : at + PACK_HEADER + size])), at + PACK_HEADER + size
    end = start + max(count, meta["activeTokens"]) * width
    if len(raw) < end:
        raise ValueError("a packed-token container ends early")
    return start, width, meta, end


def _unpack_at(raw: bytes, at: int) -> tuple[np.ndarray, dict, int]:
    """Active ids and metadata of the container that starts at ``at``, and where it ends."""
    start, width, meta, end = _container_at(raw, at)
    return _ids_array(raw, start, meta["activeTokens"], width), meta, end


def unpack_bytes(raw: bytes) -> tuple[list[int], dict]:
    """Active ids and metadata of a packed-token container."""
    ids, meta, _ = _unpack_at(raw, 0)
    return ids.tolist(), meta


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(path, tokens, metadata as JSON) of packed-token containers; a file may hold several, one
    after the other."""
    schema = pa.schema([("path", pa.string()), ("tokens", pa.list_(pa.int32())), ("metadata", pa.string())])

    def batch(path, rows):
        ids = np.concatenate([r[0].astype(np.int32) for r in rows])
        ends = np.cumsum([0, *(len(r[0]) for r in rows)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), tokens, pa.array([json.dumps(r[1], sort_keys=True) for r in rows])], schema=schema)

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                raw, at, rows, held = c.as_py(), 0, [], 0
                while at < len(raw) or not raw:
                    ids, meta, at = _unpack_at(raw, at)
                    rows.append((ids, meta))
                    held += len(ids)
                    if held >= READ_IDS:
                        yield batch(p, rows)
                        rows, held = [], 0
                if rows:
                    yield batch(p, rows)

    return _files(spark, path).mapInArrow(run, "path string, tokens array<int>, metadata string")


def read_pack_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, ids, width, metadata as JSON) of packed-token containers: the active ids as the bytes
    that they are stored in. A container at a time, so a task holds a file and little else."""
    schema = pa.schema([("path", pa.string()), ("ids", pa.binary()), ("width", pa.int32()), ("metadata", pa.string())])

    def run(batches):
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                raw, at, rows, held = memoryview(c.as_buffer()), 0, [], 0
                while at < len(raw) or not len(raw):
                    start, width, meta, at = _container_at(raw, at)
                    rows.append((p, bytes(raw[start : start + meta["activeTokens"] * width]), width, json.dumps(meta, sort_keys=True)))
                    held += len(rows[-1][1])
                    if held >= READ_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return _files(spark, path).mapInArrow(run, "path string, ids binary, width int, metadata string")


def pack_texts(df: DataFrame, key: str, text: str, width: int = 2, rows: int = 256) -> DataFrame:
    """A container (``pack``) for each row: the UTF-8 bytes of a text as ids, and the key as
    ``document`` in its metadata. Null texts are empty. So many at a time leave a task."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                some = zip(b.column(0).slice(lo, rows).to_pylist(), b.column(1).slice(lo, rows).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([pack_bytes(np.frombuffer((t or "").encode(), np.uint8), width, document=k) for k, t in some], pa.binary())], ["pack"])

    return df.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(run, "pack binary")


def vocabulary_bytes(merges: list[tuple[int, int]]) -> bytes:
    return VOCABULARY_MAGIC + struct.pack("<II", 2, len(merges)) + b"".join(struct.pack("<HH", a, b) for a, b in merges)


def read_vocabulary(raw: bytes) -> list[tuple[int, int]]:
    """Merges of a vocabulary file, version 1 or 2; a pair may only use ids before it."""
    if not raw.startswith(VOCABULARY_MAGIC):
        raise ValueError("not a merge vocabulary")
    version, n = struct.unpack_from("<II", raw, len(VOCABULARY_MAGIC))
    if version not in (1, 2) or len(raw) != len(VOCABULARY_MAGIC) + 8 + 4 * n:
        raise ValueError("unknown version or wrong size")
    pairs = [struct.unpack_from("<HH", raw, len(VOCABULARY_MAGIC) + 8 + 4 * i) for i in range(n)]
    if any(max(p) >= BASE_TOKENS + i for i, p in enumerate(pairs)):
        raise ValueError("a merge uses an id that does not exist yet")
    return pairs


def _bytes_of_ids(x: pa.Array) -> pa.Array:
    """Little-endian 16-bit ids of each list, as bytes."""
    ids = x.flatten().to_numpy(zero_copy_only=False)
    if len(ids) and (ids.min() < 0 or ids.max() > 65_535):
        raise ValueError("an id does not fit 16 bits")
    sizes = np.asarray(x.value_lengths().to_numpy(zero_copy_only=False))
    offsets = (2 * np.r_[0, np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])


def _write_raw(rows: DataFrame, path: str, separator: bytes, records: int, by: list[str]) -> None:
    """A string column's bytes as files, ``separator`` after each row."""
    w = rows.write.mode("append").option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).option("maxRecordsPerFile", records)  # 0: no limit
    (w.partitionBy(*by) if by else w).text(path)


def write_tokens(df: DataFrame, path: str, end: int, label: str | None = None, records: int = FILE_RECORDS) -> None:
    """Token arrays (column ``tokens``) as files of 16-bit little-endian ids, each array closed by
    the id ``end``, which no array may hold. Null arrays are no records.

    With ``label`` (a string column) in a folder for each of its values; see :func:`label_folder`.
    """
    ids = F.col("tokens").cast(T.ArrayType(T.IntegerType()))
    d = df.filter(F.col("tokens").isNotNull() & F.assert_true(~F.array_contains(ids, end), F.lit("an array holds the closing id")).isNull())
    raw = F.arrow_udf(_bytes_of_ids, T.BinaryType())(ids).cast("string").alias("value")
    if label is None:
        return _write_raw(d.select(raw), path, end.to_bytes(2, "little"), records, [])
    name = F.coalesce(F.concat(F.lit("label-"), F.hex(F.encode(F.col(label).cast("string"), "UTF-8"))), F.lit("null"))
    return _write_raw(d.select(name.alias("of"), raw), path, end.to_bytes(2, "little"), records, ["of"])


def label_folder(label: str | None) -> str:
    """Folder of a label: its UTF-8 in hex, so that any value is a name; null has its own."""
    return "of=null" if label is None else "of=label-" + label.encode().hex().upper()


def folder_label(path: Column) -> Column:
    """Label of a file by its path, the inverse of :func:`label_folder`."""
    code = F.regexp_extract(path, r"/of=label-([0-9A-F]*)/[^/]*$", 1)
    return F.when(path.rlike("/of=null/[^/]*$"), F.lit(None).cast("string")).otherwise(F.decode(F.unhex(code), "UTF-8"))


def write_packs(df: DataFrame, path: str, records: int = FILE_RECORDS) -> None:
    """Containers (column ``pack``, see :func:`pack_bytes`) one after the other in files of so many.
    A container must end in a zero byte, as one with a spare id does."""
    n = F.octet_length("pack")
    body = F.expr("substring(pack, 1, octet_length(pack) - 1)")
    ok = F.assert_true((n > 0) & (F.expr("substring(pack, octet_length(pack), 1)") == F.lit(bytes(1))), F.lit("a container without a spare id")).isNull()
    _write_raw(df.filter(ok).select(body.cast("string").alias("value")), path, bytes(1), records, [])


def token_bytes(pieces: DataFrame, ident: str, piece: str) -> DataFrame:
    """Byte length of each token, the side table of a stream."""
    return pieces.select(ident, F.octet_length(piece).alias("bytes"))
