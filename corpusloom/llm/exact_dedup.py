"""Exact deduplication with counting quotient filters.

Each partition digests its normalised texts and builds a counting quotient filter of their
fingerprints, which are only so long that some 1 in 65,536 texts shares one by accident. The
high bits of a fingerprint (the quotient) name a slot, of which a bit says whether it is in
use; the rest (the remainder) is stored in as many bits as it has, sorted within its slot's
run, with a bit that ends the run; a counter is stored only where a fingerprint occurs more
than once. Filters of all partitions merge block by block: sorted remainders meet and
counters add up, so no count is lost. Fingerprints with a count above one route their texts
to byte verification; all other texts stay in their task while those fingerprints are few enough to
be broadcast, and meet them by shuffle beyond.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import expanded, materialize, small

#: Fingerprints that a block of the merged filter holds on average: its size in a merging task.
BLOCK = 1 << 18
#: Bits of a fingerprint beyond those that number the rows: texts that share one by accident are verified like copies.
SPARE = 17
#: Fingerprints of repeated texts up to this many (16 MB) are broadcast, more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def normalised(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z alone lower-cased (bytes.lower() leaves other letters alone)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _digests(with_text: bool, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                norm = [normalised(t) for t in b.column(1).to_pylist()]
                sha = [hashlib.sha256(x).digest() for x in norm]
                fp = np.frombuffer(b"".join(x[:8] for x in sha), ">i8").astype(np.int64)
                out = [b.column(0), pa.array(fp), pa.array(sha, pa.binary())] + [pa.array(norm, pa.binary())] * with_text
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


_BLOB = ("occupied", "ends", "remainders", "many", "counts")
_FILTER = T.StructType([T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("slots", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in _BLOB)])
_COUNTED = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n", T.LongType())])


def _slot_bits(n: int, width: int) -> int:
    """Bits of the quotient: between one and two slots a fingerprint."""
    return min(width, n.bit_length())


def encode_filter(values: np.ndarray, counts: np.ndarray, width: int) -> dict:
    """Counting quotient filter of sorted distinct ``values`` below 2**width."""
    q = _slot_bits(len(values), width)
    rest = width - q
    quotient = (values >> np.uint64(rest)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    bits = (values[:, None] >> np.arange(rest, dtype=np.uint64)) & np.uint64(1)
    return {
        "n": len(values),
        "slots": q,
        "occupied": np.packbits(occupied).tobytes(),
        "ends": np.packbits(np.r_[quotient[1:] != quotient[:-1], True]).tobytes(),
        "remainders": np.packbits(bits.astype(bool)).tobytes(),
        "many": np.packbits(counts > 1).tobytes(),
        "counts": counts[counts > 1].astype("<i8").tobytes(),
    }


def decode_filter(f: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and their counts."""
    n, q = f["n"], f["slots"]
    flags = lambda raw, k: np.unpackbits(np.frombuffer(raw, np.uint8), count=k).astype(bool)
    ends, rest = flags(f["ends"], n), width - q
    run = np.cumsum(ends) - ends  # number of the run that a remainder lies in
    quotient = np.flatnonzero(flags(f["occupied"], 1 << q))[run].astype(np.uint64)
    bits = flags(f["remainders"], n * rest).reshape(n, rest)
    values = quotient << np.uint64(rest)
    for k in range(rest):
        values |= bits[:, k].astype(np.uint64) << np.uint64(k)
    counts = np.ones(n, np.int64)
    counts[flags(f["many"], n)] = np.frombuffer(f["counts"], "<i8")
    return values, counts


def fingerprint_bits(rows: int) -> int:
    return min(63, max(1, rows).bit_length() + SPARE)


def _build(length: int, block_bits: int):
    """Counting quotient filters of one partition: a row per block that is in use."""
    schema, width = to_arrow_schema(_FILTER), length - block_bits

    def emit(held):
        values, counts = np.unique(np.concatenate(held).view(np.uint64) >> np.uint64(64 - length), return_counts=True)
        block = (values >> np.uint64(width)).astype(np.int64)
        inside = values & np.uint64((1 << width) - 1)
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        rows = []
        for a, e in zip(at, np.r_[at[1:], len(block)]):
            f = encode_filter(inside[a:e], counts[a:e], width)
            rows.append((int(block[a]), f["n"], f["slots"], *(f[c] for c in _BLOB)))
            if len(rows) == 256 or e == len(block):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= 1_000_000:  # a full filter goes out, merging adds its counters
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    return run


def _merge(length: int, block_bits: int):
    """Merge the filters of one block: sorted remainders meet, counters add up."""
    width = length - block_bits

    def run(key, filters):
        parts = [decode_filter(f, width) for f in filters.to_pylist()]
        values, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(values, kind="stable")  # merges the sorted runs
        values, counts = values[order], counts[order]
        at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        total = np.add.reduceat(counts, at)
        many = total > 1
        fp = np.int64(key[0].as_py()) << np.int64(width) | values[at][many].astype(np.int64)
        return pa.table({"fp": fp, "n": total[many]})

    return run


def repeated_fingerprints(meta: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once, from merged filters. ``fp`` in
    ``meta`` are 64 bits, in the result their first ``fingerprint_bits(rows)``."""
    length = fingerprint_bits(rows)
    block_bits = max(0, (max(1, rows) // BLOCK).bit_length())
    filters = meta.select("fp").mapInArrow(_build(length, block_bits), _FILTER)
    return filters.groupBy("block").applyInArrow(_merge(length, block_bits), _COUNTED)


def exact_groups(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only, byte for byte; a null text
    counts as empty. Of equal texts the row with the largest doc_id stays; rows that repeat
    both doc_id and text are one document stored twice, and only one of them is kept. A null
    doc_id is smaller than any other. Other columns are ignored, no rows give no rows.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_field = T.StructField("doc_id", src.schema["doc_id"].dataType)
    fields = T.StructType([id_field, T.StructField("fp", T.LongType()), T.StructField("sha", T.BinaryType())])
    meta = materialize(src.mapInArrow(_digests(False, to_arrow_schema(fields)), fields), "digests")
    rows = meta.count()
    hot = materialize(repeated_fingerprints(meta, rows), "repeated")
    n_hot = hot.count()
    short = F.shiftrightunsigned("fp", 64 - fingerprint_bits(rows))
    full = T.StructType([*fields.fields, T.StructField("norm", T.BinaryType())])
    texts = src.mapInArrow(_digests(True, to_arrow_schema(full)), full)
    # Byte verification: grouping by the bytes themselves; copies collapse before the shuffle.
    same = texts.withColumn("short", short).join(small(hot.select(F.col("fp").alias("short")), n_hot, BROADCAST_ROWS), "short", "left_semi").groupBy("fp", "sha", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(same.drop("norm").filter("group_size > 1").withColumn("in_digest", F.count(F.lit(1)).over(Window.partitionBy("fp", "sha"))), "verified")
    if groups.filter("in_digest > 1").limit(1).count():
        raise ValueError("two different texts share a SHA-256 digest")
    kept = groups.select("fp", "sha", "keep_id", "group_size")
    out = meta.join(small(kept, n_hot, BROADCAST_ROWS // 4), ["fp", "sha"], "left")
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    out = out.select("doc_id", "sha", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), size.alias("group_size"))
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    cols = ["doc_id", "keep_id", "group_size", "sha"]
    # rows that repeat the kept doc_id and its text are counted, and one of them stays
    again = materialize(out.filter(best & (F.col("group_size") > 1)).groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "stored-twice")
    if n_again := again.count():
        mark = small(again.select(F.col("doc_id").alias("d"), F.col("sha").alias("s")), n_again, BROADCAST_ROWS // 4)
        out = out.join(mark, best & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s")), "left_anti")
        twice = expanded(again, "copies", "copy")
        out = out.select(*cols, best.alias("kept")).union(twice.select(*cols, (F.col("copy") == 0).alias("kept")))
    else:
        out = out.withColumn("kept", best)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
