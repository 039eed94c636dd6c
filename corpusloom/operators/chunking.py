"""Paragraph packing and near-duplicate chunks."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_spans(ends: list[int], size: int, line_end) -> list[tuple[int, int]]:
    """Spans of the records of a body whose paragraphs end at ``ends`` and are two characters apart.

    A record that starts at ``s`` reaches to the last paragraph that ends within ``size`` and the
    separator of it, at least to the end of the paragraph that ``s`` lies in. A record that would
    still be over twice ``size`` stops behind the last line end that ``line_end(s, s + size)``
    finds, or at ``size`` where there is none, and the next one starts there.
    """
    spans, s = [], 0
    while ends and s < ends[-1]:
        own = bisect_right(ends, s)
        stop = ends[max(own, bisect_right(ends, s + size + 2) - 1)]
        if stop - s > 2 * size:
            cut = line_end(s, s + size)
            stop = cut if cut > s else s + size
            spans.append((s, stop))
            s = stop + 2 if stop == ends[own] else stop
        else:
            spans.append((s, stop))
            s = stop + 2
    return spans


def paragraph_records(text: str, size: int) -> list[str]:
    """Bodies of the records of a text: its non-blank paragraphs (between blank lines), packed."""
    paragraphs = [p for p in (part.strip("\n") for part in text.split("\n\n")) if p.strip()]
    body = "\n\n".join(paragraphs)
    ends = [e - 2 for e in accumulate(len(p) + 2 for p in paragraphs)]
    spans = chunk_spans(ends, size, lambda lo, hi: body.rfind("\n", lo, hi) + 1)
    whole = set(ends)
    return [body[a:b] if b in whole else body[a:b].rstrip() for a, b in spans]


def pack_paragraphs(docs: DataFrame, key: str, text: str, tag: str, size: int, least: int = 0) -> DataFrame:
    """(key, chunk, body): records of every document, each behind its tag, a map over its text.
    Bodies of fewer than ``least`` characters are left out, and chunks keep their numbers."""
    packed = lambda t: [f"<{tag}>\n{r}\n" if len(r) >= least else None for r in paragraph_records(t or "", size)]
    chunks = F.arrow_udf(lambda x: pa.array([packed(t) for t in x.to_pylist()], pa.list_(pa.string())), T.ArrayType(T.StringType()))
    return docs.select(key, F.posexplode(chunks(text)).alias("chunk", "body")).filter("body is not null")


@F.arrow_udf(T.LongType())
def simhash64(x: pa.Array) -> pa.Array:
    """SimHash of distinct lower-case words."""
    out = []
    for t in x.to_pylist():
        words = set((t or "").lower().split())
        if not words:
            out.append(0)
            continue
        raw = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words), np.uint8).reshape(-1, 8)
        ones = np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(words)).tobytes(), "big", signed=True))
    return pa.array(out, pa.int64())


def block_masks(distance: int, blocks: int | None = None) -> list[int]:
    """Masks (signed) of each choice of all but ``distance`` of some blocks (twice as many as may
    differ in bits, if not said): two fingerprints within the distance agree under one at least."""
    n = blocks or 2 * distance
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in choice) for choice in combinations(range(n), n - distance)]
    return [m - 2**64 if m >> 63 else m for m in masks]


def near_chunks(docs: DataFrame, key: str, text: str, distance: int = 3) -> DataFrame:
    """Pairs of distinct fingerprints within ``distance`` bits, by their smallest keys: a, b, bits.

    A fingerprint is cut into twice as many blocks as may differ in bits, so two that near agree
    in half of the blocks at least (pigeonhole): for each choice of half, those blocks together,
    about 32 bits, are the key that they meet by. Copies of a fingerprint count once, so a large
    group of copies costs one row.
    """
    f = docs.select(F.col(key), simhash64(F.col(text)).alias("fp")).groupBy("fp").agg(F.min(key).alias("k"))
    signed = F.array(*(F.lit(m).cast("long") for m in block_masks(distance)))
    b = f.select("fp", "k", F.posexplode(F.transform(signed, lambda m: F.col("fp").bitwiseAND(m))).alias("i", "v"))
    x, y = b.alias("x"), b.alias("y")
    j = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.k") < F.col("y.k")))
    bits = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    j = j.filter(bits <= distance)
    return j.groupBy(F.col("x.k").alias("a"), F.col("y.k").alias("b")).agg(F.min(bits).alias("bits"))


#: Undecided fingerprints up to this many (some 5 MB) are decided by one task.
LAST_ROWS = 20_000


def _keys(fp: int, masks: list[int]) -> list[tuple[int, int]]:
    return [(i, fp & m) for i, m in enumerate(masks)]


def _in_order(masks: list[int], distance: int):
    """Decides fingerprints (fp, k) in the order of k: kept unless within ``distance`` of a kept one."""

    def run(batches):
        kept: dict[tuple, list[int]] = {}
        for b in batches:
            out = []
            for fp in b.column(0).to_pylist():
                keys = _keys(fp, masks)
                out.append(all(((o ^ fp) & (2**64 - 1)).bit_count() > distance for key in keys for o in kept.get(key, ())))
                if out[-1]:
                    for key in keys:
                        kept.setdefault(key, []).append(fp)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], ["fp", "k", "stays"])

    return run


def kept_chunks(docs: DataFrame, key: str, text: str, distance: int = 3, last: int = LAST_ROWS) -> DataFrame:
    """(key, kept, first): each row is kept unless it lies within ``distance`` bits of a row kept
    before it in the order of ``key`` (an integer); ``first`` is the first row of its fingerprint.

    Of rows with one fingerprint only the first can stay, so copies count once. Fingerprints that
    could be near agree in two of ``distance + 2`` blocks, and each choice of two is a key. In a round, one that is the first undecided
    of all its keys has nothing before it that could strike it: it stays, and strikes those near it
    with which it shares a key. A key has at most one that stays in a round, so a round's work is in
    proportion to the undecided, however alike they are; no pairs are listed. When ``last`` or fewer
    are undecided, one task decides them in order, so long chains need no long row of rounds. Null
    keys come before all others, as one row; rows of one key are one, too; no rows give no rows.
    """
    from ..session import remove_path, scratch_path

    spark = docs.sparkSession

    def written(d, name):
        path = scratch_path(spark, name)
        d.write.parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    least = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    rows = written(docs.select(F.col(key).alias("key"), least.alias("k"), simhash64(F.col(text)).alias("fp")), "chunks")
    todo = written(rows.groupBy("fp").agg(F.min("k").alias("k")), "undecided")
    masks = block_masks(distance, distance + 2)
    keys = F.posexplode(F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.col("fp").bitwiseAND(m))).alias("i", "v")
    n, decided = todo.count(), []
    while n > last:
        heads = todo.select("fp", "k", keys).groupBy("i", "v").agg(F.min(F.struct("k", "fp")).alias("head"))
        free = heads.groupBy("head.fp", "head.k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(masks))
        free = written(free.select("fp", "k"), "free")  # first of all its keys: so its keys are those that it is first of
        rest = todo.join(free.select("fp"), "fp", "left_anti")
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("by"))) <= distance
        struck = rest.select("fp", "k", keys).join(free.select(F.col("fp").alias("by"), "fp").select("by", keys), ["i", "v"]).filter(near)
        struck = written(struck.select("fp", "k").distinct(), "struck")
        decided += [free.withColumn("stays", F.lit(True)), struck.withColumn("stays", F.lit(False))]
        before, todo = todo, written(rest.join(struck.select("fp"), "fp", "left_anti"), "undecided")
        remove_path(spark, before.inputFiles()[0].rsplit("/", 1)[0])
        n = todo.count()
    decided.append(todo.repartition(1).sortWithinPartitions("k").mapInArrow(_in_order(masks, distance), "fp long, k long, stays boolean"))
    all_ = decided[0]
    for d in decided[1:]:
        all_ = all_.unionByName(d)
    j = rows.join(all_.select("fp", F.col("k").alias("first"), "stays"), "fp")
    return j.select(F.col("key").alias(key), (F.col("stays") & (F.col("k") == F.col("first"))).alias("kept"), F.nullif("first", F.lit(-(2**63))).alias("first"))
