"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits both lie within half the radius of some value in
between. So each distinct fingerprint emits every variant within half the radius, variants
are shuffled, and fingerprints that emitted the same variant are candidates. All that share
a variant lie within the radius of one another, so linking each to the smallest of them
loses no link; the links are deduplicated and verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, small
from .exact_dedup import normalised
from .graph import components

SEED = 42
#: Distinct fingerprints per task that emit variants (some 140 MB of them).
SPREAD = 131_072
#: Documents of one fingerprint beyond which they take a second key in the last join, and so on up to MOST_SALTS.
HOT, MOST_SALTS = 200_000, 999
#: Hot fingerprints up to this many are broadcast.
HOT_ROWS = 1_000_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text: a bit is 1 if set in over half the hashes of
    its word shingles (repeats count; fewer words: the whole sequence; none: zero)."""
    words = normalised(text).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest, ones, total, held = xxhash.xxh64_digest, np.zeros(64, np.int64), 0, []

    def add(held):
        bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8), axis=1)
        return bits.sum(0, dtype=np.int64)

    for i, g in enumerate(grams, 1):
        held.append(digest(g, SEED))
        if len(held) == 65_536:  # very long texts add up block by block
            ones += add(held)
            total += len(held)
            held = []
    if held:
        ones += add(held)
        total += len(held)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(shingle: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], schema=schema)

    return run


def _masks(half: int) -> list[int]:
    out = [0]
    for k in range(1, half + 1):
        for bits in combinations(range(64), k):
            m = sum(1 << b for b in bits)
            out.append(m - 2**64 if m >= 2**63 else m)
    return out


def links(fps: DataFrame, radius: int = 2, rows: int | None = None) -> DataFrame:
    """(a, b) links that connect all distinct ``fp`` within ``radius`` bits; an odd radius has no
    half for all that share a variant to lie within it, so it raises.

    ``rows`` (counted if None) sets how many tasks emit variants. A variant's group is collected: it
    holds at most as many fingerprints as a ball of half the radius (65 at radius 2), whatever the
    data. Its members are linked to the smallest of them.
    """
    if radius < 0 or radius % 2:
        raise ValueError(f"radius must be even, not {radius}")
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, (fps.count() if rows is None else rows) // SPREAD)
    fps = fps.repartition(tasks, "fp")
    masks = F.array(*(F.lit(m).cast("long") for m in _masks(radius // 2)))
    variants = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    groups = variants.groupBy("variant").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    star = groups.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a <> b").distinct()
    return star.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", shingle=3, radius=2) -> DataFrame:
    """One row per document: doc_id, fp (long, the fingerprint's bits), fingerprint (16 hex
    digits), component_id (smallest doc_id that links of up to ``radius`` bits reach).

    Null texts and texts without words have fingerprint zero and link like any other. Equal
    fingerprints are one node, so groups of copies of any size cost one node; repeated rows
    share a component, null doc_ids are ignored when the smallest is chosen. Other columns
    are ignored, no rows give no rows.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    prints = materialize(src.mapInArrow(_fingerprints(shingle, to_arrow_schema(fields)), fields), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = materialize(components(links(nodes.select("fp"), radius, nodes.count())), "simhash-roots")
    # components of fingerprints, then the smallest document of each
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = member.join(lowest, "root").select("fp", "component_id", "n")
    hot = nodes.filter(F.col("n") >= HOT)
    if n_hot := hot.count():  # at most one for each HOT documents
        # a fingerprint of very many documents (empty texts, say) is spread over keys of its own, by rows, not by ids
        last = F.least(F.lit(MOST_SALTS), F.floor(F.col("n") / HOT)).cast("long")
        hot = small(hot.select("fp", (last + 1).alias("salts")), n_hot, HOT_ROWS)
        named = named.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        prints = prints.withColumn("place", F.monotonically_increasing_id()).join(hot, "fp", "left")
        prints = prints.withColumn("salt", F.pmod("place", F.coalesce("salts", F.lit(1))))
        out = prints.join(named.select("fp", "salt", "component_id"), ["fp", "salt"])
    else:
        out = prints.join(named.select("fp", "component_id"), "fp")
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
