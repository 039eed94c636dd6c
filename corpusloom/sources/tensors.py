"""Row-wise int8 tensors on disk: a sink in blocks of rows and a reader that plans by row range.

A row is its scale (little-endian float32), its int8 values and one zero byte, so all rows have one
size. Rows are numbered in the order of a key; a block of rows is a folder of its own, named by its
number, and a header beside them says how many rows, columns and rows of a block there are. A range
of rows is read from the blocks that it reaches into: Spark lists and opens no other.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.retrieval import quantise_row
from ..operators.sequence import numbered
from .binary import _write_raw
from .commit import get, put

#: Rows of a block.
BLOCK_ROWS = 65_536
HEADER = "_tensor.json"


def _packed(scales: pa.Array, values: pa.Array) -> pa.Array:
    """Bytes of each row, but for the zero byte behind it."""
    sizes = values.value_lengths().to_numpy(zero_copy_only=False)
    scale = scales.to_numpy(zero_copy_only=False).astype("<f4")
    q = values.flatten().to_numpy(zero_copy_only=False).astype(np.int8)
    ends = np.cumsum(sizes)
    return pa.array([s.tobytes() + q[e - n : e].tobytes() for s, n, e in zip(scale, sizes.astype(int), ends.astype(int))], pa.binary())


def write_int8(df: DataFrame, path: str, key: str, vector: str, block_rows: int = BLOCK_ROWS) -> None:
    """Quantise the vectors of ``df``, in the order of ``key``, and write them as a tensor.

    Vectors must be of one length; null vectors are no rows. The header comes last and as a whole,
    so a tensor without one is not finished.
    """
    spark = df.sparkSession
    d = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    rows, least, most = d.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components are no tensor")
    d = numbered(d, [], ["key"], "n").select((F.col("n") - 1).alias("row"), quantise_row(F.col("v")).alias("q"))
    raw = F.arrow_udf(_packed, T.BinaryType())(F.col("q.scale"), F.col("q.q")).cast("string").alias("value")
    block = F.floor(F.col("row") / block_rows).cast("long").alias("block")
    d = d.select("row", block, raw).repartition("block").sortWithinPartitions("block", "row").select("block", "value")
    _write_raw(d, path, bytes(1), 0, ["block"])
    put(spark, f"{path}/{HEADER}", json.dumps({"rows": rows, "columns": most or 0, "block_rows": block_rows}).encode())


def read_int8(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(row, scale, q) of the rows from ``first`` up to before ``last`` (all, if None)."""
    header = get(spark, f"{path}/{HEADER}")
    if header is None:
        raise ValueError(f"{path} holds no finished tensor")
    h = json.loads(header)
    size, block_rows, columns = 4 + h["columns"] + 1, h["block_rows"], h["columns"]
    last = h["rows"] if last is None else min(last, h["rows"])
    schema = "row long, scale float, q array<byte>"
    if first >= last:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            for block, content in zip(b.column(0).to_pylist(), b.column(1)):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                if len(raw) % size:
                    raise ValueError(f"block {block}: {len(raw)} bytes are no rows of {size}")
                rows = raw.reshape(-1, size)
                at = block * block_rows
                lo, hi = max(first - at, 0), min(last - at, len(rows))
                rows = rows[lo:hi]
                scale = np.ascontiguousarray(rows[:, :4]).view("<f4").ravel()
                q = np.ascontiguousarray(rows[:, 4 : 4 + columns]).view(np.int8).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * columns), pa.array(q))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at + lo, at + lo + len(rows))), pa.array(scale), lists], ["row", "scale", "q"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.filter(F.col("block").between(first // block_rows, (last - 1) // block_rows))
    return files.select(F.col("block").cast("long"), "content").mapInArrow(run, schema)
