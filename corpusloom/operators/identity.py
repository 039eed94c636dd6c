"""Identity of code and data: what every executor runs, and what was loaded, against a lock."""

from __future__ import annotations

import hashlib
import importlib.util
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def package_root(package: str) -> str:
    """Folder that a package is imported from, here."""
    return next(iter(importlib.util.find_spec(package).submodule_search_locations))


def code_digests(root: str) -> dict[str, str]:
    """SHA-256 of each source file below a folder, by its path there."""
    out = {}
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                path = os.path.join(folder, f)
                with open(path, "rb") as source:
                    out[os.path.relpath(path, root).replace(os.sep, "/")] = hashlib.sha256(source.read()).hexdigest()
    return out


def attest(spark: SparkSession, package: str, lock: dict[str, str], tasks: int | None = None, root: Callable[[int], str] | None = None) -> DataFrame:
    """(task, host, path, fault): files of a package that are changed, missing or extra against
    ``lock`` (see :func:`code_digests`) where a task runs; no rows when all run the same code.

    A barrier stage of as many tasks as there are cores runs on all of them at once, so no executor
    is passed over. ``root`` tells a task (by its number) where the package lies, if not where it is
    imported from.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism

    def run(batches):
        from pyspark import BarrierTaskContext

        c = BarrierTaskContext.get()
        for _ in batches:
            pass
        at = c.partitionId()
        host = c.getTaskInfos()[at].address
        found = code_digests(root(at) if root else package_root(package))
        faults = [(p, "missing") for p in lock if p not in found] + [(p, "extra") for p in found if p not in lock]
        faults += [(p, "changed") for p in found if lock.get(p, found[p]) != found[p]]
        c.barrier()  # every task has looked before any is done
        yield pa.RecordBatch.from_arrays([pa.array([at] * len(faults), pa.int32()), pa.array([host] * len(faults), pa.string()), *(pa.array([f[i] for f in sorted(faults)], pa.string()) for i in (0, 1))], ["task", "host", "path", "fault"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "task int, host string, path string, fault string", barrier=True)


def group_digests(df: DataFrame, group: str, *columns: Column) -> DataFrame:
    """(group, rows, digest): how many rows a group has and the sum of the first 8 hex digits of
    their MD5, the same in whatever order the rows lie; nulls and texts are told apart."""
    parts = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns))
    part = F.conv(F.substring(F.md5(parts), 1, 8), 16, 10).cast("long")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.sum(part).alias("digest"))


def verified_load(df: DataFrame, group: str, lock: DataFrame, *columns: Column) -> DataFrame:
    """Groups of ``df`` with rows, digest and whether they are as in ``lock`` (group, rows, digest).
    A group that the lock does not have, or that is gone, is not verified."""
    found = group_digests(df, group, *columns).alias("f")
    held = lock.alias("l")
    j = found.join(held, F.col(f"f.{group}").eqNullSafe(F.col(f"l.{group}")), "full")
    same = F.coalesce((F.col("f.rows") == F.col("l.rows")) & (F.col("f.digest") == F.col("l.digest")), F.lit(False))
    return j.select(F.coalesce(f"f.{group}", f"l.{group}").alias(group), F.col("f.rows").alias("rows"), F.col("f.digest").alias("digest"), same.alias("verified"))
