"""Files that appear whole or not at all, and logs with one writer at a time.

Everything goes through Hadoop's file systems, so a path may lie in any store that the session
can open. A file is written under a temporary name beside its own, synced and renamed. A log is a
row of numbered segments; what number comes next is decided by who creates the file of that number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _open(spark: SparkSession, path: str):
    """(file system, qualified path)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def put(spark: SparkSession, path: str, data: bytes, replace: bool = True) -> None:
    """Write a small file: readers see the old one or the whole new one, never a part.

    Without ``replace`` an existing file raises ``FileExistsError`` and stays. The rename is as
    atomic as the store's own (it is on HDFS and on local disks).
    """
    jvm = spark._jvm
    fs, final = _open(spark, path)
    temp = jvm.org.apache.hadoop.fs.Path(final.getParent(), f"._{final.getName()}.{uuid.uuid4().hex}")
    try:
        out = fs.create(temp, False)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()
        if not replace and final.toUri().getScheme() == "file":  # a local rename would replace; a link never does
            local = jvm.java.nio.file.Paths.get
            try:
                jvm.java.nio.file.Files.createLink(local(final.toUri()), local(temp.toUri()))
            except Exception as e:
                raise FileExistsError(path) if fs.exists(final) else e
            return
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
        try:
            context.rename(temp, final, how)
        except Exception as e:
            raise FileExistsError(path) if not replace and fs.exists(final) else e
    finally:
        fs.delete(temp, False)


def get(spark: SparkSession, path: str) -> bytes | None:
    """A small file's bytes, None where there is none."""
    fs, p = _open(spark, path)
    if not fs.exists(p):
        return None
    with_size = fs.getFileStatus(p).getLen()
    source = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(source)) if with_size else b""
    finally:
        source.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, in order; none where there is no folder."""
    fs, p = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_report(spark: SparkSession, path: str, report) -> None:
    """A report (anything that JSON can say) as one indented file with sorted keys."""
    put(spark, path, (json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())


class Fenced(RuntimeError):
    """Another writer has taken the log over."""


class EventLog:
    """A durable, append-only log of batches of events.

    ``open`` takes the log over: it claims the next epoch. A batch's rows are written as Parquet
    first; then its segment, a small file with the next number, is created, and that is the commit:
    of two writers one creates it, and the other looks again. A writer that finds a segment of a
    later epoch before its own is fenced and raises; so epochs never fall along the log. A batch has
    a name, and one that the log holds is not appended again, so a replayed batch does nothing.
    Rows of uncommitted batches are never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.epoch = spark, path.rstrip("/"), 0

    def open(self) -> "EventLog":
        while True:
            epoch = 1 + max((int(n) for n in names(self.spark, f"{self.path}/epochs") if n.isdigit()), default=0)
            try:
                put(self.spark, f"{self.path}/epochs/{epoch:012d}", b"", replace=False)
                self.epoch = epoch
                return self
            except FileExistsError:
                continue

    def segments(self, first: int = 0) -> list[dict]:
        """Committed segments from a number on, in order."""
        there = [n for n in names(self.spark, f"{self.path}/segments") if n.isdigit() and int(n) >= first]
        return [json.loads(get(self.spark, f"{self.path}/segments/{n}")) for n in there]

    def append(self, events: DataFrame, batch: str) -> bool:
        """Append a batch; whether it was new to the log."""
        if not self.epoch:
            raise RuntimeError("open the log first")
        known, where = self.segments(), None
        while True:
            if any(s["batch"] == batch for s in known):
                return False
            if any(s["epoch"] > self.epoch for s in known):
                raise Fenced(f"epoch {self.epoch} of {self.path}")
            if where is None:
                where = f"data/{uuid.uuid4().hex}"
                events.write.parquet(f"{self.path}/{where}")
            segment = {"epoch": self.epoch, "batch": batch, "data": where}
            try:
                put(self.spark, f"{self.path}/segments/{len(known):012d}", json.dumps(segment).encode(), replace=False)
                return True
            except FileExistsError:
                known += self.segments(len(known))

    def replay(self, schema) -> DataFrame:
        """All events of committed batches."""
        paths = [f"{self.path}/{s['data']}" for s in self.segments()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
