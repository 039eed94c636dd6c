"""Shared plumbing of the training-data operators: where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, a
    local session) a temporary folder is made and set for the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Paths handed out inside open ``scratch`` blocks.
_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under this application's own name."""
    path = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


@contextmanager
def scratch():
    """Collects the paths that are handed out inside, for ``remove`` once nothing reads them."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.pop()  # blocks nest


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application."""
    remove(spark, [f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"])


def path_of(df: DataFrame) -> str | None:
    """Where :func:`materialize` wrote ``df``."""
    return getattr(df, "_corpusloom_path", None)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at a table that
    outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`materialize` that nothing reads any more."""
    if path := path_of(df):
        remove(df.sparkSession, [path])


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Mark ``df`` for broadcast only when its counted rows are within ``limit``; beyond
    it the planner picks a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


#: Copies of one row that a task writes at most when counted rows are expanded again.
COPIES = 65_536


def expanded(counted: DataFrame, count: str, ordinal: str) -> DataFrame:
    """Every row of ``counted`` as often as ``count`` says, numbered from 0 in ``ordinal``.

    ``counted`` must be cheap to read twice (a written table). Rows with more than ``COPIES``
    copies are cut into chunks that are spread over all tasks.
    """
    last = F.col(count) - 1
    cold = counted.filter(F.col(count) <= COPIES).withColumn(ordinal, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    hot = counted.filter(F.col(count) > COPIES)
    if not hot.limit(1).count():
        return cold
    tasks = max(counted.sparkSession.sparkContext.defaultParallelism, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = hot.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / COPIES)))).repartition(tasks, "__chunk")
    inside = F.sequence(F.col("__chunk") * COPIES, F.least(last, (F.col("__chunk") + 1) * COPIES - 1))
    return cold.union(chunks.withColumn(ordinal, F.explode(inside)).drop("__chunk"))


def free_prefix(columns: list[str]) -> str:
    """Underscores that no column's name begins with (two at least), for names of one's own."""
    p = "__"
    while any(c.startswith(p) for c in columns):
        p += "_"
    return p


def identified(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that tells its rows apart, repeated rows too: struct (file, at), the
    Parquet file and the place in it, so it stays the same however often and on however many
    cores the rows are read. Rows that do not come straight from Parquet files are written first."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    if "parquet" not in plan.simpleString(25).lower() or plan.nodeName() != "LogicalRelation":
        df = materialize(df, "identified")
    place = df.metadataColumn("_metadata")  # though a column may have that name
    return df.select("*", F.struct(place["file_path"].alias("file"), place["row_index"].alias("at")).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
