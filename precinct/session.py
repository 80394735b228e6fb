"""Session settings and the helpers that depend on the cluster.

``settle`` (small tables) and ``store`` (row-level tables) cut lineage through the shared
checkpoint folder, so that a lost executor costs a re-read and not a recomputation.  ``broadcast_if_small`` hints a
broadcast after counting the side, and leaves the join to AQE (sort-merge with skew splitting) when it is too large; other
hints in the package stand behind a ``limit``.
"""
from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes allowed on a hinted broadcast side: counted rows times a width that the caller states (a key and a few numbers by default).
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 160
TASK_ROWS, LEAST_ROWS = 50_000, 2_000  # rows of a task at most and at least, where a row costs far more than its bytes in a file

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Only the small-side switch made at run time; planning-time broadcasts keep
    # Spark's default bound.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "precinct", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the package's settings; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    merged = {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}
    for key, value in merged.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """Use the folder named by the cluster; make one only for local tests."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif re.fullmatch(r"local(\[[^]]*\])?", context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="precinct-checkpoint-"))
    else:
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and read it back from the shared checkpoint folder."""
    ensure_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def store(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a large table once, as Parquet in the shared checkpoint folder, and read it back.

    For row-level tables that several jobs read: unlike a checkpoint the copy is columnar
    and compressed, later reads take only the columns they need, and ``partition_by`` lets
    a reader of one split skip the files of the others.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    writer = df.write.mode("error")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    for paths in _SCOPES[-1:]:
        paths.append(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_path = path
    return stored


_SCOPES: list[list[str]] = []


@contextmanager
def scope():
    """Gather the paths of all tables stored within, so that they can be discarded together."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def discard(spark: SparkSession, *stored) -> None:
    """Delete stored tables (what ``store`` returned, or their paths) that nothing will read any more."""
    for table in stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks(df: DataFrame) -> int:
    """How many tasks the rows are worth: one for ``TASK_ROWS`` of them, and one a core.  Counting a stored table reads footers only."""
    rows = df.count()
    return max(1, -(-rows // TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)))


def dealt(df: DataFrame) -> DataFrame:
    """A stored table dealt out to as many tasks as its rows are worth, where its scan has fewer.

    Files are cut by their compressed bytes, so a task of a scan may get millions of narrow rows.
    """
    parts = tasks(df)
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= parts else df.repartition(parts)


def broadcast_if_small(table: DataFrame, row_bytes: int = ROW_BYTES, rows: int | None = None) -> DataFrame:
    """Hint a broadcast after counting a settled table; otherwise leave it to AQE."""
    most = BROADCAST_BYTES // row_bytes
    if (table.limit(most + 1).count() if rows is None else rows) <= most:
        return F.broadcast(table)
    return table
