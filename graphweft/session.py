"""Spark session defaults and lineage cutting.

Everything in the library runs on a SparkSession the caller owns. ``get_spark``
only builds one for scripts, tests and the bench; on a cluster pass your own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every operator relies on: UTC wall clock (all times in the data model are
# UTC), adaptive execution (runtime broadcast of small sides, partition coalescing,
# skew-join splitting of hub users), Arrow for the few pandas UDFs.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "graphweft", extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the library defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor, size it for the work
        builder = builder.config("spark.driver.memory", os.environ.get("GRAPHWEFT_DRIVER_MEMORY", "4g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The folder comes from ``spark.checkpoint.dir`` (or an already set context
    directory). Only a local-mode session without one gets a private temporary folder,
    as in tests; a cluster session without the setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="graphweft-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "graphweft-tables", name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    The result's plan is one scan: unlike a checkpoint it keeps neither the partitioning nor
    the ordering or statistics of the plan it came from, which grow from round to round where
    a state is joined with itself. A lost executor costs the reading of its splits again.
    ``release`` deletes the table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_table = path
    return out


def cut_parts(df: DataFrame, keys: Sequence[str], parts: int, rows: int) -> list[DataFrame]:
    """``cut_lineage`` in tables that share no ``keys``: ``parts`` of them, fewer where a table
    would have less than ``rows`` rows, one at least. ``release`` deletes each alone."""
    spark = df.sparkSession
    path = scratch_path(spark, f"cut-{uuid.uuid4().hex}")
    dealt = df.withColumn("cut_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    dealt.write.partitionBy("cut_part").parquet(path)
    counts = spark.read.schema(dealt.schema).parquet(path).groupBy("cut_part").count().collect()
    groups: list[list[str]] = []
    held = rows
    for part, count in sorted(counts):
        if held >= rows:
            groups.append([])
            held = 0
        groups[-1].append(f"{path}/cut_part={part}")
        held += count
    cuts = []
    for paths in groups or [[path]]:
        cuts.append(spark.read.schema(df.schema).parquet(*paths))
        cuts[-1].scratch_table = paths
    return cuts


def release(*frames: DataFrame | None) -> None:
    """Delete the tables behind results of ``cut_lineage`` and ``cut_parts``; other frames (and None)
    are left alone. For tables that a later one has superseded: nothing may read them after that."""
    for df in frames:
        table = getattr(df, "scratch_table", None)
        for path in [table] if isinstance(table, str) else table or []:
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
            df.scratch_table = None


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffle_partitions(spark: SparkSession, n: int):
    """The session's number of shuffle partitions set to ``n`` for the jobs run inside."""
    return _set(spark, {"spark.sql.shuffle.partitions": str(n)})


def spent_shuffles(spark: SparkSession):
    """For tables written inside: the shuffle files of a job are deleted once it has ended, not when
    the driver's memory is next cleared, so that steps of a query do not pile theirs up on disk."""
    return _set(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def text_batches(spark: SparkSession):
    """For the jobs run inside: Arrow batches of 4 MB instead of 10,000 rows or 64 MB.

    A batch of long texts is held by the executor as vectors and as a stream, outside its heap, and by
    the Python worker, which keeps for later batches what it once took."""
    return _set(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"})


#: rows that a task of an iterative stage holds at least, unless the session has fewer partitions
ROWS_PER_TASK = 100_000


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Partitions that ``rows`` fill with ``rows_per_task``, at least one, at most the session's."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task) or 1)


def rounds_on(spark: SparkSession, tasks: int):
    """For the jobs of many rounds: ``tasks`` shuffle partitions, joins by exchange, plans made once.

    A broadcast passes a table through the driver, so rounds whose joins turn into broadcasts send
    the driver their state again and again; only those asked for by ``F.broadcast`` are left.
    Adaptive execution starts a job for each exchange, which costs small rounds more than it saves."""
    return _set(spark, {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.enabled": "false",
                        "spark.sql.autoBroadcastJoinThreshold": "-1"})
