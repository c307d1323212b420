"""Global orderings as dense indices (E6, E8) without a single-partition window.

A ``row_number()`` over an unpartitioned window moves every row into one task. Instead the
rows are range-partitioned on the sort key, sorted inside each partition, and each row's
index is ``offset(partition) + position inside the partition``. The offsets come from one
small aggregate (one row per partition), the only thing that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.session import cut_lineage


def dense_index(df: DataFrame, order: Sequence[Column | str], out: str = "idx",
                base: int = 0, num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = position of the row in the total order ``order`` (+ ``base``).

    ``order`` must be a total order (end it with a unique key) for a deterministic result.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    # Materialise once (reliable checkpoint): the offsets and the rows must come from the
    # same partitioning, also after a recomputation.
    ranged = cut_lineage(ranged)
    counts = {r["_pid"]: r["c"] for r in ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("c")).collect()}
    offsets, acc = [], 0
    for pid in range(max(counts, default=-1) + 1):
        offsets.append(F.lit(acc).cast("bigint"))
        acc += counts.get(pid, 0)
    off = F.array(*offsets)[F.col("_pid")] if offsets else F.lit(0)  # one constant array
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (ranged.withColumn(out, (off + local + F.lit(base)).cast("bigint"))
            .drop("_pid", "_mid"))


def id_index(df: DataFrame, key: str = "id", out: str = "idx") -> DataFrame:
    """0-based index in ``key`` order (dictionary encoding of node ids)."""
    return dense_index(df.select(key).distinct(), [key], out)


def rank_desc(df: DataFrame, value: str, key: str = "id", out: str = "rank",
              digits: int | None = None) -> DataFrame:
    """1-based rank by ``value`` descending; ties broken by ``key``."""
    v = F.round(F.col(value), digits) if digits is not None else F.col(value)
    return dense_index(df, [v.desc(), F.col(key).asc()], out, base=1)
