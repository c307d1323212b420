"""Writers and stage storage.

Every output is a directory written by the executors (no driver-side file handling). Stage
outputs carry Spark's ``_SUCCESS`` marker; a stage is reused only if the marker exists, so a
job killed half-way is rebuilt, never half-read.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.sources.files import path_exists


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header (sample tables: users, edges, entity ids)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per line, numbers kept numeric (quirk Q19)."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write each partition as one JSON-array file (the reference's input layout), a record on
    a line. Rows stream through: no task holds more than a batch of them."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            rows = batch.column("j").to_pylist()
            marked = [("[" if first and k == 0 else ",") + r for k, r in enumerate(rows)]
            first = first and not rows
            yield pa.RecordBatch.from_arrays([pa.array(marked, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], ["value"])

    records = df.select(F.to_json(F.struct(*df.columns)).alias("j"))
    records.mapInArrow(lines, "value string").write.mode(mode).text(path)


def create_table(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Create a table from ``df`` unless it exists, or replace it (the reference's
    ``CREATE TABLE IF NOT EXISTS`` and ``CREATE OR REPLACE TABLE``); returns what is stored."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def create_if_absent(df: DataFrame, path: str) -> DataFrame:
    return create_table(df, path)


def create_indexed_table(df: DataFrame, name: str, path: str, key: str, buckets: int, overwrite: bool = False) -> DataFrame:
    """The same as a catalogue table with an index on ``key``: rows are hashed into
    ``buckets`` by the key and sorted by it within each, so that lookups read one bucket, and
    joins and aggregates on the key need no shuffle of the table."""
    (df.repartition(buckets, key).write.mode("overwrite" if overwrite else "ignore").option("path", path)
     .bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name))
    return df.sparkSession.table(name)


def write_snapshot_store(snap, path: str, mode: str = "overwrite") -> None:
    """The interval-coded snapshot tables, each sorted by ``first_snapshot`` so that
    Parquet row-group statistics prune ``first_snapshot <= i`` reads."""
    snap.users.sortWithinPartitions("first_snapshot").write.mode(mode).parquet(f"{path}/users")
    snap.tweets.sortWithinPartitions("first_snapshot").write.mode(mode).parquet(f"{path}/tweets")
    snap.edges.sortWithinPartitions("first_snapshot").write.mode(mode).parquet(f"{path}/edges")
    spark = snap.users.sparkSession
    spark.range(1).select(F.timestamp_micros(F.lit(snap.grid.start_us).cast("bigint")).alias("start"),
                          F.lit(snap.grid.count).cast("bigint").alias("count")) \
        .write.mode(mode).parquet(f"{path}/grid")


def read_snapshot_store(spark: SparkSession, path: str):
    from graphweft.operators.temporal import Snapshots, WeeklyGrid
    g = spark.read.parquet(f"{path}/grid").select(F.unix_micros("start").alias("start_us"), "count").first()
    return Snapshots(WeeklyGrid(g["start_us"], int(g["count"])), spark.read.parquet(f"{path}/users"),
                     spark.read.parquet(f"{path}/tweets"), spark.read.parquet(f"{path}/edges"))


def write_feature_store(df: DataFrame, path: str, key: str = "id", mode: str = "overwrite") -> None:
    """Id -> record store, range-partitioned and sorted by id so point and range
    lookups prune files and row groups."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def lookup(spark: SparkSession, path: str, ids: DataFrame, key: str = "id") -> DataFrame:
    return spark.read.parquet(path).join(ids.select(key).distinct(), key, "left_semi")


def append_summary(df: DataFrame, path: str) -> None:
    """Append a run summary row (one-row DataFrame) to a table."""
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def append_run_log(spark: SparkSession, path: str, version_name: str, config: dict) -> None:
    """Append {version_name, timestamp, config} to the run log — an append, never a
    read-modify-write of one file, so a corrupt or concurrent entry cannot lose others."""
    flat = {k: json.dumps(v) if not isinstance(v, str) else v for k, v in config.items()}
    row = [(version_name, dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S"), flat)]
    spark.createDataFrame(row, RUN_LOG).coalesce(1).write.mode("append").json(path)


#: an entry of the run log
RUN_LOG = "version_name string, timestamp string, config map<string,string>"


def read_run_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The entries of a run log, and the texts of those that are corrupt (``entry``), which
    do not keep the others from being read."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    entry = F.from_json("value", RUN_LOG + ", _corrupt_record string", {"mode": "PERMISSIVE"})
    parsed = rows.select("value", entry.alias("e"))
    corrupt = F.col("e._corrupt_record").isNotNull() | F.col("e.version_name").isNull()
    return (parsed.where(~corrupt).select("e.version_name", "e.timestamp", "e.config"),
            parsed.where(corrupt).select(F.col("value").alias("entry")))


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """Compute a stage once; later calls read the stored result if it completed."""
    if not rebuild and path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def id_fingerprint(df: DataFrame, key: str = "id") -> tuple:
    """Order-free fingerprint of a key set: (count, xor of hashes, sum of hashes mod p)."""
    h = F.xxhash64(F.col(key))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
               F.sum(F.pmod(h, F.lit(2147483647))).alias("s")).first()
    return r["n"], r["x"], r["s"]


def validated_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], ids: DataFrame,
                    key: str = "id") -> DataFrame:
    """Reuse a cached stage only if its ids equal the table's ids, else rebuild."""
    cached = stage(spark, path, build)
    if id_fingerprint(cached, key) != id_fingerprint(ids, key):
        cached = stage(spark, path, build, rebuild=True)
    return cached


def write_partitioned_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-snapshot vector output, one directory per snapshot index (change rows only)."""
    df.write.mode(mode).partitionBy("snapshot_idx").parquet(path)


def write_scores(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Inference results: id, label, prediction, probability, logits."""
    df.write.mode(mode).parquet(path)
