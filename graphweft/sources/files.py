"""File readers (A1-A9): JSON arrays, JSON lines, CSV, sharded inputs, ordered and batched scans.

Explicit schemas by default (no inference pass over the data); inference is opt-in for the
load step that mirrors the reference's ``read_json_auto(union_by_name, sample_size=-1)``.
Paths may be local or any Hadoop file system; existence checks go through the session's
Hadoop configuration, never the local disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = T.StructType([
    T.StructField("followers_count", T.LongType()),
    T.StructField("following_count", T.LongType()),
    T.StructField("tweet_count", T.LongType()),
])

USER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("protected", T.BooleanType()),
    T.StructField("verified", T.BooleanType()),
    T.StructField("profile_image_url", T.StringType()),
    T.StructField("public_metrics", METRICS),
])

TWEET_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author_id", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("text", T.StringType()),
])

TWEET_META_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author_id", T.LongType()),
    T.StructField("created_at", T.StringType()),
])

EDGE_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("relation", T.StringType()),
    T.StructField("target_id", T.StringType()),
])

LABEL_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("label", T.StringType()),
])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


#: column with the name of the file that a record of a JSON array came from
FILE = "_file"


def read_json_array(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = USER_SCHEMA) -> DataFrame:
    """A1/A2: files that each hold one JSON array of records.

    Where each record stands on a line of its own (as ``sinks.write_json_array`` writes them; a
    line break inside a JSON string is escaped, so a line is a whole record), files are read in
    splits of ``spark.sql.files.maxPartitionBytes``, each by a task of its own. Whether that is
    so is checked on all lines; files of any other layout are read whole, a task for each file.
    """
    paths = paths if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).select(F.trim(F.regexp_replace("value", r"[\r\t]", " ")).alias("line"), F.input_file_name().alias("_file"))
    # brackets of the array and commas between records
    item = F.regexp_replace(F.regexp_replace("line", r"^[\[,]\s*", ""), r"\s*[,\]]$", "")
    items = lines.select(F.trim(item).alias("item"), "_file").where("item <> ''")
    # exactly one record: neither a part of one nor several
    held = F.size(F.from_json(F.concat(F.lit("["), "item", F.lit("]")), "array<struct<_none: string>>"))
    whole = F.col("item").startswith("{") & F.col("item").endswith("}") & F.coalesce(held == 1, F.lit(False))
    if items.where(~whole).isEmpty():
        return items.select(F.from_json("item", schema).alias("r"), "_file").select("r.*", F.col("_file").alias(FILE))
    return spark.read.schema(schema).option("multiLine", True).json(paths).withColumn(FILE, F.input_file_name())


def read_sharded_json_array(spark: SparkSession, base: str, pattern: str = "tweet_{i}.json",
                            shards: int = 9, schema: T.StructType = TWEET_SCHEMA) -> DataFrame:
    """A2: the shards that exist among ``pattern.format(i)`` for i < shards; missing ones
    are skipped. ``shard`` column = file name."""
    paths = [f"{base.rstrip('/')}/{pattern.format(i=i)}" for i in range(shards)]
    present = [p for p in paths if path_exists(spark, p)]
    if not present:
        return spark.createDataFrame([], T.StructType(schema.fields + [T.StructField("shard", T.StringType())]))
    return (read_json_array(spark, present, schema)
            .withColumn("shard", F.element_at(F.split(F.col(FILE), "/"), -1)).drop(FILE))


def read_user_lines(spark: SparkSession, path: str, schema: T.StructType = USER_SCHEMA) -> DataFrame:
    """A3: JSON lines of users: id, created_at (strict parse, G2), features (whole record)."""
    df = spark.read.schema(schema).json(path)
    return df.select("id", F.to_timestamp("created_at").alias("created_at"),
                     F.struct(*[F.col(c) for c in df.columns]).alias("features"))


def read_tweet_meta(spark: SparkSession, path: str) -> DataFrame:
    """A4: id, author_id ('u' || numeric author), created_at — only three fields are read."""
    df = spark.read.schema(TWEET_META_SCHEMA).json(path)
    return df.select("id", F.concat(F.lit("u"), F.col("author_id").cast("string")).alias("author_id"),
                     F.to_timestamp("created_at").alias("created_at"))


def read_json_inferred(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """A5: full-scan schema inference (samplingRatio 1.0); files with different fields are
    unioned by name (missing fields are null)."""
    return (spark.read.option("samplingRatio", 1.0).option("multiLine", multi_line)
            .json(paths if isinstance(paths, str) else list(paths)))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; explicit schema, or inference when none is given. Large
    files are split by ``spark.sql.files.maxPartitionBytes`` (the chunked scan)."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path if isinstance(path, str) else list(path))


def ordered(df: DataFrame, *cols: str) -> DataFrame:
    """Full scan in key order (a range-partitioned sort, not a single task)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def batched_apply(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                  batch_rows: int | None = None) -> DataFrame:
    """Feed a batch function Arrow batches of rows (replaces LIMIT/OFFSET paging: one
    scan, no re-sort per page), of ``batch_rows`` rows at most if that is given."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            step = batch_rows or max(len(pdf), 1)
            for lo in range(0, len(pdf), step):
                yield fn(pdf.iloc[lo:lo + step])
    return df.mapInPandas(run, schema)
