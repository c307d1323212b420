"""Function-level checks: text embedders, projections, readers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.operators import features as ft
from graphweft.sources import files, sinks


def test_model_embed_plugs_a_batch_model(spark):
    df = spark.createDataFrame([("a", "hello world"), ("b", None)], "k string, t string")

    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])
    out = {r.k: r.vec for r in text.model_embed(df, "t", factory, dim=2).collect()}
    assert out == {"a": [11.0, 1.0], "b": [0.0, 1.0]}


def test_hashing_embed_is_a_mean_over_tokens(spark):
    df = spark.createDataFrame([("a", "x x"), ("b", ""), ("c", None)], "k string, t string")
    out = {r.k: r.vec for r in text.hashing_embed(df, "k", "t", dim=8).collect()}
    assert sum(abs(v) for v in out["a"]) == pytest.approx(1.0)
    assert out["b"] == [0.0] * 8 and out["c"] == [0.0] * 8


def test_projection_matches_numpy(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    got = df.select(ft.project(F.col("v"), "p", 3, 2, activation="none").alias("y")).first().y
    w, b = ft.projection_weights("p", 3, 2)
    assert got == pytest.approx(list(w @ np.array([1.0, 2.0, 3.0]) + b))


def test_sharded_reader_skips_missing_shards(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.createDataFrame([("t1", 1, "2020-01-01 00:00:00", "a")],
                                 "id string, author_id bigint, created_at string, text string")
    sinks.write_json_array(rows, f"{base}/tweet_2.json")
    df = files.read_sharded_json_array(spark, base, "tweet_{i}.json", shards=4)
    assert [r.id for r in df.collect()] == ["t1"]
    empty = files.read_sharded_json_array(spark, base + "/none", "tweet_{i}.json", shards=2)
    assert empty.count() == 0 and "shard" not in files.TWEET_SCHEMA.fieldNames()


def test_hashing_embed_feeds_a_projection(spark):
    """The embedder's result goes into a Python projection; I2 failed on it at run time."""
    df = spark.createDataFrame([("a", "x y x"), ("b", None)], "id string, t string")
    desc = text.hashing_embed(df, "id", "t", dim=8)
    one = df.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    fused = ft.static_fuse(desc, one.withColumnRenamed("v", "numeric"), one.withColumnRenamed("v", "categorical"),
                           tweet=one.withColumnRenamed("v", "vec"), dim=8)
    assert sorted((r.id, len(r.vec)) for r in fused.collect()) == [("a", 8), ("b", 8)]
