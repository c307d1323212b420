"""Registered queries: readers and writers, as round trips through the shared scratch folder
(A1-A9, A12-A22). Each query writes the driver-derived tables in the reference's file
formats below ``spark.checkpoint.dir`` and reads them back with the library's readers."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from graphweft.operators import features as ft
from graphweft.operators import temporal as tp
from graphweft.plans.common import duck_ts, ts_str
from graphweft.plans.oracle_views import with_views
from graphweft.plans.q_features import _NUM_CTES
from graphweft.plans.q_graph import long_rounded
from graphweft.plans.q_ml import classifier_scores
from graphweft.plans.q_temporal import COUNTS_SQL, GRID_CTES
from graphweft.session import scratch_path, spent_shuffles
from graphweft.sources import driver_tables as dt
from graphweft.sources import files, sinks

QUERIES = {}
ORACLES = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _user_json(spark, sf):
    recs = dt.user_records(spark, sf)
    return recs.select("id", ts_str("created_at").alias("created_at"), "name", "description", "protected",
                       "verified", "profile_image_url", "public_metrics")


@register("a1_users_json_array", with_views(
    f"""SELECT id, {duck_ts('created_at')} AS created_at, followers_count, following_count
        FROM ax_records"""))
def a1(spark, sf):
    p = _scratch(spark, "users-json-array")
    sinks.write_json_array(_user_json(spark, sf), p)
    df = files.read_json_array(spark, p)
    return df.select("id", "created_at", F.col("public_metrics.followers_count").alias("followers_count"),
                     F.col("public_metrics.following_count").alias("following_count"))


@register("a2_sharded_tweets_skip_missing", with_views(
    f"SELECT id, author_id, {duck_ts('created_at')} AS created_at, text FROM ax_tweets"))
def a2(spark, sf):
    base = _scratch(spark, "tweet-shards")
    t = dt.tweets(spark, sf).select("id", "author_id", ts_str("created_at").alias("created_at"), "text")
    # shards 0, 1, 3 exist; shard 2 is missing and must be skipped
    for i, part in enumerate([0, 1, 3]):
        sinks.write_json_array(t.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i), f"{base}/tweet_{part}.json")
    df = files.read_sharded_json_array(spark, base, "tweet_{i}.json", shards=9)
    return df.select("id", "author_id", "created_at", "text")


@register("a3_a13_user_lines_roundtrip", with_views(
    f"""SELECT id, {duck_ts('created_at')} AS created_at, name, tweet_count FROM ax_records"""))
def a3(spark, sf):
    p = _scratch(spark, "users-jsonl")
    sinks.write_json_lines(_user_json(spark, sf), p)
    df = files.read_user_lines(spark, p)
    return df.select("id", ts_str("created_at").alias("created_at"), F.col("features.name").alias("name"),
                     F.col("features.public_metrics.tweet_count").alias("tweet_count"))


@register("a4_tweet_meta_lines", with_views(
    f"SELECT id, 'u' || author_id AS author_id, {duck_ts('created_at')} AS created_at FROM ax_tweets"))
def a4(spark, sf):
    p = _scratch(spark, "tweets-jsonl")
    t = dt.tweets(spark, sf).select("id", "author_id", ts_str("created_at").alias("created_at"), "text")
    sinks.write_json_lines(t, p)
    df = files.read_tweet_meta(spark, p)
    return df.select("id", "author_id", ts_str("created_at").alias("created_at"))


@register("a5_inferred_union_by_name", with_views(
    """SELECT id, name, NULL::BIGINT AS tweet_count, label FROM ax_users WHERE label = 'human'
       UNION ALL SELECT id, NULL, tweet_count, label FROM ax_users WHERE label = 'bot'"""))
def a5(spark, sf):
    base = _scratch(spark, "inferred")
    u = dt.users(spark, sf)
    sinks.write_json_lines(u.where(F.col("label") == "human").select("id", "name", "label"), f"{base}/a")
    sinks.write_json_lines(u.where(F.col("label") == "bot").select("id", "tweet_count", "label"), f"{base}/b")
    df = files.read_json_inferred(spark, [f"{base}/a", f"{base}/b"])
    return df.select("id", "name", "tweet_count", "label")


@register("a6_a12_edges_csv_roundtrip", with_views("SELECT source_id, relation, target_id FROM ax_edges"))
def a6(spark, sf):
    p = _scratch(spark, "edges-csv")
    sinks.write_csv(dt.edges(spark, sf), p)
    return files.read_csv(spark, p, files.EDGE_SCHEMA)


@register("a8_ordered_user_scan", with_views("SELECT id, name FROM ax_users"))
def a8(spark, sf):
    return files.ordered(dt.users(spark, sf).select("id", "name"), "id")


@register("a9_batched_text_lengths", with_views(
    "SELECT id, CAST(length(text) AS BIGINT) AS n_chars FROM ax_tweets WHERE text IS NOT NULL"))
def a9(spark, sf):
    t = dt.tweets(spark, sf).where(F.col("text").isNotNull()).select("id", "text")

    def lengths(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": pdf["id"], "n_chars": pdf["text"].str.len().astype("int64")})
    return files.batched_apply(t, lengths, "id string, n_chars bigint", batch_rows=10_000)


@register("a14_create_if_absent", with_views("SELECT id, label FROM ax_users"))
def a14(spark, sf):
    p = _scratch(spark, "users-table")
    u = dt.users(spark, sf).select("id", "label")
    sinks.create_if_absent(u, p)
    # a second create must not replace the stored table
    return sinks.create_if_absent(u.where(F.col("label") == "bot"), p)


@register("a14_create_or_replace", with_views("SELECT id, label FROM ax_users WHERE label = 'bot'"))
def a14_replace(spark, sf):
    """A table that exists is replaced."""
    p = _scratch(spark, "users-table")
    u = dt.users(spark, sf).select("id", "label")
    sinks.create_table(u, p)
    return sinks.create_table(u.where(F.col("label") == "bot"), p, overwrite=True)


@register("a14_c4_indexed_tables", with_views(
    """SELECT u.id, u.label, count(*) AS n_edges FROM ax_users u JOIN ax_edges e ON e.source_id = u.id GROUP BY u.id, u.label"""))
def a14_indexed(spark, sf):
    """Users and edges as tables with an index on the user, joined and counted on it."""
    users, edges = indexed_users_and_edges(spark, sf)
    return users.join(edges, "id").groupBy("id", "label").agg(F.count(F.lit(1)).alias("n_edges"))


def indexed_users_and_edges(spark, sf, buckets: int = 8):
    made = []
    for name, df in (("users", dt.users(spark, sf).select("id", "label")),
                     ("edges", dt.edges(spark, sf).withColumnRenamed("source_id", "id"))):
        table = f"{name}_{uuid.uuid4().hex[:12]}"
        made.append(sinks.create_indexed_table(df, table, scratch_path(spark, table), "id", buckets))
    return made


@register("a18_run_log", with_views(
    """SELECT 'v1' AS version_name, CAST((SELECT count(*) FROM ax_users) AS VARCHAR) AS users, CAST(NULL AS VARCHAR) AS corrupt
       UNION ALL SELECT 'v2', CAST((SELECT count(*) FROM ax_tweets) AS VARCHAR), NULL
       UNION ALL SELECT NULL, NULL, '{"version_name": "v'"""))
def a18(spark, sf):
    """Two runs logged, with a broken entry between them that is kept apart."""
    p = _scratch(spark, "run-log")
    sinks.append_run_log(spark, p, "v1", {"n": dt.users(spark, sf).count()})
    spark.createDataFrame([('{"version_name": "v',)], "value string").coalesce(1).write.mode("append").text(p)
    sinks.append_run_log(spark, p, "v2", {"n": dt.tweets(spark, sf).count()})
    good, corrupt = sinks.read_run_log(spark, p)
    return good.select("version_name", F.col("config")["n"].alias("users"), F.lit(None).cast("string").alias("corrupt")).unionByName(
        corrupt.select(F.lit(None).cast("string").alias("version_name"), F.lit(None).cast("string").alias("users"),
                       F.col("entry").alias("corrupt")))


@register("a20_rebuilt_stage", with_views("SELECT id, label FROM ax_users"))
def a20(spark, sf):
    """A stored stage whose ids are not the table's is built again."""
    p = _scratch(spark, "stage-labels")
    users = dt.users(spark, sf).select("id", "label")
    sinks.stage(spark, p, lambda: users.where(F.col("label") == "bot"))
    return sinks.validated_stage(spark, p, lambda: users, users.select("id"))


@register("a15_a10_stored_snapshot_100", with_views(
    f"SELECT num_users, num_tweets, num_edges FROM ({COUNTS_SQL}) WHERE snapshot_idx = 100", GRID_CTES))
def a15(spark, sf):
    p = _scratch(spark, "snapshots")
    snap = tp.build_snapshots(dt.users(spark, sf), dt.tweets(spark, sf), dt.edges(spark, sf))
    sinks.write_snapshot_store(snap, p)
    s = tp.snapshot_at(sinks.read_snapshot_store(spark, p), 100)
    kinds = {"num_users": s.users, "num_tweets": s.tweets, "num_edges": s.edges}
    counts = [df.agg(*[(F.count(F.lit(1)) if c == own else F.lit(0)).cast("bigint").alias(c) for c in kinds]) for own, df in kinds.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).agg(*[F.sum(c).alias(c) for c in kinds])


@register("a16_feature_store_lookup", with_views(
    "SELECT id, followers_count FROM ax_records WHERE label = 'bot'"))
def a16(spark, sf):
    p = _scratch(spark, "feature-store")
    recs = dt.user_records(spark, sf)
    sinks.write_feature_store(recs, p)
    bots = dt.users(spark, sf).where(F.col("label") == "bot").select("id")
    return sinks.lookup(spark, p, bots).select("id", F.col("public_metrics.followers_count").alias("followers_count"))


@register("a17_a18_run_summary", with_views(
    """SELECT (SELECT count(*) FROM ax_users) AS total_users, (SELECT count(*) FROM ax_tweets) AS total_tweets,
              (SELECT count(*) FROM grid) AS total_snapshots""", GRID_CTES))
def a17(spark, sf):
    """A17 run summary (snapshots, users, tweets of the built graph) appended to a table and
    read back; the run log entry (A18) is appended next to it."""
    p = _scratch(spark, "run")
    users, tweets = dt.users(spark, sf), dt.tweets(spark, sf)
    snap = tp.build_snapshots(users, tweets, dt.edges(spark, sf))
    summary = spark.createDataFrame([(users.count(), tweets.count(), snap.grid.count)],
                                    "total_users bigint, total_tweets bigint, total_snapshots bigint")
    sinks.append_summary(summary, f"{p}/summary")
    sinks.append_run_log(spark, f"{p}/log", "v1", {"sf_dir": sf, "snapshots": snap.grid.count})
    return spark.read.parquet(f"{p}/summary").drop("written_at")


@register("a19_a20_stage_cache_numeric", with_views(
    " UNION ALL ".join(f"SELECT id, {i} AS pos, round(z{i}, 6) AS value FROM nz" for i in range(6)),
    _NUM_CTES))
def a19(spark, sf):
    p = _scratch(spark, "stage-numeric")
    e = dt.edges(spark, sf)

    def build():
        return ft.numeric_block(dt.user_records(spark, sf, e), e)
    users = dt.users(spark, sf).select("id")
    sinks.stage(spark, p, build)
    nb = sinks.validated_stage(spark, p, build, users)
    return nb.select("id", F.posexplode("numeric").alias("pos", "value")).select(
        "id", "pos", F.round("value", 6).alias("value"))


_TV_CTES = """el AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
              CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
tv AS (SELECT 't' || o.o_orderkey AS tweet_id, el.pos, el.x FROM orders o
       JOIN el ON el.vec_id = o.o_orderkey % (SELECT count(*) FROM embeddings)),
pe AS (SELECT ea.source_id AS id, ea.target_id AS tweet_id,
              (SELECT min(snapshot_idx) FROM grid WHERE grid.ts >= ea.active_from) AS fs
       FROM ea WHERE ea.relation = 'post')"""


@register("a21_a22_partitioned_outputs", with_views(
    """SELECT id, fs AS snapshot_idx, pos, round(sum(s) OVER w / sum(n) OVER w, 6) AS value FROM (
         SELECT pe.id, pe.fs, tv.pos, sum(tv.x) AS s, count(*) AS n FROM pe JOIN tv ON tv.tweet_id = pe.tweet_id
         WHERE pe.fs IS NOT NULL GROUP BY pe.id, pe.fs, tv.pos)
       WINDOW w AS (PARTITION BY id, pos ORDER BY fs ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    GRID_CTES + ",\n" + _TV_CTES))
def a21(spark, sf):
    """The vectors of all snapshots, written by snapshot and read back (A22 is ``a22_stored_scores``).
    Users take turns, so that their posts' vectors are not all on disk beside the result."""
    p = _scratch(spark, "snapshot-vectors")
    snap = tp.build_snapshots(dt.users(spark, sf), dt.tweets(spark, sf), dt.edges(spark, sf))
    with spent_shuffles(spark):
        for k, ch in enumerate(ft.posted_vector_changes_in_turns(snap, dt.tweet_vectors(spark, sf))):
            sinks.write_partitioned_vectors(ch, p, mode="append" if k else "overwrite")
    stored = spark.read.schema("id string, vec array<double>, snapshot_idx bigint").parquet(p)
    return long_rounded(stored, ["id", "snapshot_idx"])


@register("a22_stored_scores")
def a22(spark, sf):
    """The I13 scores of all users, written and read back."""
    p = _scratch(spark, "scores")
    sinks.write_scores(classifier_scores(spark, sf), p)
    s = spark.read.parquet(p)
    return s.select("id", "y", "split", "prediction", F.round("p_bot", 6).alias("p_bot"),
                    F.transform("logits", lambda x: F.round(x, 6)).alias("logits"))
