"""Registered queries: temporal snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import temporal as tp
from graphweft.plans.common import duck_ts, ts_str
from graphweft.plans.oracle_views import with_views
from graphweft.sources import driver_tables as dt

QUERIES = {}
ORACLES = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


SNAP = ", ".join(f"'{r}'" for r in dt.SNAPSHOT_RELATIONS)

# Brute-force oracle pieces: the grid, node times, edge activation.
GRID_CTES = f"""
bounds AS (SELECT (SELECT min(created_at) FROM ax_users) AS lo,
                  greatest((SELECT max(created_at) FROM ax_users),
                           (SELECT max(created_at) FROM ax_tweets)) AS hi),
g0 AS (SELECT lo + to_days(CAST((7 - dayofweek(lo)) % 7 AS INTEGER)) AS t0, hi FROM bounds),
grid AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS snapshot_idx, ts
         FROM (SELECT unnest(generate_series(t0, hi, INTERVAL 7 DAY)) AS ts FROM g0)),
nt AS (SELECT id, created_at AS time FROM ax_users WHERE created_at IS NOT NULL
       UNION ALL SELECT id, created_at FROM ax_tweets WHERE created_at IS NOT NULL),
ea AS (SELECT e.source_id, e.relation, e.target_id, greatest(s.time, t.time) AS active_from
       FROM ax_edges e JOIN nt s ON s.id = e.source_id JOIN nt t ON t.id = e.target_id
       WHERE e.relation IN ({SNAP}))"""

COUNTS_SQL = """SELECT g.snapshot_idx, g.ts,
  (SELECT count(*) FROM ax_users u WHERE u.created_at <= g.ts) AS num_users,
  (SELECT count(*) FROM ax_tweets t JOIN ax_users a ON a.id = 'u' || t.author_id
     WHERE t.created_at <= g.ts AND a.created_at <= g.ts) AS num_tweets,
  (SELECT count(*) FROM ea WHERE ea.active_from <= g.ts) AS num_edges
FROM grid g"""


def _snap(spark, sf):
    return tp.build_snapshots(dt.users(spark, sf), dt.tweets(spark, sf), dt.edges(spark, sf))


@register("c10_e15_edge_activation", with_views(
    f"SELECT source_id, relation, target_id, {duck_ts('active_from')} AS active_from FROM ea",
    GRID_CTES))
def c10(spark, sf):
    times = tp.node_times(dt.users(spark, sf), dt.tweets(spark, sf))
    a = tp.edge_activation(dt.edges(spark, sf), times)
    return a.withColumn("active_from", ts_str("active_from"))


@register("e13_weekly_grid", with_views(
    f"SELECT snapshot_idx, {duck_ts('ts')} AS timestamp FROM grid", GRID_CTES))
def e13(spark, sf):
    s = _snap(spark, sf)
    return tp.snapshot_index(s).withColumn("timestamp", ts_str("timestamp"))


@register("c11_c12_first_snapshots", with_views(
    """SELECT 'user' AS kind, u.id, CAST(min(g.snapshot_idx) AS INTEGER) AS first_snapshot
       FROM ax_users u JOIN grid g ON u.created_at <= g.ts GROUP BY u.id
       UNION ALL
       SELECT 'tweet', t.id, CAST(min(g.snapshot_idx) AS INTEGER)
       FROM ax_tweets t JOIN ax_users a ON a.id = 'u' || t.author_id
       JOIN grid g ON t.created_at <= g.ts AND a.created_at <= g.ts GROUP BY t.id""", GRID_CTES))
def c11(spark, sf):
    s = _snap(spark, sf)
    return (s.users.select(F.lit("user").alias("kind"), "id", "first_snapshot")
            .unionByName(s.tweets.select(F.lit("tweet").alias("kind"), "id", "first_snapshot")))


@register("d18_e14_snapshot_counts", with_views(
    f"""SELECT snapshot_idx, {duck_ts('ts')} AS timestamp, num_users, num_tweets, num_edges
        FROM ({COUNTS_SQL})""", GRID_CTES))
def d18(spark, sf):
    c = tp.snapshot_counts(_snap(spark, sf))
    return c.withColumn("timestamp", ts_str("timestamp"))


@register("b6_kept_snapshots", with_views(
    f"""SELECT snapshot_idx, num_users, num_tweets, num_edges FROM ({COUNTS_SQL})
        WHERE num_users >= 10 AND snapshot_idx < 800""", GRID_CTES))
def b6(spark, sf):
    return tp.kept_snapshots(tp.snapshot_counts(_snap(spark, sf)), max_snapshots=tp.MAX_SNAPSHOTS).drop("timestamp")


_SEQ_SQL = f"""SELECT snapshot_idx, num_users,
        CAST(floor((row_number() OVER (ORDER BY snapshot_idx) - 1) / 11) AS INTEGER) AS sequence_id,
        CAST((row_number() OVER (ORDER BY snapshot_idx) - 1) % 11 AS INTEGER) AS position
      FROM ({COUNTS_SQL}) WHERE num_users >= 10 AND snapshot_idx < 800"""


@register("e10_snapshot_sequences", with_views(_SEQ_SQL, GRID_CTES))
def e10(spark, sf):
    kept = tp.kept_snapshots(tp.snapshot_counts(_snap(spark, sf)), max_snapshots=tp.MAX_SNAPSHOTS)
    return tp.sequences(kept).select("snapshot_idx", "num_users", "sequence_id", "position")


@register("e11_sequence_sizes", with_views(
    f"""SELECT sequence_id, count(*) AS num_snapshots, min(snapshot_idx) AS first_snapshot,
               max(snapshot_idx) AS last_snapshot, max(num_users) AS max_nodes
        FROM ({_SEQ_SQL}) GROUP BY sequence_id""", GRID_CTES))
def e11(spark, sf):
    kept = tp.kept_snapshots(tp.snapshot_counts(_snap(spark, sf)), max_snapshots=tp.MAX_SNAPSHOTS)
    return tp.sequence_sizes(tp.sequences(kept))


@register("a10_snapshot_100_edges", with_views(
    "SELECT source_id, relation, target_id FROM ea WHERE active_from <= (SELECT ts FROM grid WHERE snapshot_idx = 100)",
    GRID_CTES))
def a10(spark, sf):
    s = tp.snapshot_at(_snap(spark, sf), 100)
    return s.edges.select("source_id", "relation", "target_id")


@register("a11_active_by_label", with_views(
    """SELECT g.snapshot_idx,
         (SELECT count(*) FROM ax_users u WHERE u.created_at <= g.ts AND u.label = 'human') AS active_humans,
         (SELECT count(*) FROM ax_users u WHERE u.created_at <= g.ts AND u.label = 'bot') AS active_bots
       FROM grid g""", GRID_CTES))
def a11(spark, sf):
    s = _snap(spark, sf)
    return tp.active_by_label(s, dt.labels(spark, sf))


@register("d22_b7_snapshot_relation_edges", with_views(
    """SELECT g.snapshot_idx, 'user' AS source_kind, r.relation, 'user' AS target_kind,
         (SELECT count(*) FROM ea JOIN ax_users s ON s.id = ea.source_id JOIN ax_users t ON t.id = ea.target_id
           WHERE ea.relation = r.relation AND ea.active_from <= g.ts
             AND s.created_at <= g.ts AND t.created_at <= g.ts) AS num_edges
       FROM grid g, (VALUES ('following'), ('followers')) r(relation)""", GRID_CTES))
def d22(spark, sf):
    return tp.relation_edge_counts(_snap(spark, sf))


@register("d22_c9_e7_edge_lists", with_views(
    """SELECT f.first_snapshot, f.relation, s.local_idx AS src_idx, t.local_idx AS dst_idx FROM (
         SELECT source_id, relation, target_id,
                CAST((SELECT min(snapshot_idx) FROM grid WHERE grid.ts >= ea.active_from) AS INTEGER) AS first_snapshot
         FROM ea WHERE relation IN ('following','followers')) f
       JOIN li s ON s.id = f.source_id JOIN li t ON t.id = f.target_id WHERE f.first_snapshot IS NOT NULL""",
    GRID_CTES + """,
    li AS (SELECT id, row_number() OVER (ORDER BY first_snapshot, id) - 1 AS local_idx FROM (
         SELECT u.id, CAST(min(g.snapshot_idx) AS INTEGER) AS first_snapshot
         FROM ax_users u JOIN grid g ON u.created_at <= g.ts GROUP BY u.id))"""))
def d22_lists(spark, sf):
    return tp.edge_lists(_snap(spark, sf))


@register("e7_local_user_index", with_views(
    """SELECT id, first_snapshot, row_number() OVER (ORDER BY first_snapshot, id) - 1 AS local_idx FROM (
         SELECT u.id, CAST(min(g.snapshot_idx) AS INTEGER) AS first_snapshot
         FROM ax_users u JOIN grid g ON u.created_at <= g.ts GROUP BY u.id)""", GRID_CTES))
def e7(spark, sf):
    return tp.local_user_index(_snap(spark, sf))
