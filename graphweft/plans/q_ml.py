"""Registered queries: splits, metrics, losses, classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import aggregates as agg
from graphweft.operators import features as ft
from graphweft.operators import graph as gr
from graphweft.operators import ml
from graphweft.operators import relational as rel
from graphweft.operators import temporal as tp
from graphweft.plans.oracle_views import uniform_sql, with_views
from graphweft.plans.q_graph import social_graph, user_vectors
from graphweft.plans.q_temporal import COUNTS_SQL, GRID_CTES
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


def _test_mask(spark, sf):
    cust = dt.table(spark, sf, "customer")
    test_ids = cust.where(F.col("c_nationkey") < 5).select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("id"))
    return rel.mask_from_ids(dt.users(spark, sf), test_ids)


@register("i6_static_split", with_views(
    f"""SELECT id, CASE WHEN rk < floor(0.1 * (SELECT count(*) FROM r)) THEN 'val' ELSE 'train' END AS split
        FROM r UNION ALL SELECT id, 'test' FROM m WHERE in_test""",
    f"""m AS (SELECT u.id, c.c_nationkey < 5 AS in_test FROM ax_users u JOIN customer c ON 'u' || c.c_custkey = u.id),
        r AS (SELECT id, row_number() OVER (ORDER BY {uniform_sql('id', 42)}, id) - 1 AS rk FROM m WHERE NOT in_test)"""))
def i6(spark, sf):
    return ml.static_split(_test_mask(spark, sf))


def _kept_members(spark, sf):
    snap = tp.build_snapshots(dt.users(spark, sf), dt.tweets(spark, sf), dt.edges(spark, sf))
    kept = tp.kept_snapshots(tp.snapshot_counts(snap), max_snapshots=tp.MAX_SNAPSHOTS)
    return snap, kept, tp.memberships(snap, kept)


SPLIT_CTES = GRID_CTES + f""",
kept AS (SELECT snapshot_idx FROM ({COUNTS_SQL}) WHERE num_users >= 10 AND snapshot_idx < 800),
mem AS (SELECT g.snapshot_idx, u.id FROM grid g JOIN ax_users u ON u.created_at <= g.ts
        WHERE g.snapshot_idx IN (SELECT snapshot_idx FROM kept)),
nn AS (SELECT snapshot_idx, count(*) AS n FROM mem GROUP BY snapshot_idx),
rk AS (SELECT mem.snapshot_idx, mem.id, nn.n, row_number() OVER (PARTITION BY mem.snapshot_idx
          ORDER BY {uniform_sql("CAST(mem.snapshot_idx AS VARCHAR) || ':' || mem.id", 42)}, mem.id) - 1 AS rank
       FROM mem JOIN nn USING (snapshot_idx)),
spl AS (SELECT snapshot_idx, id, CASE WHEN rank < round_even(0.2 * n, 0) THEN 'val'
                                      WHEN rank < 2 * round_even(0.2 * n, 0) THEN 'test' ELSE 'train' END AS split
        FROM rk)"""


@register("i7_snapshot_split", with_views("SELECT snapshot_idx, id, split FROM spl", SPLIT_CTES))
def i7(spark, sf):
    _, _, mem = _kept_members(spark, sf)
    return ml.snapshot_split(mem)


_METRICS_SQL = """SELECT tp, fp, fn, tn,
   round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END, 6) AS accuracy,
   round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1_bot,
   round(((CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END)
        + (CASE WHEN 2 * tn + fn + fp > 0 THEN 2.0 * tn / (2 * tn + fn + fp) ELSE 0 END)) / 2, 6) AS f1_macro
 FROM (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS tp,
              count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS fp,
              count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS fn,
              count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS tn FROM labels)"""


def _label_metrics(spark, sf):
    lab = dt.table(spark, sf, "labels").select(F.col("toxic").alias("y"), F.col("quality").alias("pred"))
    return ml.binary_metrics(lab)


def _round(df, cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("i9_binary_metrics", _METRICS_SQL)
def i9(spark, sf):
    return _round(_label_metrics(spark, sf), ["accuracy", "f1_bot", "f1_macro"])


@register("i10_selection_score", f"""SELECT accuracy, f1_bot, f1_macro,
        round(0.7 * f1_bot + 0.3 * f1_macro, 6) AS score FROM (
        SELECT round(accuracy, 12) AS accuracy, f1_bot AS f1_bot, f1_macro AS f1_macro FROM ({_METRICS_SQL}))""")
def i10(spark, sf):
    m = ml.selection_score(_label_metrics(spark, sf))
    return _round(m.select("accuracy", "f1_bot", "f1_macro", "score"), ["accuracy", "f1_bot", "f1_macro", "score"])


@register("i12_d20_weighted_cross_entropy", with_views(
    """SELECT round(sum(w * -ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) / sum(w), 6) AS loss FROM (
         SELECT y, 1.0 / (1.0 + exp(z)) AS p,
                CASE WHEN y = 1 THEN (SELECT count(*) FILTER (WHERE label = 'human') / count(*) FROM ax_users)
                     ELSE (SELECT count(*) FILTER (WHERE label = 'bot') / count(*) FROM ax_users) END AS w
         FROM (SELECT CASE WHEN label = 'bot' THEN 1 ELSE 0 END AS y,
                      (followers_count - avg(followers_count) OVER ())
                        / (stddev_samp(followers_count) OVER () + 1e-8) AS z FROM ax_users))"""))
def i12(spark, sf):
    users = dt.users(spark, sf)
    codes = rel.align_labels(users, dt.labels(spark, sf))
    z = ft.zscore(users.select("id", "followers_count"), ["followers_count"])
    d = codes.join(z, "id").withColumn("logit", -F.col("followers_count_z"))
    w = agg.class_weights(codes).first()
    loss = ml.weighted_cross_entropy(d, weights=(w["w_human"], w["w_bot"]), logit="logit")
    return loss.select(F.round("loss", 6).alias("loss"))


@register("i11_e10_sequence_metrics", with_views(
    """SELECT count(*) AS num_sequences, round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy, round(avg(f1_bot), 6) AS f1_bot FROM (
         SELECT sequence_id, avg(loss) AS loss, avg(accuracy) AS accuracy, avg(f1_bot) AS f1_bot FROM (
           SELECT snapshot_idx, loss,
             (tp + tn) / (tp + fp + fn + tn) AS accuracy,
             CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_bot
           FROM (SELECT s.snapshot_idx,
                   avg(greatest(z, 0) + ln(1 + exp(-abs(z))) - y * z) AS loss,
                   count(*) FILTER (WHERE y = 1 AND z > 0) AS tp, count(*) FILTER (WHERE y = 0 AND z > 0) AS fp,
                   count(*) FILTER (WHERE y = 1 AND z <= 0) AS fn, count(*) FILTER (WHERE y = 0 AND z <= 0) AS tn
                 FROM spl s JOIN yp ON yp.id = s.id AND yp.snapshot_idx = s.snapshot_idx
                 WHERE s.split = 'val' GROUP BY s.snapshot_idx)) m
         JOIN seq USING (snapshot_idx) GROUP BY sequence_id)""",
    SPLIT_CTES + """,
    ends AS (SELECT source_id AS id, active_from FROM ea WHERE relation IN ('following','followers')
             UNION ALL SELECT target_id, active_from FROM ea WHERE relation IN ('following','followers')),
    yp AS (SELECT m.snapshot_idx, u.id, CASE WHEN u.label = 'bot' THEN 1 ELSE 0 END AS y, 1 - 1.5 * ln(1 + count(e.id)) AS z
           FROM mem m JOIN grid g ON g.snapshot_idx = m.snapshot_idx JOIN ax_users u ON u.id = m.id
           LEFT JOIN ends e ON e.id = m.id AND e.active_from <= g.ts GROUP BY m.snapshot_idx, u.id, u.label),
    seq AS (SELECT snapshot_idx, CAST(floor((row_number() OVER (ORDER BY snapshot_idx) - 1) / 11) AS INTEGER) AS sequence_id
            FROM kept)"""))
def i11(spark, sf):
    """Loss and metrics of per-snapshot predictions on the validation rows: a logit falls with
    the degree that a user has in the snapshot's graph, read as of the snapshot."""
    snap, kept, mem = _kept_members(spark, sf)
    split = ml.snapshot_split(mem).where(F.col("split") == "val")
    degree = ft.as_of(tp.degree_changes(snap), split)
    y = dt.users(spark, sf).select("id", F.when(F.col("label") == "bot", 1).otherwise(0).alias("y"))
    logit = F.lit(1.0) - F.lit(1.5) * F.log1p(F.coalesce("degree", F.lit(0)))
    out = ml.sequence_evaluation(degree.join(y, "id").select("snapshot_idx", "y", logit.alias("logit")), tp.sequences(kept))
    return out.select("num_sequences", *[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "f1_bot")])


def classifier_scores(spark, sf):
    """SIGN features over the social graph (two hops of relational means of the pooled tweet
    vectors), logistic regression with class weights, selected on validation, scored on all."""
    g = social_graph(spark, sf)
    feats = gr.stacked_neighbour_features(user_vectors(spark, sf), g.edges, list(dt.SOCIAL_RELATIONS), hops=2)
    codes = rel.align_labels(dt.users(spark, sf), dt.labels(spark, sf))
    splits = ml.static_split(_test_mask(spark, sf))
    scored, _ = ml.train_and_score(feats, codes, splits)
    return scored


@register("i8_i13_classifier_scores")
def i8(spark, sf):
    return classifier_scores(spark, sf).select("id", "y", "split", "prediction", F.round("p_bot", 6).alias("p_bot"))


@register("i9_i13_classifier_test_metrics")
def i9t(spark, sf):
    scored = i8(spark, sf)
    return ml.binary_metrics(scored.where(F.col("split") == "test")
                             .select("y", F.col("prediction").alias("pred")))
