"""Registered queries: filters, joins, set operations and aggregates (B, C, D, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import aggregates as agg
from graphweft.operators import relational as rel
from graphweft.operators.ordering import id_index
from graphweft.plans.common import duck_ts, rounded, ts_str
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


@register("b1_snapshot_relations", with_views(
    f"SELECT source_id, relation, target_id FROM ax_edges WHERE relation IN ({SNAP})"))
def b1(spark, sf):
    return rel.relation_filter(dt.edges(spark, sf), dt.SNAPSHOT_RELATIONS)


@register("b2_user_to_user_edges", with_views(
    "SELECT source_id, relation, target_id FROM ax_edges "
    "WHERE starts_with(source_id, 'u') AND starts_with(target_id, 'u')"))
def b2(spark, sf):
    return rel.user_to_user(dt.edges(spark, sf))


@register("b3_b8_tweets_with_text", with_views(
    f"SELECT id AS tweet_id, concat('u', author_id) AS user_id, {duck_ts('created_at')} AS created_at, "
    "text FROM ax_tweets WHERE text IS NOT NULL"))
def b3(spark, sf):
    t = rel.with_text(dt.tweets(spark, sf))
    return t.select(F.col("id").alias("tweet_id"),
                    F.concat(F.lit("u"), F.col("author_id").cast("string")).alias("user_id"),
                    ts_str("created_at").alias("created_at"), "text")


@register("b4_g1_valid_user_times", with_views(
    f"SELECT id, {duck_ts('created_at')} AS created_at FROM ax_users WHERE created_at IS NOT NULL"))
def b4(spark, sf):
    u = dt.users(spark, sf).select("id", ts_str("created_at").alias("created_at"))
    return rel.drop_unparseable_times(u, "created_at").select("id", ts_str("created_at").alias("created_at"))


@register("b5_g12_user_metrics", with_views(
    "SELECT id, followers_count, following_count, tweet_count FROM ax_records"))
def b5(spark, sf):
    recs = dt.user_records(spark, sf).select("id", "public_metrics")
    return rel.flatten_metrics(recs)


@register("b7_kind_consistent_edges", with_views(
    """SELECT source_id, relation, target_id, source_kind, target_kind FROM (
         SELECT *, CASE substr(source_id,1,1) WHEN 'u' THEN 'user' WHEN 't' THEN 'tweet'
                     WHEN 'l' THEN 'list' WHEN 'h' THEN 'hashtag' END AS source_kind,
                   CASE substr(target_id,1,1) WHEN 'u' THEN 'user' WHEN 't' THEN 'tweet'
                     WHEN 'l' THEN 'list' WHEN 'h' THEN 'hashtag' END AS target_kind
         FROM ax_edges) e
       WHERE (relation IN ('following','followers') AND source_kind='user' AND target_kind='user')
          OR (relation IN ('post','pinned','like') AND source_kind='user' AND target_kind='tweet')
          OR (relation = 'mentioned' AND source_kind='tweet' AND target_kind='user')
          OR (relation IN ('retweeted','quoted','replied') AND source_kind='tweet' AND target_kind='tweet')
          OR (relation IN ('own','followed','membership') AND source_kind='user' AND target_kind='list')
          OR (relation = 'contain' AND source_kind='list' AND target_kind='tweet')
          OR (relation = 'discuss' AND source_kind='tweet' AND target_kind='hashtag')"""))
def b7(spark, sf):
    return rel.kind_consistent(dt.edges(spark, sf))


@register("c1_users_join_labels", with_views(
    "SELECT u.id, u.name, l.label FROM ax_users u JOIN (SELECT id, label FROM ax_users) l ON l.id = u.id"))
def c1(spark, sf):
    u = dt.users(spark, sf)
    return rel.users_with_labels(u.select("id", "name"), dt.labels(spark, sf))


@register("c2_d1_users_degree", with_views(
    """SELECT u.id, u.label, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree FROM ax_users u
       LEFT JOIN (SELECT id, count(*) AS degree FROM (
           SELECT source_id AS id FROM ax_edges WHERE relation IN ('following','followers')
           UNION ALL SELECT target_id FROM ax_edges WHERE relation IN ('following','followers'))
         GROUP BY id) d ON d.id = u.id"""))
def c2(spark, sf):
    return agg.users_with_degree(dt.users(spark, sf).select("id", "label"), dt.edges(spark, sf))


@register("d1_degree", with_views(
    """SELECT id, count(*) AS degree FROM (
         SELECT source_id AS id FROM ax_edges WHERE relation IN ('following','followers')
         UNION ALL SELECT target_id FROM ax_edges WHERE relation IN ('following','followers'))
       GROUP BY id"""))
def d1(spark, sf):
    return agg.degree(dt.edges(spark, sf))


@register("c3_d2_like_counts", with_views(
    """SELECT u.id, CAST(coalesce(l.like_count, 0) AS BIGINT) AS like_count FROM ax_users u
       LEFT JOIN (SELECT source_id AS id, count(DISTINCT target_id) AS like_count
                  FROM ax_edges WHERE relation = 'like' GROUP BY source_id) l ON l.id = u.id"""))
def c3(spark, sf):
    e = dt.edges(spark, sf)
    return rel.left_join_fill(dt.users(spark, sf).select("id"), agg.distinct_likes(e), "id",
                              {"like_count": 0})


@register("c4_user_tweets", with_views(
    f"""SELECT u.id, t.id AS tweet_id, {duck_ts('t.created_at')} AS created_at, t.text
        FROM ax_users u JOIN ax_tweets t ON u.id = 'u' || t.author_id WHERE t.text IS NOT NULL"""))
def c4(spark, sf):
    j = rel.tweets_of_users(dt.users(spark, sf), dt.tweets(spark, sf))
    return j.select("id", "tweet_id", ts_str("created_at").alias("created_at"), "text")


@register("c5_labelled_social_edges", with_views(
    """SELECT e.source_id, e.relation, e.target_id, s.label AS source_label, t.label AS target_label
       FROM ax_edges e LEFT JOIN ax_users s ON s.id = e.source_id LEFT JOIN ax_users t ON t.id = e.target_id
       WHERE e.relation IN ('following','followers')"""))
def c5(spark, sf):
    e = rel.relation_filter(dt.edges(spark, sf), dt.SOCIAL_RELATIONS)
    return rel.label_endpoints(e, dt.labels(spark, sf))


@register("c6_f7_first_line_per_liked_part", with_views(
    """SELECT id, l_orderkey, l_linenumber, l_quantity FROM (
         SELECT 't' || l_partkey AS id, l_orderkey, l_linenumber, l_quantity,
                row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn
         FROM lineitem WHERE 't' || l_partkey IN (SELECT target_id FROM ax_edges WHERE relation = 'like'))
       WHERE rn = 1"""))
def c6(spark, sf):
    li = dt.table(spark, sf, "lineitem").select(
        F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("id"),
        "l_orderkey", "l_linenumber", "l_quantity")
    liked = dt.edges(spark, sf).where(F.col("relation") == "like").select(F.col("target_id").alias("id"))
    return rel.first_match(li, liked, "id", ["l_orderkey", "l_linenumber"])


@register("c7_edges_touching_bots", with_views(
    """SELECT source_id, relation, target_id FROM ax_edges
       WHERE source_id IN (SELECT id FROM ax_users WHERE label = 'bot')
          OR target_id IN (SELECT id FROM ax_users WHERE label = 'bot')"""))
def c7(spark, sf):
    bots = dt.users(spark, sf).where(F.col("label") == "bot").select("id")
    return rel.touching(dt.edges(spark, sf), bots)


@register("c8_social_edges_within_bots", with_views(
    """SELECT source_id, relation, target_id FROM ax_edges
       WHERE relation IN ('following','followers')
         AND source_id IN (SELECT id FROM ax_users WHERE label = 'bot')
         AND target_id IN (SELECT id FROM ax_users WHERE label = 'bot')"""))
def c8(spark, sf):
    bots = dt.users(spark, sf).where(F.col("label") == "bot").select("id")
    e = rel.relation_filter(dt.edges(spark, sf), dt.SOCIAL_RELATIONS)
    return rel.within(e, bots)


@register("c9_e6_encoded_social_edges", with_views(
    """SELECT s.idx AS src_idx, t.idx AS dst_idx, e.relation FROM ax_edges e
       JOIN (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS idx FROM ax_users) s ON s.id = e.source_id
       JOIN (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS idx FROM ax_users) t ON t.id = e.target_id
       WHERE e.relation IN ('following','followers')"""))
def c9(spark, sf):
    idx = id_index(dt.users(spark, sf))
    e = rel.relation_filter(dt.edges(spark, sf), dt.SOCIAL_RELATIONS)
    return rel.encode_endpoints(e, idx)


@register("e6_user_index", with_views(
    "SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS idx FROM ax_users"))
def e6(spark, sf):
    return id_index(dt.users(spark, sf))


@register("c13_g8_label_codes", with_views(
    "SELECT id, CAST(CASE label WHEN 'human' THEN 0 WHEN 'bot' THEN 1 END AS INTEGER) AS y FROM ax_users"))
def c13(spark, sf):
    return rel.align_labels(dt.users(spark, sf), dt.labels(spark, sf))


@register("c20_test_mask", with_views(
    """SELECT u.id, c.c_nationkey < 5 AS in_test FROM ax_users u
       JOIN customer c ON 'u' || c.c_custkey = u.id"""))
def c20(spark, sf):
    cust = dt.table(spark, sf, "customer")
    test_ids = cust.where(F.col("c_nationkey") < 5).select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("id"))
    return rel.mask_from_ids(dt.users(spark, sf), test_ids)


@register("d3_relation_counts", with_views(
    "SELECT relation, count(*) AS n FROM ax_edges GROUP BY relation"))
def d3(spark, sf):
    return agg.relation_counts(dt.edges(spark, sf))


_D4_SQL = """SELECT e.relation,
       count(*) FILTER (WHERE s.label='human' AND t.label='human') AS human_human,
       count(*) FILTER (WHERE s.label='human' AND t.label='bot') AS human_bot,
       count(*) FILTER (WHERE s.label='bot' AND t.label='human') AS bot_human,
       count(*) FILTER (WHERE s.label='bot' AND t.label='bot') AS bot_bot
  FROM ax_edges e JOIN ax_users s ON s.id = e.source_id JOIN ax_users t ON t.id = e.target_id
  GROUP BY e.relation"""


@register("d4_interaction_matrix", with_views(_D4_SQL))
def d4(spark, sf):
    return agg.interaction_matrix(dt.edges(spark, sf), dt.labels(spark, sf))


@register("d5_interaction_row_normalised", with_views(
    """SELECT relation,
        round(CASE WHEN human_human + human_bot > 0 THEN human_human / (human_human + human_bot) END, 6) AS human_human,
        round(CASE WHEN human_human + human_bot > 0 THEN human_bot / (human_human + human_bot) END, 6) AS human_bot,
        round(CASE WHEN bot_human + bot_bot > 0 THEN bot_human / (bot_human + bot_bot) END, 6) AS bot_human,
        round(CASE WHEN bot_human + bot_bot > 0 THEN bot_bot / (bot_human + bot_bot) END, 6) AS bot_bot
       FROM m""", f"m AS ({_D4_SQL})"))
def d5(spark, sf):
    return agg.row_normalised(agg.interaction_matrix(dt.edges(spark, sf), dt.labels(spark, sf)))


@register("d6_class_shares", with_views(
    "SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM ax_users), 6) AS share "
    "FROM ax_users GROUP BY label"))
def d6(spark, sf):
    return rounded(agg.class_shares(dt.users(spark, sf)), "share")


@register("d7_distinct_summary", with_views(
    """SELECT count(DISTINCT id) AS num_users,
              count(DISTINCT id) FILTER (WHERE label='human') AS num_humans,
              count(DISTINCT id) FILTER (WHERE label='bot') AS num_bots,
              round(count(DISTINCT id) FILTER (WHERE label='human') / count(DISTINCT id), 6) AS perc_humans,
              round(count(DISTINCT id) FILTER (WHERE label='bot') / count(DISTINCT id), 6) AS perc_bots,
              (SELECT count(DISTINCT id) FROM ax_tweets) AS num_tweets
       FROM ax_users"""))
def d7(spark, sf):
    return rounded(agg.distinct_summary(dt.users(spark, sf), dt.tweets(spark, sf).select("id")),
                   "perc_humans", "perc_bots")


@register("d8_means_by_label", with_views(
    """SELECT metric, human, bot FROM (
         SELECT 'avg_degree' AS metric,
                round(avg(degree) FILTER (WHERE label='human'), 6) AS human,
                round(avg(degree) FILTER (WHERE label='bot'), 6) AS bot FROM ud
         UNION ALL
         SELECT 'avg_followers', round(avg(followers_count) FILTER (WHERE label='human'), 6),
                round(avg(followers_count) FILTER (WHERE label='bot'), 6) FROM ud
         UNION ALL
         SELECT 'avg_following', round(avg(following_count) FILTER (WHERE label='human'), 6),
                round(avg(following_count) FILTER (WHERE label='bot'), 6) FROM ud)""",
    """ud AS (SELECT r.id, r.label, r.followers_count, r.following_count,
                     coalesce(d.degree, 0) AS degree FROM ax_records r
              LEFT JOIN (SELECT id, count(*) AS degree FROM (
                  SELECT source_id AS id FROM ax_edges WHERE relation IN ('following','followers')
                  UNION ALL SELECT target_id FROM ax_edges WHERE relation IN ('following','followers'))
                GROUP BY id) d ON d.id = r.id)"""))
def d8(spark, sf):
    e = dt.edges(spark, sf)
    recs = rel.flatten_metrics(dt.user_records(spark, sf, e).select("id", "label", "public_metrics"))
    ud = agg.users_with_degree(recs, e)
    means = agg.means_by_label(ud, {"avg_degree": "degree", "avg_followers": "followers_count",
                                    "avg_following": "following_count"})
    return rounded(means, "human", "bot")


@register("d11_g11_year_histogram", with_views(
    """SELECT CAST(b.bin_start AS INTEGER) AS bin_start, CAST(coalesce(c.n, 0) AS BIGINT) AS n
       FROM range(1992, 1998) b(bin_start) LEFT JOIN (
         SELECT least(year(created_at), 1997) AS bin_start, count(*) AS n FROM ax_users
         WHERE year(created_at) BETWEEN 1992 AND 1998 GROUP BY 1) c ON c.bin_start = b.bin_start"""))
def d11(spark, sf):
    return agg.year_histogram(dt.users(spark, sf), "created_at", 1992, 1999)


@register("d12_degree_density_histogram", with_views(
    """SELECT label, bin, count(*) AS n, round(count(*) / (max(nl) * max(w)), 6) AS density FROM (
         SELECT label, CAST(least(floor((degree - lo) / w), 49) AS INTEGER) AS bin, w,
                count(*) OVER (PARTITION BY label) AS nl
         FROM (SELECT *, min(degree) OVER () AS lo,
                      CASE WHEN max(degree) OVER () > min(degree) OVER ()
                           THEN (max(degree) OVER () - min(degree) OVER ()) / 50.0 ELSE 1.0 END AS w
               FROM ud))
       GROUP BY label, bin""",
    """ud AS (SELECT u.id, u.label, coalesce(d.degree, 0) AS degree FROM ax_users u
              LEFT JOIN (SELECT id, count(*) AS degree FROM (
                  SELECT source_id AS id FROM ax_edges WHERE relation IN ('following','followers')
                  UNION ALL SELECT target_id FROM ax_edges WHERE relation IN ('following','followers'))
                GROUP BY id) d ON d.id = u.id)"""))
def d12(spark, sf):
    ud = agg.users_with_degree(dt.users(spark, sf).select("id", "label"), dt.edges(spark, sf))
    return rounded(agg.density_histogram(ud, "degree", 50, group="label"), "density")


@register("d13_follower_quantiles", with_views(
    """SELECT label, round(quantile_cont(followers_count, 0.05), 6) AS q05,
              round(quantile_cont(followers_count, 0.95), 6) AS q95,
              round(quantile_cont(followers_count, 0.99), 6) AS q99
       FROM ax_users GROUP BY label"""))
def d13(spark, sf):
    return rounded(agg.quantiles(dt.users(spark, sf), "followers_count", group="label"), "q05", "q95", "q99")


@register("d14_time_range", with_views(
    f"""SELECT {duck_ts('(SELECT min(created_at) FROM ax_users)')} AS min_time,
               {duck_ts('greatest((SELECT max(created_at) FROM ax_users), (SELECT max(created_at) FROM ax_tweets))')} AS max_time"""))
def d14(spark, sf):
    r = agg.time_range(dt.users(spark, sf), dt.tweets(spark, sf))
    return r.select(ts_str("min_time").alias("min_time"), ts_str("max_time").alias("max_time"))


@register("d20_class_weights", with_views(
    """SELECT round(count(*) FILTER (WHERE label='human') / count(*), 6) AS w_bot,
              round(count(*) FILTER (WHERE label='bot') / count(*), 6) AS w_human FROM ax_users"""))
def d20(spark, sf):
    codes = rel.align_labels(dt.users(spark, sf), dt.labels(spark, sf))
    w = agg.class_weights(codes)
    return w.select(F.round("w_bot", 6).alias("w_bot"), F.round("w_human", 6).alias("w_human"))


@register("d23_graph_summary", with_views(
    """SELECT 'nodes' AS metric, count(*) AS value FROM (
           SELECT id FROM ax_users UNION SELECT source_id FROM soc UNION SELECT target_id FROM soc)
       UNION ALL SELECT 'edges', count(*) FROM soc
       UNION ALL SELECT 'relations', CAST(2 AS BIGINT)""",
    "soc AS (SELECT * FROM ax_edges WHERE relation IN ('following','followers'))"))
def d23(spark, sf):
    e = rel.relation_filter(dt.edges(spark, sf), dt.SOCIAL_RELATIONS)
    return agg.graph_summary(dt.users(spark, sf), e, n_relations=2)


@register("f3_typed_social_edges", with_views(
    """SELECT source_id, relation, target_id,
              CAST(CASE relation WHEN 'followers' THEN 0 ELSE 1 END AS INTEGER) AS rel_code
       FROM ax_edges WHERE relation IN ('following','followers')"""))
def f3(spark, sf):
    return rel.typed_edge_list(dt.edges(spark, sf))


@register("f4_tweets_posted_or_liked", with_views(
    "SELECT target_id AS id FROM ax_edges WHERE relation = 'post' "
    "UNION SELECT target_id FROM ax_edges WHERE relation = 'like'"))
def f4(spark, sf):
    e = dt.edges(spark, sf)
    return rel.distinct_union(e.where(F.col("relation") == "post").select(F.col("target_id").alias("id")),
                              e.where(F.col("relation") == "like").select(F.col("target_id").alias("id")))


@register("f5_users_without_social_edges", with_views(
    """SELECT id, label FROM ax_users WHERE id NOT IN (
         SELECT source_id FROM ax_edges WHERE relation IN ('following','followers')
         UNION SELECT target_id FROM ax_edges WHERE relation IN ('following','followers'))"""))
def f5(spark, sf):
    e = rel.relation_filter(dt.edges(spark, sf), dt.SOCIAL_RELATIONS)
    ends = e.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return rel.not_in(dt.users(spark, sf).select("id", "label"), ends, "id")
