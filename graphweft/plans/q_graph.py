"""Registered queries: graph analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import aggregates as agg
from graphweft.operators import graph as gr
from graphweft.operators import relational as rel
from graphweft.operators.features import recent_tweet_vector
from graphweft.operators.ordering import rank_desc
from graphweft.plans.common import rounded, shared
from graphweft.plans.oracle_views import with_views
from graphweft.session import cut_lineage
from graphweft.sources import driver_tables as dt

QUERIES = {}
ORACLES = {}

PR_ROUNDS = 10
# Converged PageRank: Spark stops at this tolerance, the SQL unrolls rounds enough for it.
PR_TOLERANCE = 1e-14
PR_SQL_ROUNDS = 120


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def social_graph(spark, sf):
    """EDA graph: all users as vertices, social edges with both ends users."""
    users = dt.users(spark, sf)
    e = rel.within(rel.relation_filter(dt.edges(spark, sf), dt.SOCIAL_RELATIONS), users.select("id"))
    return gr.build_graph(users.select("id", "label"), e)


SOC_CTES = """soc AS (SELECT * FROM ax_edges WHERE relation IN ('following','followers')
                 AND source_id IN (SELECT id FROM ax_users) AND target_id IN (SELECT id FROM ax_users)),
verts AS (SELECT id FROM ax_users UNION SELECT source_id FROM soc UNION SELECT target_id FROM soc)"""


def pagerank_sql(rounds: int, alpha: float = 0.85, ctes: str = SOC_CTES) -> str:
    """The unrolled PageRank rounds as materialised CTEs (generated text)."""
    parts = [ctes,
             "nv AS (SELECT count(*)::DOUBLE AS n FROM verts)",
             "w AS (SELECT source_id AS src, target_id AS dst, count(*) AS w FROM soc GROUP BY 1, 2)",
             "ow AS (SELECT src, sum(w) AS ow FROM w GROUP BY src)",
             "pe AS (SELECT w.src, w.dst, w.w / ow.ow AS p FROM w JOIN ow USING (src))",
             "r0 AS MATERIALIZED (SELECT v.id, ow.src IS NULL AS dangling, 1.0 / (SELECT n FROM nv) AS pr "
             "FROM verts v LEFT JOIN ow ON ow.src = v.id)"]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT r.id, r.dangling, {alpha} * coalesce(c.s, 0) + "
            f"(1 - {alpha}) / (SELECT n FROM nv) + {alpha} * coalesce((SELECT sum(pr) FROM {p} WHERE dangling), 0) "
            f"/ (SELECT n FROM nv) AS pr FROM {p} r LEFT JOIN (SELECT pe.dst, sum(x.pr * pe.p) AS s "
            f"FROM pe JOIN {p} x ON x.id = pe.src GROUP BY pe.dst) c ON c.dst = r.id)")
    return ",\n".join(parts)


@register("h1_pagerank_10_rounds", with_views(
    f"SELECT id, round(pr, 8) AS pagerank FROM r{PR_ROUNDS}", pagerank_sql(PR_ROUNDS)))
def h1(spark, sf):
    pr = gr.pagerank(social_graph(spark, sf), max_iter=PR_ROUNDS, tol=None)
    return pr.select("id", F.round("pagerank", 8).alias("pagerank"))


def converged_pagerank(spark, sf):
    """PageRank run to convergence (id, pagerank rounded to 8 digits)."""
    pr = shared(spark, sf, "pagerank", lambda: gr.pagerank(social_graph(spark, sf), tol=PR_TOLERANCE, max_iter=400))
    return rounded(pr, "pagerank", digits=8)


@register("h1_pagerank_converged", with_views(
    f"SELECT id, round(pr, 8) AS pagerank FROM r{PR_SQL_ROUNDS}", pagerank_sql(PR_SQL_ROUNDS)))
def h1c(spark, sf):
    return converged_pagerank(spark, sf)


@register("e8_pagerank_rank", with_views(
    f"""SELECT id, row_number() OVER (ORDER BY round(pr, 8) DESC, id) AS rank, round(pr, 8) AS pagerank
        FROM r{PR_SQL_ROUNDS}""", pagerank_sql(PR_SQL_ROUNDS)))
def e8(spark, sf):
    pr = converged_pagerank(spark, sf)
    return rank_desc(pr, "pagerank").select("id", "rank", "pagerank")


_DEG_SQL = """SELECT v.id, round(coalesce(d.degree, 0) / ((SELECT count(*) FROM verts) - 1), 8) AS degree_centrality
  FROM verts v LEFT JOIN (SELECT id, count(*) AS degree FROM (
      SELECT source_id AS id FROM soc UNION ALL SELECT target_id FROM soc) GROUP BY id) d ON d.id = v.id"""


@register("h2_degree_centrality", with_views(_DEG_SQL, SOC_CTES))
def h2(spark, sf):
    dc = gr.degree_centrality(social_graph(spark, sf))
    return dc.select("id", F.round("degree_centrality", 8).alias("degree_centrality"))


CC_CTES = SOC_CTES + """,
und AS (SELECT source_id AS a, target_id AS b FROM soc UNION SELECT target_id, source_id FROM soc),
reach(id, root) AS (SELECT id, id FROM verts UNION SELECT und.b, reach.root FROM reach JOIN und ON und.a = reach.id),
cc AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""


@register("h4_connected_components", with_views("SELECT id, component FROM cc", CC_CTES, recursive=True))
def h4(spark, sf):
    return gr.connected_components(social_graph(spark, sf))


@register("h4_c18_largest_component_share", with_views(
    """SELECT u.label, count(*) AS n,
              round(avg(CASE WHEN cc.component = (SELECT component FROM cc GROUP BY component
                                                  ORDER BY count(*) DESC, component LIMIT 1)
                        THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_in_largest
       FROM ax_users u JOIN cc ON cc.id = u.id GROUP BY u.label""", CC_CTES, recursive=True))
def h4b(spark, sf):
    g = social_graph(spark, sf)
    comps = gr.connected_components(g)
    return gr.largest_component_share(comps, dt.labels(spark, sf))


@register("h4_component_sizes", with_views(
    "SELECT component, count(*) AS size FROM cc GROUP BY component", CC_CTES, recursive=True))
def h4s(spark, sf):
    return gr.component_sizes(gr.connected_components(social_graph(spark, sf)))


@register("d21_adjacency_sets", with_views(
    """SELECT DISTINCT source_id AS id, target_id AS neighbour FROM soc
       UNION SELECT target_id, source_id FROM soc""", SOC_CTES))
def d21(spark, sf):
    return gr.adjacency_sets(social_graph(spark, sf).edges)


@register("h9_undirected_view", with_views(
    """SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b
       FROM soc WHERE source_id <> target_id""", SOC_CTES))
def h9(spark, sf):
    return social_graph(spark, sf).undirected()


# Median summary per label (D9) on the converged PageRank.
_D9_SQL = f"""SELECT u.label, count(*) AS num_accounts,
       round(median(u.followers_count), 4) AS median_followers,
       round(median(r.following_count), 4) AS median_following,
       round(median(log10(round(p.pr, 8))), 4) AS median_log10_pagerank,
       round(median(d.degree_centrality), 4) AS median_degree_centrality,
       round(avg(CASE WHEN cc.component = (SELECT component FROM cc GROUP BY component
                                           ORDER BY count(*) DESC, component LIMIT 1)
                 THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_in_largest
  FROM ax_users u JOIN ax_records r ON r.id = u.id JOIN r{PR_SQL_ROUNDS} p ON p.id = u.id
  JOIN ({_DEG_SQL}) d ON d.id = u.id JOIN cc ON cc.id = u.id
  GROUP BY u.label"""


@register("d9_median_summary", with_views(_D9_SQL, pagerank_sql(PR_SQL_ROUNDS) + CC_CTES[len(SOC_CTES):],
                                          recursive=True))
def d9(spark, sf):
    g = social_graph(spark, sf)
    pr = converged_pagerank(spark, sf)
    dc = gr.degree_centrality(g)
    comps = cut_lineage(gr.connected_components(g))
    top = gr.component_sizes(comps).orderBy(F.desc("size"), F.asc("component")).limit(1).select(
        "component", F.lit(True).alias("in_largest"))
    recs = rel.flatten_metrics(dt.user_records(spark, sf).select("id", "label", "public_metrics"))
    j = cut_lineage(recs.join(pr, "id").join(dc, "id").join(comps, "id").join(top, "component", "left")
                    .withColumn("log10_pagerank", F.log10("pagerank")))
    names = {"median_followers": "followers_count", "median_following": "following_count",
             "median_log10_pagerank": "log10_pagerank", "median_degree_centrality": "degree_centrality"}
    long = j.select("label", F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(c).cast("double").alias("value")) for k, c in names.items()])).alias("m"))
    medians = agg.quantile_table(long.select("label", "m.*"), "value", [0.5], ["label", "metric"])
    wide = medians.groupBy("label").agg(*[F.round(F.max(F.when(F.col("metric") == k, F.col("value"))), 4).alias(k) for k in names])
    base = j.groupBy("label").agg(
        F.count(F.lit(1)).alias("num_accounts"),
        F.round(F.avg(F.coalesce(F.col("in_largest"), F.lit(False)).cast("double")) * 100, 4).alias("pct_in_largest"))
    return base.join(wide, "label").select("label", "num_accounts", *names, "pct_in_largest")


# --- H7 / H8 on the users' pooled tweet vectors (D15) --------------------------------------

UV_CTES = """rt AS (SELECT id, tweet_id FROM (
    SELECT u.id, t.id AS tweet_id,
           row_number() OVER (PARTITION BY u.id ORDER BY t.created_at DESC, t.id ASC) AS rn
    FROM ax_users u JOIN ax_tweets t ON u.id = 'u' || t.author_id WHERE t.text IS NOT NULL) WHERE rn <= 20),
tv AS (SELECT 't' || o.o_orderkey AS id, e.embedding FROM orders o
       JOIN embeddings e ON o.o_orderkey % (SELECT count(*) FROM embeddings) = e.vec_id),
tvl AS (SELECT id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
               CAST(unnest(embedding) AS DOUBLE) AS value FROM tv),
uvp AS (SELECT rt.id, tvl.pos, avg(tvl.value) AS value FROM rt JOIN tvl ON tvl.id = rt.tweet_id
        GROUP BY rt.id, tvl.pos),
uv AS (SELECT u.id, p.pos, coalesce(uvp.value, 0.0) AS value
       FROM ax_users u CROSS JOIN (SELECT CAST(range AS INTEGER) AS pos FROM range(64)) p
       LEFT JOIN uvp ON uvp.id = u.id AND uvp.pos = p.pos)"""


def user_vectors(spark, sf):
    tv = dt.tweet_vectors(spark, sf)
    return recent_tweet_vector(dt.users(spark, sf), dt.tweets(spark, sf), tv, dim=64)


def long_rounded(df, keys, vec_col="vec", digits=6):
    return df.select(*keys, F.posexplode(vec_col).alias("pos", "value")).select(
        *keys, "pos", F.round("value", digits).alias("value"))


@register("h7_relational_mean", with_views(
    """SELECT s.target_id AS id, s.relation, uv.pos, round(avg(uv.value), 6) AS value
       FROM soc s JOIN uv ON uv.id = s.source_id GROUP BY s.target_id, s.relation, uv.pos""",
    SOC_CTES + ",\n" + UV_CTES))
def h7(spark, sf):
    g = social_graph(spark, sf)
    m = gr.relational_mean(g.edges, user_vectors(spark, sf))
    return long_rounded(m, ["id", "relation"])


@register("h7_root_sum", with_views(
    """SELECT uv.id, uv.pos, round(uv.value + coalesce(m.value, 0), 6) AS value FROM uv
       LEFT JOIN (SELECT id, pos, sum(value) AS value FROM (
           SELECT s.target_id AS id, s.relation, uv.pos, avg(uv.value) AS value
           FROM soc s JOIN uv ON uv.id = s.source_id GROUP BY s.target_id, s.relation, uv.pos) GROUP BY id, pos) m
         ON m.id = uv.id AND m.pos = uv.pos""", SOC_CTES + ",\n" + UV_CTES))
def h7r(spark, sf):
    """One relational layer with identity weights: a node's own vector plus its relations' means."""
    g = social_graph(spark, sf)
    return long_rounded(gr.rgcn_propagate(user_vectors(spark, sf), g.edges, list(dt.SOCIAL_RELATIONS)), ["id"])


@register("h8_normalised_relational_sum", with_views(
    """SELECT p.row AS id, p.relation, uv.pos,
              round(sum(p.mult * pow(dr.d, -0.5) * coalesce(pow(dc.d, -0.5), 0) * uv.value), 6) AS value
       FROM (SELECT source_id AS row, relation, target_id AS col, count(*) AS mult FROM soc GROUP BY 1, 2, 3) p
       JOIN (SELECT source_id AS node, relation, count(*) AS d FROM soc GROUP BY 1, 2) dr
         ON dr.node = p.row AND dr.relation = p.relation
       LEFT JOIN (SELECT source_id AS node, relation, count(*) AS d FROM soc GROUP BY 1, 2) dc
         ON dc.node = p.col AND dc.relation = p.relation
       JOIN uv ON uv.id = p.col
       GROUP BY p.row, p.relation, uv.pos""", SOC_CTES + ",\n" + UV_CTES))
def h8(spark, sf):
    g = social_graph(spark, sf)
    s = gr.normalised_relational_sum(g.edges, user_vectors(spark, sf))
    return long_rounded(s, ["id", "relation"])


# --- H3 communities, modularity, summaries ------------------------------------------------------

@register("h3_modularity_of_components", with_views(
    """SELECT round((SELECT sum(w) FILTER (WHERE cs = cd) FROM j) / (SELECT sum(w) FROM j)
                    - (SELECT sum(kk) FROM k) / pow((SELECT sum(w) FROM j), 2), 8) AS modularity""",
    CC_CTES + """,
    ew AS (SELECT source_id AS src, target_id AS dst, count(*)::DOUBLE AS w FROM soc GROUP BY 1, 2),
    j AS (SELECT ew.*, a.component AS cs, b.component AS cd FROM ew JOIN cc a ON a.id = ew.src
          JOIN cc b ON b.id = ew.dst),
    k AS (SELECT o.kout * i.kin AS kk FROM (SELECT cs AS c, sum(w) AS kout FROM j GROUP BY cs) o
          JOIN (SELECT cd AS c, sum(w) AS kin FROM j GROUP BY cd) i USING (c))""", recursive=True))
def h3m(spark, sf):
    g = social_graph(spark, sf)
    comps = gr.connected_components(g).withColumnRenamed("component", "community")
    q = gr.modularity(gr.weighted_edges(g.edges), comps)
    return spark.createDataFrame([(round(q, 8),)], "modularity double")


def louvain_communities(spark, sf):
    return shared(spark, sf, "louvain", lambda: gr.louvain(social_graph(spark, sf)))


@register("h3_louvain_communities")
def h3(spark, sf):
    return louvain_communities(spark, sf)


@register("h3_louvain_checks", with_views(
    """SELECT count(*) AS covered, count(*) AS vertices, TRUE AS disjoint, TRUE AS named_by_smallest, TRUE AS at_least_components
       FROM (SELECT id FROM ax_users UNION SELECT source_id FROM ax_edges WHERE relation IN ('following','followers')
             UNION SELECT target_id FROM ax_edges WHERE relation IN ('following','followers'))"""))
def h3_checks(spark, sf):
    """The communities cover every vertex once, are named by their smallest member, and their
    modularity is not below that of the components."""
    g = social_graph(spark, sf)
    comm = louvain_communities(spark, sf)
    ew = cut_lineage(gr.weighted_edges(g.edges))
    comps = gr.connected_components(g).withColumnRenamed("component", "community")
    better = gr.modularity(ew, comm) >= gr.modularity(ew, comps) - 1e-9
    least = comm.groupBy("community").agg(F.min("id").alias("least"))
    rows = comm.agg(F.count("id").alias("covered"), F.count_distinct("id").alias("ids"))
    vertices = g.all_vertices.agg(F.count("id").alias("vertices"))
    wrong = least.agg(F.count(F.when(F.col("least") != F.col("community"), 1)).alias("wrong"))
    one = F.lit(1)
    joined = (rows.withColumn("k", one).join(vertices.withColumn("k", one), "k").join(wrong.withColumn("k", one), "k"))
    return joined.select("covered", "vertices", (F.col("ids") == F.col("covered")).alias("disjoint"),
                         (F.col("wrong") == 0).alias("named_by_smallest"), F.lit(better).alias("at_least_components"))


def _community_summary(spark, sf, top):
    """Largest communities with label shares, plus the partition's modularity next to that of
    the singletons and of the components."""
    g = social_graph(spark, sf)
    comm = louvain_communities(spark, sf)
    ew = cut_lineage(gr.weighted_edges(g.edges))
    comps = gr.connected_components(g).withColumnRenamed("component", "community")
    q = {"modularity": comm, "singleton_modularity": g.all_vertices.select("id", F.col("id").alias("community")),
         "component_modularity": comps}
    out = gr.community_summary(comm, dt.labels(spark, sf), top=top)
    return out.withColumns({k: F.lit(round(gr.modularity(ew, c), 8)) for k, c in q.items()})


@register("d24_e9_h3_community_summary")
def d24(spark, sf):
    return _community_summary(spark, sf, 10)


@register("e9_community_size_curve")
def e9(spark, sf):
    """Sizes of the 25 largest communities, by rank."""
    return gr.community_summary(louvain_communities(spark, sf), dt.labels(spark, sf), top=25).select("rank", "size")


@register("c17_e8_pagerank_with_label", with_views(
    f"""SELECT r.id, row_number() OVER (ORDER BY round(r.pr, 8) DESC, r.id) AS rank,
               round(r.pr, 8) AS pagerank, u.label
        FROM r{PR_SQL_ROUNDS} r LEFT JOIN ax_users u ON u.id = r.id""", pagerank_sql(PR_SQL_ROUNDS)))
def c17(spark, sf):
    """E8 ranks with each node's label attached by a left join (C17)."""
    pr = rank_desc(converged_pagerank(spark, sf), "pagerank")
    return pr.join(dt.labels(spark, sf), "id", "left").select("id", "rank", "pagerank", "label")
