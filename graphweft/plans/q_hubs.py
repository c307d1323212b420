"""Registered queries on the dense graph with a hub."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.operators import aggregates as agg
from graphweft.operators import graph as gr
from graphweft.operators import hubs
from graphweft.plans.common import shared
from graphweft.plans.oracle_views import with_views
from graphweft.plans.q_graph import PR_ROUNDS, UV_CTES, long_rounded, pagerank_sql, user_vectors
from graphweft.sources import driver_tables as dt

QUERIES = {}
ORACLES = {}

# Rounds of the unrolled label propagation, more than the longest way in the graph.
CC_SQL_ROUNDS = 12

# ``ax_edges`` of the other queries, with the dense graph in its place.
_HUB_EDGES = """hub_edges AS (
  SELECT CASE WHEN a.o_orderkey % 6 = 1 THEN 'u1' ELSE concat('u', a.o_custkey) END AS source_id,
         CASE WHEN a.o_orderstatus = 'F' THEN 'followers' ELSE 'following' END AS relation,
         CASE WHEN a.o_orderkey % 3 = 0 THEN 'u1' ELSE concat('u', b.o_custkey) END AS target_id
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1),
soc AS MATERIALIZED (SELECT * FROM hub_edges),
verts AS (SELECT id FROM ax_users UNION SELECT source_id FROM soc UNION SELECT target_id FROM soc)"""


def register(name, sql):
    def deco(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn
    return deco


def hub_graph(spark, sf):
    """All users and the dense edges, written once for a session."""
    edges = shared(spark, sf, "hub_edges", lambda: dt.hub_edges(spark, sf))
    return gr.Graph(dt.users(spark, sf).select("id", "label"), edges)


@register("d1_hub_degree", with_views(
    """SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM soc UNION ALL SELECT target_id FROM soc)
       GROUP BY id""", _HUB_EDGES))
def d1(spark, sf):
    return agg.degree(hub_graph(spark, sf).edges)


_CELLS = ", ".join(
    f"CAST(count(*) FILTER (WHERE s.label = '{a}' AND t.label = '{b}') AS BIGINT) AS {a}_{b}"
    for a in agg.LABELS for b in agg.LABELS)


@register("d4_hub_interaction_matrix", with_views(
    f"""SELECT relation, {_CELLS} FROM soc JOIN ax_users s ON s.id = soc.source_id
        JOIN ax_users t ON t.id = soc.target_id GROUP BY relation""", _HUB_EDGES))
def d4(spark, sf):
    return hubs.interaction_matrix(hub_graph(spark, sf).edges, dt.labels(spark, sf))


@register("h1_hub_pagerank_10_rounds", with_views(
    f"SELECT id, round(pr, 8) AS pagerank FROM r{PR_ROUNDS}", pagerank_sql(PR_ROUNDS, ctes=_HUB_EDGES)))
def h1(spark, sf):
    pr = gr.pagerank(hub_graph(spark, sf), max_iter=PR_ROUNDS, tol=None)
    return pr.select("id", F.round("pagerank", 8).alias("pagerank"))


def _components_sql() -> str:
    parts = [_HUB_EDGES,
             """und AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM soc
                UNION SELECT target_id, source_id FROM soc)""",
             "c0 AS MATERIALIZED (SELECT id, id AS component FROM verts)"]
    for i in range(1, CC_SQL_ROUNDS + 1):
        parts.append(f"""c{i} AS MATERIALIZED (SELECT c.id, least(c.component, coalesce(min(n.component), c.component))
                         AS component FROM c{i - 1} c LEFT JOIN und ON und.a = c.id
                         LEFT JOIN c{i - 1} n ON n.id = und.b GROUP BY c.id, c.component)""")
    return ",\n".join(parts)


@register("h4_hub_components", with_views(f"SELECT id, component FROM c{CC_SQL_ROUNDS}", _components_sql()))
def h4(spark, sf):
    return gr.connected_components(hub_graph(spark, sf))


@register("h7_hub_relational_mean", with_views(
    """SELECT s.target_id AS id, s.relation, uv.pos, round(avg(uv.value), 6) AS value
       FROM soc s JOIN uv ON uv.id = s.source_id GROUP BY s.target_id, s.relation, uv.pos""",
    _HUB_EDGES + ",\n" + UV_CTES))
def h7(spark, sf):
    m = hubs.relational_mean(hub_graph(spark, sf).edges, user_vectors(spark, sf))
    return long_rounded(m, ["id", "relation"])
