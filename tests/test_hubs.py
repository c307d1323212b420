"""The vertex cut: same rows as the plain operators, bounded copies, no hot task."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ent
from graphweft.operators import aggregates as agg
from graphweft.operators import graph as gr
from graphweft.operators import hubs
from graphweft.plans import q_hubs
from graphweft.sources import driver_tables as dt
from graphweft.sources.driver_tables import TABLES
from tests.conftest import SF_SMOKE
from tests.test_plans import plan
from tools.compare import canon

EDGES = "source_id string, relation string, target_id string"


def hub_rows(n=600, seed=3):
    """Half of all edges come from ``a``, a third lead to it, some are parallel or have null ends."""
    rng = random.Random(seed)
    rows = [("a" if k % 2 else f"n{rng.randrange(40)}", rng.choice(["following", "followers"]),
             "a" if k % 3 == 0 else f"n{rng.randrange(60)}") for k in range(n)]
    return [*rows, *rows[:50], (None, "following", "n1"), ("n1", "following", None), ("lone", "followers", "n2")]


def vectors(m):
    return {(r.id, r.relation): [round(x, 9) for x in r.vec] for r in m.collect()}


@pytest.mark.parametrize("tasks", [1, 8, 300])
def test_mean_with_a_cut_is_the_plain_mean(spark, tasks):
    edges = spark.createDataFrame(hub_rows(), EDGES)
    x = spark.createDataFrame([(f"n{k}", [float(k), 1.0, -k / 7]) for k in range(50)] + [("a", [5.0, 2.0, 1.0]), ("lone", [0.0, 0.0, 3.0])],
                              "id string, vec array<double>")
    plain = vectors(gr.relational_mean(edges, x))
    assert vectors(hubs.relational_mean(edges, x, tasks=tasks)) == plain and len(plain) > 100


def test_matrix_with_a_cut_is_the_plain_matrix(spark):
    edges = spark.createDataFrame(hub_rows(), EDGES)
    labels = spark.createDataFrame([(f"n{k}", "bot" if k % 3 else "human") for k in range(55)] + [("a", "bot")], "id string, label string")
    plain = sorted(agg.interaction_matrix(edges, labels).collect())
    assert sorted(hubs.interaction_matrix(edges, labels, tasks=16).collect()) == plain and len(plain) == 2


def test_no_edges_no_rows(spark):
    edges = spark.createDataFrame([], EDGES)
    assert hubs.hot_nodes(edges, "source_id", 8).count() == 0
    x = spark.createDataFrame([("a", [1.0])], "id string, vec array<double>")
    assert hubs.relational_mean(edges, x, tasks=8).count() == 0


def test_hot_nodes_are_few_and_their_copies_take_fair_shares(spark):
    tasks = 32
    edges = hubs.collapse(q_hubs.hub_graph(spark, SF_SMOKE).edges)
    total = edges.count()
    hot = hubs.hot_nodes(edges, "source_id", tasks)
    copies = {r.source_id: r._copies for r in hot.collect()}
    assert "u1" in copies and copies["u1"] > 2 and len(copies) <= tasks // 2 and sum(copies.values()) <= 2 * tasks
    dealt = hubs.deal(edges, hot, "source_id", ["relation", "target_id"]).groupBy("source_id", "_copy").count()
    largest = dealt.where("source_id = 'u1'").agg({"count": "max"}).first()[0]
    uncut = edges.where("source_id = 'u1'").count()
    assert uncut > 2 * total / tasks and largest <= 2 * total / tasks


def test_pagerank_keeps_its_edges_in_place(spark):
    """A round's join meets the cached edges without another exchange of theirs."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = hubs.collapse(spark.createDataFrame(hub_rows(), EDGES)).select("source_id", "target_id", F.col("n").alias("w"))
    trans = gr._dealt_by_source(w, F.broadcast(hubs.hot_nodes(w, "source_id", tasks)), tasks).persist()
    trans.count()
    sent = hubs.copies_of(spark.range(60).select(F.concat(F.lit("n"), "id").alias("id"), F.lit(None).cast("int").alias("_copies"),
                                                 F.lit(1.0).alias("_s")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(trans.join(sent, ["id", "_copy"])).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        trans.unpersist()
    depth = next(x.index("InMemoryRelation") for x in lines if "InMemoryRelation" in x)
    outside = [x for x in lines if "Exchange hashpartitioning" in x and x.index("Exchange") <= depth]
    assert len(outside) == 1 and any("SortMergeJoin" in x for x in lines)


@pytest.mark.parametrize("interval", [1, 2, 5])
def test_pagerank_is_that_of_a_plain_loop(spark, interval):
    """Hot, dangling and isolated nodes, parallel edges, self-loops; any number of rounds between written tables."""
    rows = [*[r for r in hub_rows(200) if r[0] and r[2]], ("a", "following", "a"), ("n1", "following", "sink")]
    vertices = sorted({x for r in rows for x in (r[0], r[2])} | {"alone"})
    out = Counter(r[0] for r in rows)
    rank = {v: 1 / len(vertices) for v in vertices}
    for _ in range(7):
        lost = sum(rank[v] for v in vertices if not out[v])
        new = {v: 0.15 / len(vertices) + 0.85 * lost / len(vertices) for v in vertices}
        for s, _, t in rows:
            new[t] += 0.85 * rank[s] / out[s]
        rank = new
    g = gr.Graph(spark.createDataFrame([("alone",)], "id string"), spark.createDataFrame(rows, EDGES))
    got = {r.id: r.pagerank for r in gr.pagerank(g, max_iter=7, tol=None, checkpoint_interval=interval).collect()}
    assert got.keys() == rank.keys() and all(abs(got[v] - rank[v]) < 1e-12 for v in rank)


def test_clashing_columns_of_edges_stay(spark):
    edges = spark.createDataFrame([(r[0], r[1], r[2], 7, "x") for r in hub_rows()], EDGES + ", copies int, label string")
    nodes = spark.createDataFrame([("a", 1.0), ("n1", 2.0)], "source_id string, weight double")
    got = hubs.join_nodes(edges, nodes, "source_id", ["relation", "target_id"], tasks=8)
    assert set(got.columns) == {"source_id", "relation", "target_id", "copies", "label", "weight"}
    assert got.count() == sum(r[0] in ("a", "n1") for r in hub_rows())


def test_the_hub_stands_on_half_of_the_edges(spark):
    edges = dt.hub_edges(spark, SF_SMOKE)
    assert edges.where("source_id = 'u1' or target_id = 'u1'").count() >= 0.45 * edges.count()


@pytest.mark.parametrize("name", sorted(q_hubs.QUERIES))
def test_query_matches_oracle(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    df = ent.queries()[name](spark, SF_SMOKE)
    res = duck.execute(ent.oracle_sql()[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in res.description], res.fetchall())


def test_pagerank_rounds_run_on_as_many_partitions_as_the_graph_fills(spark, micro, monkeypatch):
    seen, deal = [], gr._dealt_by_source

    def dealt(w, hot, tasks):
        seen.append(tasks)
        return deal(w, hot, tasks)

    monkeypatch.setattr(gr, "_dealt_by_source", dealt)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    g = gr.build_graph(micro["users"], micro["edges"], ["following", "followers"])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        one = {r.id: r.pagerank for r in gr.pagerank(g, max_iter=3, tol=None).collect()}
        assert seen == [1] and spark.conf.get("spark.sql.shuffle.partitions") == "40"
        monkeypatch.setattr(gr, "ROWS_PER_TASK", 1)
        many = {r.id: r.pagerank for r in gr.pagerank(g, max_iter=3, tol=None).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[1] > 1 and many == pytest.approx(one)
