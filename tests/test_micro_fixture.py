"""Hand-worked answers of the micro-fixture (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphweft.functions import scalar
from graphweft.operators import aggregates as agg
from graphweft.operators import features as ft
from graphweft.operators import graph as gr
from graphweft.operators import ml
from graphweft.operators import relational as rel
from graphweft.operators import sampling as sp
from graphweft.operators import temporal as tp
from tests.conftest import T, as_dict


def social_within_users(micro):
    e = rel.relation_filter(micro["edges"], ["following", "followers"])
    return rel.within(e, micro["users"].select("id"))


def test_d1_degree(micro):
    d = agg.users_with_degree(micro["users"].select("id"), micro["edges"])
    assert as_dict(d, "id", "degree") == {"u1": 4, "u2": 3, "u3": 3, "u4": 1, "u5": 0}


def test_d2_distinct_likes(micro):
    assert as_dict(agg.distinct_likes(micro["edges"]), "id", "like_count") == {"u3": 2}


def test_d3_relation_counts(micro):
    assert as_dict(agg.relation_counts(micro["edges"]), "relation", "n") == {
        "following": 5, "post": 4, "like": 3, "discuss": 2, "followers": 1, "mentioned": 1,
        "membership": 1, "contain": 1}


def test_d4_d5_interaction_matrix(micro):
    m = {r["relation"]: r for r in agg.interaction_matrix(micro["edges"], micro["labels"]).collect()}
    f = m["following"]
    assert (f.human_human, f.human_bot, f.bot_human, f.bot_bot) == (2, 2, 0, 0)
    fo = m["followers"]
    assert (fo.human_human, fo.human_bot, fo.bot_human, fo.bot_bot) == (0, 0, 1, 0)
    n = {r["relation"]: r for r in agg.row_normalised(
        agg.interaction_matrix(micro["edges"], micro["labels"])).collect()}
    assert (n["following"].human_human, n["following"].human_bot) == (0.5, 0.5)
    assert n["following"].bot_human is None and n["following"].bot_bot is None


def test_e1_recent_tweets(micro):
    r = ft.recent_tweets(micro["users"], micro["tweets"], k=1)
    assert as_dict(r, "id", "tweet_id") == {"u1": "t2", "u2": "t3"}


def test_e13_grid_and_d18_counts(micro):
    snap = tp.build_snapshots(micro["users"], micro["tweets"], micro["edges"])
    assert snap.grid.start == T("2020-01-05 10:00:00") and snap.grid.count == 3
    c = [(r.num_users, r.num_tweets, r.num_edges)
         for r in tp.snapshot_counts(snap).orderBy("snapshot_idx").collect()]
    assert c == [(2, 2, 5), (3, 2, 9), (3, 3, 11)]


def test_e15_c10_activation(micro):
    a = tp.edge_activation(micro["edges"], tp.node_times(micro["users"], micro["tweets"]))
    rows = {(r.source_id, r.relation, r.target_id): r.active_from for r in a.collect()}
    assert ("u4", "following", "u9") not in rows
    assert rows[("u2", "followers", "u1")] == T("2020-01-05 10:00:00")


def test_c8_and_h2(micro):
    e = social_within_users(micro)
    assert e.count() == 5
    g = gr.Graph(micro["users"].select("id"), e)
    dc = as_dict(gr.degree_centrality(g), "id", "degree_centrality")
    assert dc == pytest.approx({"u1": 1.0, "u2": 0.75, "u3": 0.75, "u4": 0.0, "u5": 0.0})


def test_h4_components(micro, spark):
    g = gr.Graph(micro["users"].select("id"), social_within_users(micro))
    comps = as_dict(gr.connected_components(g), "id", "component")
    assert comps == {"u1": "u1", "u2": "u1", "u3": "u1", "u4": "u4", "u5": "u5"}
    share = {r["label"]: r["pct_in_largest"] for r in
             gr.largest_component_share(gr.connected_components(g), micro["labels"]).collect()}
    assert share == pytest.approx({"human": 66.6667, "bot": 50.0})


def test_h1_pagerank_fixed_and_converged(micro):
    g = gr.Graph(micro["users"].select("id"), social_within_users(micro))
    pr10 = as_dict(gr.pagerank(g, max_iter=10, tol=None), "id", "pagerank")
    assert pr10 == pytest.approx({"u1": 0.41974611, "u2": 0.41015769, "u3": 0.07918073,
                                  "u4": 0.04545774, "u5": 0.04545774}, abs=1e-8)
    prc = as_dict(gr.pagerank(g), "id", "pagerank")
    assert prc == pytest.approx({"u1": 0.42410107, "u2": 0.40593845, "u3": 0.07905138,
                                 "u4": 0.04545455, "u5": 0.04545455}, abs=1e-7)
    assert sum(prc.values()) == pytest.approx(1.0)


def test_h6_closure_order_free_and_strict(micro, spark):
    U = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "id string")
    c = sp.entity_closure(micro["edges"], U)
    ent = {(r.kind, r.id) for r in c.entities.collect()}
    assert {i for k, i in ent if k == "tweet"} == {"t1", "t2", "t3", "t9"}
    assert {i for k, i in ent if k == "list"} == {"l1"}
    assert {i for k, i in ent if k == "hashtag"} == {"h1", "h2"}
    assert c.edges.count() == 15
    s = sp.entity_closure(micro["edges"], U, strict=True)
    ent = {(r.kind, r.id) for r in s.entities.collect()}
    assert {i for k, i in ent if k == "tweet"} == {"t1", "t2", "t3"}
    assert {i for k, i in ent if k == "hashtag"} == set()
    assert s.edges.count() == 12


def test_h6_closure_independent_of_row_order(micro):
    U = micro["users"].where(F.col("id").isin("u1", "u2", "u3")).select("id")
    a = sp.entity_closure(micro["edges"], U).entities
    b = sp.entity_closure(micro["edges"].orderBy(F.desc("target_id")).repartition(3), U).entities
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_h7_h8_relational(micro, spark):
    x = spark.createDataFrame([("u1", [1.0, 0.0]), ("u2", [0.0, 1.0]), ("u3", [2.0, 2.0]),
                               ("u4", [3.0, 3.0]), ("u5", [5.0, 5.0])], "id string, vec array<double>")
    e = social_within_users(micro).where(F.col("relation") == "following")
    m = {r.id: r.vec for r in gr.relational_mean(e, x).collect()}
    assert m == {"u2": [1.0, 0.0], "u1": [2.0, 2.0], "u3": [2.0, 2.0]}
    s = {r.id: r.vec for r in gr.normalised_relational_sum(e, x).collect()}
    assert s["u3"] == pytest.approx([0.5 * 1.0 + 0.5 * 2.0, 0.5 * 0.0 + 0.5 * 2.0])
    assert s["u1"] == pytest.approx([0.0, 0.0])


def test_d20_class_weights(micro):
    y = micro["users"].select(F.when(F.col("label") == "bot", 1).otherwise(0).alias("y"))
    w = agg.class_weights(y).first()
    assert (w.w_bot, w.w_human) == pytest.approx((0.6, 0.4))


def test_g3_floored_days(spark):
    df = spark.createDataFrame([(T("2020-09-05 01:00:00"),), (None,)], "c timestamp")
    assert [r[0] for r in df.select(scalar.account_age_days(F.col("c"))).collect()] == [-1, 0]


def test_d17_zscore(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    z = [r.x_z for r in ft.zscore(df, ["x"]).orderBy("x").collect()]
    assert z == pytest.approx([-1, 0, 1], abs=1e-6)


def test_e5_qcut_with_ties(spark):
    vals = [1, 1, 1, 1, 2, 3]
    base = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(str(i), base + dt.timedelta(seconds=v)) for i, v in enumerate(vals)],
                               "id string, created_at timestamp")
    b = [r.time_bin for r in sp.time_bins(df, q=4).orderBy("id").collect()]
    assert b == [0, 0, 0, 0, 1, 1]


def test_d11_year_histogram(spark):
    df = spark.createDataFrame([(dt.datetime(2000 + y, 6, 1),) for y in range(5)], "t timestamp")
    h = {r.bin_start: r.n for r in agg.year_histogram(df, "t", 2000, 2003).collect()}
    assert h == {2000: 1, 2001: 2}


def test_i9_i10_metrics(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 0], [1, 0, 0, 0, 1])), "y int, pred int")
    m = ml.selection_score(ml.binary_metrics(df)).first()
    assert (m.accuracy, m.f1_bot, m.f1_macro, m.score) == pytest.approx((0.6, 0.5, 0.583333, 0.525), abs=1e-6)
