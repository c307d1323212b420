"""Physical-plan checks: the plan shapes the scale design relies on."""

from graphweft.operators import aggregates as agg
from graphweft.operators import features as ft
from graphweft.operators import graph as gr
from graphweft.operators import relational as rel
from graphweft.operators import sampling as sp
from graphweft.sources import driver_tables as dt
from tests.conftest import SF_SMOKE


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_window_is_limited_before_the_shuffle(spark):
    p = plan(ft.recent_tweets(dt.users(spark, SF_SMOKE), dt.tweets(spark, SF_SMOKE), k=20))
    # one partial limit below the exchange, one final limit above it
    assert p.count("WindowGroupLimit") >= 2


def test_label_join_prunes_the_user_view_to_two_columns(spark):
    p = plan(agg.interaction_matrix(dt.edges(spark, SF_SMOKE), dt.labels(spark, SF_SMOKE)))
    assert "c_custkey:bigint,c_mktsegment:string>" in p


def test_relation_filter_reaches_the_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "edges")
    dt.edges(spark, SF_SMOKE).write.parquet(path)
    p = plan(rel.relation_filter(spark.read.parquet(path), ["following", "followers"]))
    assert "PushedFilters" in p and "In(relation, [followers,following])" in p


def test_rounds_of_louvain_and_components_send_the_driver_no_tables(spark, monkeypatch):
    seen = []

    def recorded(df, write=gr.cut_lineage):
        seen.append(plan(df))
        return write(df)

    edges = spark.createDataFrame([(f"n{k}", "r", f"n{k // 2}") for k in range(40)], "source_id string, relation string, target_id string")
    g = gr.Graph(spark.createDataFrame([(f"n{k}",) for k in range(41)], "id string"), edges)
    monkeypatch.setattr(gr, "cut_lineage", recorded)
    conf = dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.adaptive.enabled")
    assert gr.louvain(g).count() == gr.connected_components(g).count() == 41
    assert sum("Join" in p for p in seen) > 5 and not any("Broadcast" in p for p in seen)
    assert conf == (dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.adaptive.enabled"))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_levels_of_the_snowball_send_the_driver_no_tables(spark, monkeypatch):
    seen = []

    def recorded(df, write=sp.cut_lineage):
        seen.append(plan(df))
        return write(df)

    edges = spark.createDataFrame([(f"n{k}", "following", f"n{k // 2}") for k in range(40)], "source_id string, relation string, target_id string")
    users = spark.createDataFrame([(f"n{k}", "bot" if k % 5 == 0 else "human", k % 4) for k in range(40)], "id string, label string, degree int")
    monkeypatch.setattr(sp, "cut_lineage", recorded)
    sample = sp.snowball(users.where("id = 'n0'").select("id"), users, edges, 30, max_per_node=2)
    assert sample.count() == len({r.id for r in sample.collect()}) > 10
    levels = [p for p in seen if "Window" in p]
    assert len(levels) > 2 and not any("Broadcast" in p for p in levels)


def test_running_sums_of_all_snapshots_keep_vectors_whole(spark):
    edges = spark.createDataFrame([("a", "r", "b", 1), ("b", "r", "a", 2)], "source_id string, relation string, target_id string, first_snapshot int")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "id string, vec array<double>")
    nodes = spark.createDataFrame([("a", 0), ("b", 0)], "id string, first_snapshot int")
    p = plan(gr.relational_sum_changes(edges, vectors, nodes, dim=2))
    # one row for each element only at the very end, above all sorts and shuffles
    assert p.count("Generate posexplode") == 1 and p.index("Generate posexplode") < min(p.index("Sort ["), p.index("Exchange"))
