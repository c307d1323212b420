"""Invariants on the driver's smallest tables (sf0.001) and the entry contract."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphweft.operators import graph as gr
from graphweft.operators import ml
from graphweft.operators import sampling as sp
from graphweft.operators import temporal as tp
from graphweft.operators.ordering import dense_index
from graphweft.sources import driver_tables as dt
from tests.conftest import SF_SMOKE


def test_entry_contract(spark):
    import __spark_entry__ as ent
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["relation", "human_human", "human_bot", "bot_human", "bot_bot"]
    assert set(ent.oracle_sql()) <= set(ent.queries())


def test_fixture_golden_counts(spark):
    e = dt.edges(spark, SF_SMOKE)
    counts = {r["relation"]: r["count"] for r in e.groupBy("relation").count().collect()}
    assert counts["following"] == 95 and counts["followers"] == 52
    assert counts["post"] == 1500 and counts["like"] == 208
    assert counts["membership"] == 58 and counts["contain"] == 57 and counts["discuss"] == 200
    u = dt.users(spark, SF_SMOKE)
    assert u.count() == 150 and u.where("label = 'bot'").count() == 30


def test_snapshot_counts_monotone_and_golden(spark):
    snap = tp.build_snapshots(dt.users(spark, SF_SMOKE), dt.tweets(spark, SF_SMOKE), dt.edges(spark, SF_SMOKE))
    c = tp.snapshot_counts(snap).orderBy("snapshot_idx").collect()
    assert len(c) == 344
    for a, b in zip(c, c[1:]):
        assert a.num_users <= b.num_users and a.num_tweets <= b.num_tweets and a.num_edges <= b.num_edges
    assert (c[100].num_users, c[100].num_tweets, c[100].num_edges) == (146, 445, 647)
    assert (c[343].num_users, c[343].num_tweets, c[343].num_edges) == (150, 1496, 1851)


def test_components_golden(spark):
    users = dt.users(spark, SF_SMOKE)
    e = dt.edges(spark, SF_SMOKE).where(F.col("relation").isin("following", "followers"))
    comps = gr.connected_components(gr.Graph(users.select("id"), e))
    sizes = [r["size"] for r in gr.component_sizes(comps).collect()]
    assert len(sizes) == 24 and max(sizes) == 116 and sizes.count(1) == 18


def test_pagerank_sums_to_one(spark):
    users = dt.users(spark, SF_SMOKE)
    e = dt.edges(spark, SF_SMOKE).where(F.col("relation").isin("following", "followers"))
    pr = gr.pagerank(gr.Graph(users.select("id"), e))
    assert pr.agg(F.sum("pagerank")).first()[0] == pytest.approx(1.0, abs=1e-9)


def test_snowball_invariants(spark):
    e = dt.edges(spark, SF_SMOKE)
    pop = sp.population(dt.users(spark, SF_SMOKE), e)
    target = 140
    seeds = sp.select_seeds(pop, target, seed_ratio=0.6)
    sample = sp.snowball(seeds, pop, e, target, bot_ratio=0.2)
    ids = {r.id for r in sample.collect()}
    seed_ids = {r.id for r in seeds.collect()}
    assert seed_ids and seed_ids < ids and len(ids) <= target
    adj = sp.undirected_adjacency(e).collect()
    nbrs = {}
    for r in adj:
        nbrs.setdefault(r.b, set()).add(r.a)
    for r in sample.where("level > 0").collect():
        assert nbrs.get(r.id, set()) & ids, r.id
    per_level = {}
    for r in sample.collect():
        per_level.setdefault(r.level, []).append(r.id)
    for lv, members in per_level.items():
        if lv == 0:
            continue
        prev = set(per_level.get(lv - 1, []))
        assert len(members) <= 5 * len(prev)


def _label_propagation(nodes, pairs):
    """Plain sequential label propagation: the most frequent label of the neighbours, ties to
    the smallest, until a sweep changes nothing."""
    near = {n: [] for n in nodes}
    for a, b in pairs:
        if a != b:
            near[a].append(b)
            near[b].append(a)
    label = {n: n for n in nodes}
    for _ in range(50):
        before = dict(label)
        for n in sorted(nodes):
            if near[n]:
                count = {}
                for o in near[n]:
                    count[label[o]] = count.get(label[o], 0) + 1
                label[n] = min(count, key=lambda c: (-count[c], c))
        if label == before:
            break
    return label


def test_louvain_is_a_cover_and_beats_other_partitions(spark):
    users = dt.users(spark, SF_SMOKE)
    e = dt.edges(spark, SF_SMOKE).where(F.col("relation").isin("following", "followers"))
    g = gr.Graph(users.select("id"), e)
    comm = gr.louvain(g)
    rows = comm.collect()
    assert len(rows) == len({r.id for r in rows}) == g.all_vertices.count()
    ew = gr.weighted_edges(e)
    q = gr.modularity(ew, comm)
    q0 = gr.modularity(ew, g.all_vertices.select("id", F.col("id").alias("community")))
    comps = gr.connected_components(g).withColumnRenamed("component", "community")
    label = _label_propagation([r.id for r in rows], [(r.source_id, r.target_id) for r in e.collect()])
    spread = spark.createDataFrame(list(label.items()), "id string, community string")
    assert q > q0 and q > 0.3
    assert q >= gr.modularity(ew, comps) - 1e-9 and q >= gr.modularity(ew, spread) - 1e-9


def test_splits_disjoint_and_complete(spark):
    users = dt.users(spark, SF_SMOKE).select("id")
    nodes = users.withColumn("in_test", F.col("id").endswith("7"))
    s = ml.static_split(nodes).collect()
    assert len(s) == 150 and len({r.id for r in s}) == 150
    n_rest = sum(1 for r in s if r.split != "test")
    assert sum(1 for r in s if r.split == "val") == int(0.1 * n_rest)
    mem = users.select(F.lit(0).cast("bigint").alias("snapshot_idx"), "id").unionByName(
        users.where(F.col("id") < "u5").select(F.lit(1).cast("bigint").alias("snapshot_idx"), "id"))
    sp_rows = ml.snapshot_split(mem).collect()
    for snap in (0, 1):
        rows = [r for r in sp_rows if r.snapshot_idx == snap]
        n = len(rows)
        assert sum(r.split == "val" for r in rows) == round(0.2 * n)
        assert sum(r.split == "test" for r in rows) == round(0.2 * n)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=50), min_size=1, max_size=40))
def test_dense_index_is_a_permutation(spark, values):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "id string, v int")
    out = dense_index(df, [F.col("v"), F.col("id")], num_partitions=3).collect()
    idx = sorted(r.idx for r in out)
    assert idx == list(range(len(values)))
    order = [r.id for r in sorted(out, key=lambda r: r.idx)]
    assert order == [str(i) for i, _ in sorted(enumerate(values), key=lambda t: (t[1], str(t[0])))]


def test_rank_within_matches_sort(spark):
    from graphweft.functions.random import uniform
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("g"))
    r = ml.rank_within(df, ["g"], uniform(F.col("id"), 7), buckets=16).collect()
    keyed = df.select("id", "g", uniform(F.col("id"), 7).alias("k")).collect()
    for g in range(3):
        expect = [x.id for x in sorted((x for x in keyed if x.g == g), key=lambda x: (x.k, x.id))]
        got = [x.id for x in sorted((x for x in r if x.g == g), key=lambda x: x.rank)]
        assert got == expect


def test_relational_sum_changes_match_brute_force_in_every_snapshot(spark):
    import random
    from collections import Counter

    from graphweft.operators import graph as gr
    rng = random.Random(11)
    born = {f"n{k}": rng.randrange(3) for k in range(8)}
    vecs = {n: [rng.random(), rng.random()] for n in born}
    edges = [(f"n{rng.randrange(6)}", rng.choice("ab"), f"n{rng.randrange(8)}", rng.randrange(3, 9)) for _ in range(40)]
    got = gr.relational_sum_changes(
        spark.createDataFrame(edges, "source_id string, relation string, target_id string, first_snapshot int"),
        spark.createDataFrame(list(vecs.items()), "id string, vec array<double>"),
        spark.createDataFrame(list(born.items()), "id string, first_snapshot int"), dim=2).collect()
    assert len(got) == len({(r.id, r.snapshot_idx, r.pos) for r in got})
    for i in range(10):
        seen = [e for e in edges if e[3] <= i]
        d = Counter((e[0], e[1]) for e in seen)
        want = {(n, p): vecs[n][p] for n in born if born[n] <= i for p in (0, 1)}
        for row, rel, col, _ in seen:
            for p in (0, 1):
                w = d[row, rel] ** -0.5 * (d[col, rel] ** -0.5 if d[col, rel] else 0)
                want[row, p] += w * vecs[col][p]
        last = {(r.id, r.pos): r.value for r in sorted(got, key=lambda r: r.snapshot_idx) if r.snapshot_idx <= i}
        assert last.keys() == want.keys() and all(abs(last[k] - want[k]) < 1e-9 for k in want)
