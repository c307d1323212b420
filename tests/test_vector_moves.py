"""How often whole vectors are exchanged, as-of reads of ranges and the tables they start from."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ent
from graphweft.functions import vectors as vec
from graphweft.operators import features as ft
from graphweft.operators import temporal as tp
from graphweft.session import _set, cut_lineage, cut_parts, release, spent_shuffles
from graphweft.sources import driver_tables as dt
from graphweft.sources import files

SF_SMOKE = "/root/testdata/sf0.001"


def vector_exchanges(df):
    """Number of exchanges in a plan whose rows hold a vector."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        types = [node.output().apply(i).dataType().typeName() for i in range(node.output().size())]
        # node names: Exchange is the shuffle, BroadcastExchange the other
        found += node.nodeName() == "Exchange" and any(t == "array" or "vec" in t.lower() for t in types)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.fixture
def no_broadcast(spark):
    """Joins by exchange as of large tables; only broadcasts that are asked for are left."""
    with _set(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        yield


def test_vectors_as_of_exchange_vectors_once(spark, no_broadcast):
    assert vector_exchanges(ent.queries()["i3_vectors_as_of"](spark, SF_SMOKE)) == 1


def test_tweet_vectors_are_the_same_by_broadcast_and_by_exchange(spark, monkeypatch):
    dealt = dt.tweet_vectors(spark, SF_SMOKE)
    monkeypatch.setattr(dt, "BROADCAST_NUMBERS", 0)
    other = dt.tweet_vectors(spark, SF_SMOKE)
    assert dealt.schema == other.schema and vector_exchanges(dealt) == 0
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, other.collect()))


def test_running_mean_exchanges_vectors_in_their_type(spark):
    df = spark.createDataFrame([("a", 2, [1.0, 3.0]), ("a", 1, [3.0, 1.0]), ("a", 2, [2.0, 2.0]), ("b", 1, [5.0, 5.0])],
                               "id string, at bigint, vec array<float>")
    mean = vec.running_mean(df, ["id"], "at", "vec")
    plan = mean._jdf.queryExecution().executedPlan().toString().splitlines()
    assert [k for k, line in enumerate(plan) if "UDF(cast(vec" in line] < [k for k, line in enumerate(plan) if "Exchange" in line]
    assert sorted(map(tuple, mean.collect())) == [("a", 1, [3.0, 1.0]), ("a", 2, [2.0, 2.0]), ("b", 1, [5.0, 5.0])]


def test_as_of_ranges_answer_each_number_once(spark):
    rng = random.Random(7)
    changes = [(f"u{k % 7}", s, float(rng.randrange(99))) for k, s in enumerate(rng.sample(range(40), 30))]
    asked = []
    for _ in range(40):  # of one, of many, before the first change, without a change, overlapping, empty
        lo = rng.randrange(-5, 44)
        asked.append((f"u{rng.randrange(9)}", lo, lo + rng.randrange(-1, 12)))
    got = ft.as_of_ranges(spark.createDataFrame(changes, "id string, snapshot_idx bigint, x double"),
                          spark.createDataFrame(asked, "id string, snapshot_idx int, upto bigint"))
    got = [(r.id, r.snapshot_idx, r.x) for r in tp.each(got).collect()]
    want = {(u, s): max(((t, x) for v, t, x in changes if v == u and t <= s), default=(0, None))[1]
            for u, lo, hi in asked for s in range(lo, hi + 1)}
    assert {(u, s): x for u, s, x in got} == want and len(got) == len(want)


def test_memberships_in_ranges_are_those_of_each_snapshot(spark, micro):
    snap = tp.build_snapshots(micro["users"], micro["tweets"], micro["edges"])
    for wanted in ([], [0], [0, 1, 3], list(range(snap.grid.count))):
        ids = spark.createDataFrame([(i,) for i in wanted], "snapshot_idx bigint")
        each = tp.each(tp.memberships(snap, ids, ranges=True))
        assert sorted(map(tuple, each.select("snapshot_idx", "id").collect())) == sorted(map(tuple, tp.memberships(snap, ids).collect()))


def test_temporal_user_vectors_exchange_each_vector_once(spark, no_broadcast):
    # the posts' vectors by user, and the written static vectors; the union of change rows did so again
    assert vector_exchanges(ent.queries()["i3_temporal_user_vectors"](spark, SF_SMOKE)) == 2


def test_recent_tweet_vectors_are_exchanged_once(spark, no_broadcast):
    pooled = ft.recent_tweet_vector(dt.users(spark, SF_SMOKE), dt.tweets(spark, SF_SMOKE), dt.tweet_vectors(spark, SF_SMOKE), dim=64)
    assert vector_exchanges(pooled) == 1


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def left_over(spark, before, seconds=20):
    """Shuffle files that were not there before and are not deleted in some time."""
    until = time.time() + seconds
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    return shuffle_files(spark) - before


def test_shuffles_of_a_written_table_are_deleted(spark):
    before = shuffle_files(spark)
    with spent_shuffles(spark):
        table = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not left_over(spark, before) and table.count() == 7


def test_temporal_user_vectors_start_with_what_is_known(spark):
    first = spark.createDataFrame([("u1", 3), ("u2", 0), ("u3", 5)], "id string, first_snapshot int")
    posts = [("u1", "t1", 1), ("u1", "t2", 3), ("u1", "t3", 6), ("u2", "t4", 0), ("u2", "t5", 0), ("u2", "t6", 4)]
    edges = spark.createDataFrame([(u, "post", t, s) for u, t, s in posts], "source_id string, relation string, target_id string, first_snapshot int")
    x = {f"t{k}": [float(k), float(-k * k), 1.0] for k in range(1, 7)}
    tv = spark.createDataFrame(list(x.items()), "id string, vec array<float>")
    static = spark.createDataFrame([(f"u{k}", [float(k)]) for k in (1, 2, 3)], "id string, vec array<double>")
    got = ft.temporal_user_vectors(tp.Snapshots(tp.WeeklyGrid(0, 9), first, None, edges), static, tv, tweet_dim=8).collect()
    w, b = ft.projection_weights("tweet_proj", 3, 2)
    y = {t: np.where((v := w @ np.array(x[t]) + b) > 0, v, 0.01 * v) for t in x}
    want = {("u1", 3): ["t1", "t2"], ("u1", 6): ["t1", "t2", "t3"], ("u2", 0): ["t4", "t5"], ("u2", 4): ["t4", "t5", "t6"], ("u3", 5): []}
    assert sorted((r.id, r.snapshot_idx) for r in got) == sorted(want)
    for r in got:
        mean = np.mean([y[t] for t in want[r.id, r.snapshot_idx]], axis=0) if want[r.id, r.snapshot_idx] else np.zeros(2)
        assert r.vec[0] == float(r.id[1]) and np.allclose(r.vec[1:], mean, atol=1e-9)


def test_stored_vectors_leave_no_shuffles_behind(spark):
    # a store in the making lay beside the vectors of all posts, dealt twice
    before = shuffle_files(spark)
    stored = ent.queries()["a21_a22_partitioned_outputs"](spark, SF_SMOKE)
    assert not left_over(spark, before) and stored.count() > 0


def test_cut_parts_share_no_keys_and_are_released_alone(spark):
    df = spark.range(100).select((F.col("id") % 20).cast("string").alias("k"), "id")
    parts = cut_parts(df, ["k"], 4, 1)
    keys = [{r.k for r in p.collect()} for p in parts]
    assert len(parts) == 4 and sum(map(len, keys)) == len(set().union(*keys)) == 20
    assert sorted(r.id for p in parts for r in p.collect()) == list(range(100))
    places = [p.scratch_table for p in parts]
    release(parts[0])
    assert not any(files.path_exists(spark, p) for p in places[0]) and all(files.path_exists(spark, p) for p in places[1] + places[2] + places[3])
    assert len(cut_parts(df, ["k"], 4, 100)) == 1 and sum(p.count() for p in cut_parts(df, ["k"], 4, 40)) == 100
    none = cut_parts(df.limit(0), ["k"], 4, 1)
    assert len(none) == 1 and none[0].dtypes == df.dtypes and none[0].count() == 0


def test_changes_in_turns_are_those_of_all_users(spark):
    snap = tp.build_snapshots(dt.users(spark, SF_SMOKE), dt.tweets(spark, SF_SMOKE), dt.edges(spark, SF_SMOKE))
    tv = dt.tweet_vectors(spark, SF_SMOKE)

    def rows(df):
        return [(r.id, r.snapshot_idx, tuple(round(x, 9) for x in r.vec)) for r in df.collect()]
    turns = [rows(ch) for ch in ft.posted_vector_changes_in_turns(snap, tv, turns=3, rows=1)]
    assert len(turns) == 3 and sorted(sum(turns, [])) == sorted(rows(ft.posted_vector_changes(snap, tv)))
    users = [{id for id, _, _ in t} for t in turns]
    assert sum(map(len, users)) == len(set().union(*users))
