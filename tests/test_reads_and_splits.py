"""As-of reads, change rows of all snapshots, splits, JSON arrays, tables with an index, the run
log and hubs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.operators import aggregates as agg
from graphweft.operators import features as ft
from graphweft.operators import graph as gr
from graphweft.operators import ml
from graphweft.operators import temporal as tp
from graphweft.plans import q_io
from graphweft.session import cut_lineage, release, scratch_path
from graphweft.sources import driver_tables as dt
from graphweft.sources import files, sinks

SF_SMOKE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cut_lineage_gives_a_scan_and_release_deletes_it(spark):
    df = spark.range(10).groupBy((F.col("id") % 3).alias("k")).agg(F.sum("id").alias("s"))
    cut = cut_lineage(df)
    assert "Exchange" not in plan(cut) and sorted(cut.collect()) == sorted(df.collect())
    path = cut.scratch_table
    release(cut, df, None)
    assert not files.path_exists(spark, path)


def test_as_of_is_the_last_change_at_or_before(spark):
    rng = random.Random(4)
    changes = [(f"u{k % 7}", s, float(rng.randrange(99))) for k, s in enumerate(rng.sample(range(40), 30))]
    asked = [(f"u{rng.randrange(9)}", rng.randrange(-2, 44)) for _ in range(200)]
    got = ft.as_of(spark.createDataFrame(changes, "id string, snapshot_idx int, x double"),
                   spark.createDataFrame(asked, "id string, snapshot_idx bigint")).collect()
    want = {(u, s): max(((t, x) for v, t, x in changes if v == u and t <= s), default=(0, None))[1] for u, s in asked}
    assert {(r.id, r.snapshot_idx): r.x for r in got} == want and len(got) == len(want)


def test_normalised_sums_of_all_snapshots_are_those_of_each(spark):
    snap = tp.build_snapshots(dt.users(spark, SF_SMOKE), dt.tweets(spark, SF_SMOKE), dt.edges(spark, SF_SMOKE))
    edges = snap.edges.where(F.col("relation").isin(list(dt.SOCIAL_RELATIONS)))
    vectors = cut_lineage(snap.users.select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(7)).cast("double") for k in (1, 2)]).alias("vec")))
    changes = cut_lineage(gr.relational_sum_changes(edges, vectors, snap.users, dim=2))
    for i in (60, 150, snap.grid.count - 1):
        nodes = snap.users.where(F.col("first_snapshot") <= i).select(F.lit(i).alias("snapshot_idx"), "id").join(vectors, "id")
        e = edges.where(F.col("first_snapshot") <= i).select(F.lit(i).alias("snapshot_idx"), "source_id", "relation", "target_id")
        own = gr.with_own_term(gr.normalised_relational_sum(e, vectors, keys=["snapshot_idx"]), nodes, keys=["snapshot_idx"])
        want = {(r.id, p): v for r in own.collect() for p, v in enumerate(r.vec)}
        last = changes.where(F.col("snapshot_idx") <= i).groupBy("id", "pos").agg(F.max_by("value", "snapshot_idx").alias("value"))
        got = {(r.id, r.pos): r.value for r in last.collect()}
        assert want.keys() <= got.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_split_by_boundary_selection_is_that_of_ranks(spark):
    rows = [(s, f"u{k}") for s, n in ((0, 1), (1, 2), (2, 7), (3, 500)) for k in range(n)]
    members = spark.createDataFrame(rows, "snapshot_idx bigint, id string")
    key = ml.uniform(F.concat_ws(":", F.col("snapshot_idx").cast("string"), F.col("id")), 42)
    for buckets in (1, 4, 256):
        got = {(r.snapshot_idx, r.id): r.split for r in ml.snapshot_split(members, buckets=buckets).collect()}
        assert len(got) == len(rows)
        for s, n in ((0, 1), (1, 2), (2, 7), (3, 500)):
            order = [r.id for r in members.where(F.col("snapshot_idx") == s).orderBy(key, "id").collect()]
            cut = round(0.2 * n)
            assert [got[s, u] for u in order] == ["val"] * cut + ["test"] * cut + ["train"] * (n - 2 * cut)


def test_sequence_evaluation_averages_snapshots_and_sequences(spark):
    rows = [(0, 1, 2.0), (0, 0, -1.0), (1, 1, -0.5), (2, 0, 0.0)]
    seq = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "snapshot_idx bigint, sequence_id int")
    got = ml.sequence_evaluation(spark.createDataFrame(rows, "snapshot_idx bigint, y int, logit double"), seq).first()
    ce = [(0.126928 + 0.313262) / 2, 0.974077, 0.693147]
    assert got.loss == pytest.approx(((ce[0] + ce[1]) / 2 + ce[2]) / 2, abs=1e-5)
    assert got.accuracy == pytest.approx(((1 + 0) / 2 + 1) / 2) and got.f1_bot == pytest.approx((0.5 + 0) / 2)


def test_json_arrays_are_read_in_splits(spark):
    rows = [(f"u{k}", f'a "quoted" [text], {{k}} \n line {k}', [k, k + 1]) for k in range(3000)]
    df = spark.createDataFrame(rows, "id string, t string, n array<int>")
    path = scratch_path(spark, "json-array-splits")
    sinks.write_json_array(df.coalesce(1), path)
    part = next(p for p in df.sparkSession.read.text(path).inputFiles())
    assert json.loads(open(part.removeprefix("file:")).read())[7]["t"] == rows[7][1]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = files.read_json_array(spark, path, df.schema)
        assert got.rdd.getNumPartitions() > 3
        assert sorted(tuple(r) for r in got.drop(files.FILE).collect()) == sorted(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    sinks.write_json_array(df.limit(0), path)
    assert files.read_json_array(spark, path, df.schema).count() == 0


def test_json_arrays_of_other_layouts_are_read_whole(spark, tmp_path):
    rows = [{"id": "a", "n": {"x": 1}}, {"id": "b], [", "n": {"x": 2}}]
    for k, layout in enumerate((json.dumps(rows), json.dumps(rows, indent=2), "[\n" + ",\n".join(map(json.dumps, rows)) + "\n]\n")):
        (tmp_path / f"{k}.json").write_text(layout)
        schema = files.T.StructType.fromDDL("id string, n struct<x: int>")
        got = files.read_json_array(spark, str(tmp_path / f"{k}.json"), schema).collect()
        assert sorted((r.id, r.n.x) for r in got) == [("a", 1), ("b], [", 2)]


def test_tables_with_an_index_join_without_a_shuffle(spark):
    users, edges = q_io.indexed_users_and_edges(spark, SF_SMOKE)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = users.join(edges, "id").groupBy("id", "label").count()
        joined.collect()
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_change_rows_keep_vectors_whole(spark, micro):
    """Running means take no vector apart, and as-of reads need no aggregate of the requests."""
    snap = tp.build_snapshots(micro["users"], micro["tweets"], micro["edges"])
    vecs = micro["tweets"].select("id", F.array(F.lit(1.0), F.unix_micros("created_at") % 7).alias("vec"))
    changes = ft.posted_vector_changes(snap, vecs)
    assert "Generate" not in plan(changes)
    asked = snap.users.select("id", F.lit(3).alias("snapshot_idx"))
    both = ft.as_of(cut_lineage(changes), cut_lineage(asked.unionByName(asked)))
    assert "Aggregate" not in plan(both) and both.count() == asked.count()


def test_text_is_embedded_in_its_row(spark):
    df = dt.table(spark, SF_SMOKE, "documents").select("doc_id", "text")
    assert "Exchange" not in plan(text.hashing_embed(df, "doc_id", "text"))


def test_run_log_keeps_corrupt_entries_apart(spark):
    path = scratch_path(spark, "run-log-test")
    for k in range(3):
        sinks.append_run_log(spark, path, f"v{k}", {"k": k, "name": "x"})
    spark.createDataFrame([("not json",), ('{"config": {}}',), ("",)], "value string").write.mode("append").text(path)
    good, corrupt = sinks.read_run_log(spark, path)
    assert sorted((r.version_name, r.config["k"]) for r in good.collect()) == [("v0", "0"), ("v1", "1"), ("v2", "2")]
    assert sorted(r.entry for r in corrupt.collect()) == ["not json", '{"config": {}}']


def test_classifier_reads_written_rows(spark):
    """Fits, validation and scoring read one written table, not the joins behind it."""
    rows = [(f"u{k}", [float(k % 3), float(k % 2)], k % 2, "val" if k % 5 == 0 else "train") for k in range(40)]
    df = spark.createDataFrame(rows, "id string, features array<double>, y int, split string")
    scored, metrics = ml.train_and_score(df.select("id", "features"), df.select("id", "y"), df.select("id", "split"), grid=[{"reg": 0.1}])
    assert "Join" not in plan(scored) and "Exchange" not in plan(scored)
    assert scored.count() == 40 and all(r.prediction == r.y for r in scored.collect()) and metrics.count() == 1
