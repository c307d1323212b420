"""Answers on input that the tables do not hold."""

import math

import pytest
from pyspark.sql import functions as F

from graphweft.functions import scalar
from graphweft.operators import aggregates as agg
from graphweft.operators import graph as gr
from graphweft.operators import ml
from graphweft.operators import relational as rel


def test_macro_f1_over_classes_that_occur(spark):
    rows = [("only human", 0, 0)] * 3 + [("both", 1, 1), ("both", 0, 1), ("both", 0, 0)]
    got = {r.g: r for r in ml.binary_metrics(spark.createDataFrame(rows, "g string, y int, pred int"), ["g"]).collect()}
    assert got["only human"].f1_macro == 1.0 and got["only human"].f1_bot == 0.0
    assert got["both"].f1_macro == pytest.approx((2 / 3 + 2 / 3) / 2)


def test_loss_of_wrong_certainty(spark):
    df = spark.createDataFrame([(1, 0.0, -800.0), (1, 0.5, 0.0)], "y int, p_bot double, z double")
    assert ml.weighted_cross_entropy(df).first().loss == math.inf
    assert ml.weighted_cross_entropy(df, logit="z").first().loss == pytest.approx((800 + math.log(2)) / 2)


def test_last_label_wins(spark):
    labels = spark.createDataFrame([("u1", "human", 1), ("u1", "bot", 2), ("u2", "human", 5)], "id string, label string, line int")
    users = labels.select("id").distinct()
    for order in ("line", None):
        rows = labels.coalesce(1) if order is None else labels
        got = {r.id: r.label for r in rel.users_with_labels(users, rows if order else rows.drop("line"), order).collect()}
        assert got == {"u1": "bot", "u2": "human"}


def test_missing_label_and_unknown_test_id_fail(spark):
    users = spark.createDataFrame([("u1",), ("u2",)], "id string")
    with pytest.raises(Exception, match="missing or invalid label"):
        rel.align_labels(users, spark.createDataFrame([("u1", "human")], "id string, label string")).collect()
    with pytest.raises(Exception):
        rel.mask_from_ids(users, spark.createDataFrame([("u9",)], "id string")).collect()


def test_blank_image_is_missing(spark):
    df = spark.createDataFrame([("\t\n",), ("",), (None,), ("x",)], "url string")
    assert [r[0] for r in df.select(scalar.default_image_flag(F.col("url"), "d")).collect()] == [1.0, 1.0, 1.0, 0.0]


def test_quantiles_with_ties_are_exact_and_tied_rows_one(spark):
    ties = [("a", 0.0)] * 990 + [("a", float(k)) for k in range(1, 11)] + [("b", 1.0), ("b", 2.0), (None, 3.0)]
    df = spark.createDataFrame(ties, "g string, v double")
    got = {(r.g, r.p): r.value for r in agg.quantile_table(df, "v", [0.0, 0.5, 0.995, 1.0], ["g"]).collect()}
    assert got["a", 0.5] == 0.0 and got["a", 1.0] == 10.0 and got["a", 0.995] == pytest.approx(5.005)
    assert got["b", 0.5] == 1.5 and got[None, 0.5] == 3.0


def test_density_and_shares_keep_their_digits(spark):
    df = spark.createDataFrame([(0.0,), (1e10,), (5e9,)], "v double")
    assert all(r.density > 0 for r in agg.density_histogram(df, "v", 10).collect())


def test_pagerank_raises_without_convergence(spark):
    g = gr.Graph(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"),
                 spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("a", "r", "c")],
                                       "source_id string, relation string, target_id string"))
    with pytest.raises(RuntimeError, match="converge"):
        gr.pagerank(g, max_iter=2, tol=1e-12)
