"""Splits, metrics and node classification.

The reference trains relational GCNs end to end on one GPU. Here the graph part is
precomputed as Spark joins (``graph.stacked_neighbour_features``: SIGN, Frasca et al. 2020)
and a Spark ML classifier trains on the result, so training and scoring scale with the
cluster. Splits are md5-ranked, so they are reproducible and identical on every run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.random import uniform
from graphweft.operators import aggregates as agg
from graphweft.session import cut_lineage

# Fixed values of the reference's split and selection rules.
STATIC_VAL_RATIO = 0.1
SNAPSHOT_VAL_RATIO = 0.2
SNAPSHOT_TEST_RATIO = 0.2
SELECTION_BOT_WEIGHT = 0.7
SELECTION_MACRO_WEIGHT = 0.3
SELECTION_MIN_DELTA = 1e-4

#: rows that one task of an exact rank sorts together, on average
ROWS_PER_BUCKET = 50_000


def rank_within(df: DataFrame, group: Sequence[str], key: Column, tie: str = "id",
                buckets: int = 1024, out: str = "rank") -> DataFrame:
    """0-based rank of each row inside its group by ``key`` in [0, 1) (then ``tie``).

    Exact, without a window over a whole group: rows fall into ``buckets`` equal key
    ranges; counts per (group, bucket) give each bucket's offset (a running sum over at
    most ``buckets`` rows per group), and only rows of one bucket are sorted together. A
    group of any size is spread over the buckets (keys are md5 draws, so uniform).
    """
    g = list(group)
    b = F.least(F.floor(key * F.lit(buckets)).cast("int"), F.lit(buckets - 1))
    keyed = df.withColumn("_k", key).withColumn("_b", b)
    counts = keyed.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wo = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy("_b")
    offsets = counts.withColumn("_off", F.sum("_c").over(wo.rowsBetween(Window.unboundedPreceding, -1)))
    wb = Window.partitionBy(*g, "_b").orderBy(F.col("_k"), F.col(tie))
    return (keyed.join(offsets.select(*g, "_b", "_off"), g + ["_b"])
            .withColumn(out, F.coalesce(F.col("_off"), F.lit(0)) + F.row_number().over(wb) - 1)
            .drop("_k", "_b", "_off"))


def static_split(nodes: DataFrame, in_test: str = "in_test", val_ratio: float = STATIC_VAL_RATIO,
                 seed: int = 42) -> DataFrame:
    """Id, split. Test nodes are given (C20); of the rest ``int(val_ratio * n)`` in md5
    order go to validation, the remainder to training."""
    rest = nodes.where(~F.col(in_test))
    n_rest = rest.count()
    n_val = int(val_ratio * n_rest)
    buckets = max(1, n_rest // ROWS_PER_BUCKET)
    ranked = rank_within(rest.select("id"), [], uniform(F.col("id"), seed), buckets=buckets)
    return (ranked.select("id", F.when(F.col("rank") < n_val, "val").otherwise("train").alias("split"))
            .unionByName(nodes.where(F.col(in_test)).select("id", F.lit("test").alias("split"))))


def snapshot_split(members: DataFrame, val_ratio: float = SNAPSHOT_VAL_RATIO,
                   test_ratio: float = SNAPSHOT_TEST_RATIO, seed: int = 42, buckets: int = 256) -> DataFrame:
    """Per snapshot, ``round(val_ratio*n)`` validation and ``round(test_ratio*n)`` test
    nodes (round half to even), the rest training, in md5 order keyed by (snapshot, id).
    ``members``: snapshot_idx, id. Returns snapshot_idx, id, split.

    Distributed selection: members are expanded once, with their key; counts of key ranges tell
    in which range of a snapshot each of its two cuts lies, only these ranges are sorted, and
    every row is then decided by its key against the two cuts of its snapshot.
    """
    key = uniform(F.concat_ws(":", F.col("snapshot_idx").cast("string"), F.col("id")), seed)
    rows = cut_lineage(members.select("snapshot_idx", "id", key.alias("_k")))
    bucket = F.least(F.floor(F.col("_k") * buckets).cast("int"), F.lit(buckets - 1))
    held = rows.groupBy("snapshot_idx", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy("snapshot_idx")
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    held = held.select("snapshot_idx", "_b", "_c", F.sum("_c").over(upto).alias("_upto"), F.sum("_c").over(whole).alias("_n"))
    n_val, n_test = F.bround(F.col("_n") * F.lit(val_ratio), 0), F.bround(F.col("_n") * F.lit(test_ratio), 0)
    cuts = F.array(F.struct(F.lit("val").alias("cut"), n_val.cast("bigint").alias("place")),
                   F.struct(F.lit("test").alias("cut"), (n_val + n_test).cast("bigint").alias("place")))
    places = (held.select("snapshot_idx", F.col("_b").alias("_in"), (F.col("_upto") - F.col("_c")).alias("_before"), "_upto",
                          F.explode(cuts).alias("x"))
              .where((F.col("x.place") >= F.col("_before")) & (F.col("x.place") < F.col("_upto")))
              .select("snapshot_idx", "_in", F.col("x.cut").alias("cut"), (F.col("x.place") - F.col("_before")).alias("_skip")))
    near = rows.withColumn("_b", bucket).join(places.withColumnRenamed("snapshot_idx", "_s"),
                                              (F.col("snapshot_idx") == F.col("_s")) & (F.col("_b") == F.col("_in")))
    inside = Window.partitionBy("snapshot_idx", "cut").orderBy("_k", "id")
    spot = F.struct(F.col("_k"), F.col("id"))
    found = near.withColumn("_r", F.row_number().over(inside) - 1).where(F.col("_r") == F.col("_skip"))
    at = cut_lineage(found.groupBy(F.col("snapshot_idx").alias("_s")).agg(
        F.max(F.when(F.col("cut") == "val", spot)).alias("_val"), F.max(F.when(F.col("cut") == "test", spot)).alias("_test")))

    def before(c: str) -> Column:  # no cut: all rows come before it
        return F.col(c).isNull() | (spot < F.col(c))

    split = F.when(before("_val"), "val").when(before("_test"), "test").otherwise("train")
    return rows.join(at, F.col("snapshot_idx") == F.col("_s"), "left").select("snapshot_idx", "id", split.alias("split"))


def binary_metrics(df: DataFrame, group: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy, F1 of class 1 (bot), macro F1 over the classes that occur in truth or
    prediction; a zero division is 0.

    Confusion counts per group in one aggregation, then closed forms."""
    g = list(group)
    c = (df.groupBy(*g) if g else df.groupBy()).agg(
        F.count(F.when((F.col(y) == 1) & (F.col(pred) == 1), 1)).alias("tp"),
        F.count(F.when((F.col(y) == 0) & (F.col(pred) == 1), 1)).alias("fp"),
        F.count(F.when((F.col(y) == 1) & (F.col(pred) == 0), 1)).alias("fn"),
        F.count(F.when((F.col(y) == 0) & (F.col(pred) == 0), 1)).alias("tn"))

    def f1(tp, fp, fn):
        d = F.lit(2) * tp + fp + fn
        return F.when(d > 0, F.lit(2.0) * tp / d).otherwise(F.lit(0.0))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    total = tp + fp + fn + tn
    classes = (tp + fp + fn > 0).cast("int") + (tn + fp + fn > 0).cast("int")
    return c.select(*g, "tp", "fp", "fn", "tn",
                    F.when(total > 0, (tp + tn) / total).otherwise(F.lit(0.0)).alias("accuracy"),
                    f1(tp, fp, fn).alias("f1_bot"),
                    ((f1(tp, fp, fn) + f1(tn, fn, fp)) / F.greatest(classes, F.lit(1))).alias("f1_macro"))


def selection_score(metrics: DataFrame) -> DataFrame:
    """0.7 * F1(bot) + 0.3 * macro F1."""
    return metrics.withColumn("score", F.lit(SELECTION_BOT_WEIGHT) * F.col("f1_bot")
                              + F.lit(SELECTION_MACRO_WEIGHT) * F.col("f1_macro"))


def best_candidate(scores: DataFrame, order_col: str, score_col: str = "score",
                   min_delta: float = SELECTION_MIN_DELTA) -> DataFrame:
    """The candidate kept by "replace the best only if better by more than min_delta",
    scanning candidates in ``order_col`` order (a few rows: one per grid point/epoch)."""
    rows = scores.orderBy(order_col).collect()
    best, best_score = None, 0.0
    for r in rows:
        if r[score_col] > best_score + min_delta:
            best, best_score = r, r[score_col]
    spark = scores.sparkSession
    if best is None:
        return spark.createDataFrame([], scores.schema)
    return spark.createDataFrame([best], scores.schema)


def weighted_cross_entropy(df: DataFrame, y: str = "y", p_bot: str = "p_bot",
                           weights: tuple[float, float] | None = None,
                           group: Sequence[str] = (), logit: str | None = None) -> DataFrame:
    """sum(w_y * -ln p_y) / sum(w_y); without weights the plain mean.

    From ``logit`` (log-odds of class 1), if given, which stays finite however sure the model
    is; otherwise from ``p_bot``, where a wrong certainty costs infinity."""
    if logit is not None:
        z = F.col(logit)
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.when(F.col(y) == 1, z).otherwise(F.lit(0.0))
    else:
        py = F.when(F.col(y) == 1, F.col(p_bot)).otherwise(F.lit(1.0) - F.col(p_bot))
        loss = F.when(py > 0, -F.log(py)).when(py <= 0, F.lit(float("inf")))
    w = F.lit(1.0)
    if weights is not None:
        w = F.when(F.col(y) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    g = list(group)
    return (df.groupBy(*g) if g else df.groupBy()).agg(
        (F.sum(w * loss) / F.sum(w)).alias("loss"))


def sequence_means(per_snapshot: DataFrame, sequences: DataFrame,
                   cols: Sequence[str] = ("accuracy", "f1_bot")) -> DataFrame:
    """Mean over a sequence's snapshots (snapshots with an empty mask are absent and
    so skipped), then the mean over sequences. Returns one row with the means."""
    j = per_snapshot.join(sequences.select("snapshot_idx", "sequence_id"), "snapshot_idx")
    per_seq = j.groupBy("sequence_id").agg(*[F.avg(c).alias(c) for c in cols])
    return per_seq.agg(F.count(F.lit(1)).alias("num_sequences"), *[F.avg(c).alias(c) for c in cols])


def sequence_evaluation(predictions: DataFrame, sequences: DataFrame, weights: tuple[float, float] | None = None) -> DataFrame:
    """Loss, accuracy and bot F1 of per-snapshot predictions (snapshot_idx, y, logit),
    averaged over the snapshots of a sequence and then over sequences. Class 1 is predicted
    where the logit is positive; a snapshot's loss is the weighted cross entropy (I12)."""
    p = predictions.withColumn("pred", (F.col("logit") > 0).cast("int"))
    scores = binary_metrics(p, ["snapshot_idx"]).select("snapshot_idx", "accuracy", "f1_bot")
    loss = weighted_cross_entropy(p, weights=weights, group=["snapshot_idx"], logit="logit")
    return sequence_means(scores.join(loss, "snapshot_idx"), sequences, ["loss", "accuracy", "f1_bot"])


# --- I8 / I13: classifier -------------------------------------------------------------------

def _logreg(**kw):
    return LogisticRegression(featuresCol="features_vec", labelCol="y", weightCol="weight",
                              maxIter=kw.get("max_iter", 50), regParam=kw.get("reg", 0.0))


def _forest(**kw):
    return RandomForestClassifier(featuresCol="features_vec", labelCol="y", weightCol="weight",
                                  numTrees=kw.get("trees", 50), seed=42)


def _gbt(**kw):
    return GBTClassifier(featuresCol="features_vec", labelCol="y", weightCol="weight",
                         maxIter=kw.get("max_iter", 20), seed=42)


MODELS: dict[str, Callable] = {"logreg": _logreg, "forest": _forest, "gbt": _gbt}


def make_model(name: str, **kw):
    """Model registry by name; an unknown name raises."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; choose from {sorted(MODELS)}")
    return MODELS[name](**kw)


def train_and_score(features: DataFrame, labels: DataFrame, splits: DataFrame,
                    model: str = "logreg", grid: Sequence[dict] = ({"reg": 0.0}, {"reg": 0.01}, {"reg": 0.1})):
    """I8 + I10 + I13: fit one model per grid point on the training split with D20 class
    weights, pick the best by the I10 score on validation, score every node.

    The joined rows are written once: every fit, the validation of every grid point and the
    scoring read them. ``features``: id, features (array); ``labels``: id, y; ``splits``: id, split.
    Returns (scores: id, y, split, prediction, p_bot, logits; validation metrics per grid point).
    """
    data = cut_lineage(features.join(labels, "id").join(splits, "id"))
    data = data.withColumn("features_vec", array_to_vector("features"))
    w = agg.class_weights(data.where(F.col("split") == "train"), "y").first()
    data = data.withColumn("weight", F.when(F.col("y") == 1, F.lit(w["w_bot"]))
                           .otherwise(F.lit(w["w_human"])))
    train = data.where(F.col("split") == "train")
    val = data.where(F.col("split") == "val")
    fitted, rows = [], []
    for i, params in enumerate(grid):
        m = make_model(model, **params).fit(train)
        pv = m.transform(val).select(F.col("y"), F.col("prediction").cast("int").alias("pred"))
        met = selection_score(binary_metrics(pv)).first()
        fitted.append(m)
        rows.append((i, str(params), met["accuracy"], met["f1_bot"], met["f1_macro"], met["score"]))
    spark = features.sparkSession
    val_metrics = spark.createDataFrame(
        rows, "candidate int, params string, accuracy double, f1_bot double, f1_macro double, score double")
    best = best_candidate(val_metrics, "candidate").collect()
    chosen = fitted[best[0]["candidate"]] if best else fitted[0]
    scored = chosen.transform(data).select(
        "id", "y", "split", F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("p_bot"),
        vector_to_array("rawPrediction").alias("logits"))
    return scored, val_metrics
