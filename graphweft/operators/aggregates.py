"""Aggregations and summary tables.

Global statistics that a later row-wise expression needs (min/max of a histogram, mean and
deviation of a z-score) are one-row aggregates fetched as literals: a bounded scalar result,
never row data, so no cross join and no single-partition window over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import cut_lineage
from graphweft.sources.driver_tables import SOCIAL_RELATIONS

LABELS = ("human", "bot")


def degree(edges: DataFrame, relations: Sequence[str] = SOCIAL_RELATIONS) -> DataFrame:
    """Occurrences as source plus as target (self-loop 2, multi-edges each): id, degree.

    One scan of the edges; partial aggregation collapses hubs before the shuffle.
    """
    return (edges.where(F.col("relation").isin(list(relations)))
            .select(F.explode(F.array("source_id", "target_id")).alias("id"))
            .groupBy("id").agg(F.count(F.lit(1)).alias("degree")))


def users_with_degree(users: DataFrame, edges: DataFrame,
                      relations: Sequence[str] = SOCIAL_RELATIONS) -> DataFrame:
    """D1 + C2: every user with its degree, 0 when it has no social edge."""
    return users.join(degree(edges, relations), "id", "left").fillna({"degree": 0})


def distinct_likes(edges: DataFrame) -> DataFrame:
    """Id, like_count = distinct liked targets per user."""
    return (edges.where(F.col("relation") == "like")
            .groupBy(F.col("source_id").alias("id"))
            .agg(F.countDistinct("target_id").alias("like_count")))


def relation_counts(edges: DataFrame) -> DataFrame:
    """D3: relation, n (summed over all rows)."""
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def interaction_matrix(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per relation, counts of (source label, target label) pairs in wide form.

    Columns: relation, human_human, human_bot, bot_human, bot_bot. Only edges with both ends
    labelled count; relations without such an edge do not appear.

    Plan: label the sources, pre-aggregate per (relation, target, source label) so a hub
    target collapses to a handful of rows, then label the targets and sum.
    """
    src = labels.select(F.col("id").alias("source_id"), F.col("label").alias("source_label"))
    tgt = labels.select(F.col("id").alias("target_id"), F.col("label").alias("target_label"))
    per_target = (edges.select("source_id", "relation", "target_id")
                  .join(src, "source_id")
                  .groupBy("relation", "target_id", "source_label")
                  .agg(F.count(F.lit(1)).alias("n")))
    return label_cells(per_target.join(tgt, "target_id"))


def label_cells(pairs: DataFrame) -> DataFrame:
    """Counts ``n`` by relation, source_label and target_label in the wide form of D4."""
    cells = []
    for s in LABELS:
        for t in LABELS:
            cells.append(F.coalesce(F.sum(F.when((F.col("source_label") == s)
                                                 & (F.col("target_label") == t), F.col("n"))),
                                    F.lit(0)).cast("bigint").alias(f"{s}_{t}"))
    return (pairs.where(F.col("source_label").isin(*LABELS) & F.col("target_label").isin(*LABELS))
            .groupBy("relation").agg(*cells))


def row_normalised(matrix: DataFrame, digits: int | None = 6) -> DataFrame:
    """Each source-label row divided by its sum; an empty row gives NULLs."""
    def r(c: Column) -> Column:
        return F.round(c, digits) if digits is not None else c
    out = [F.col("relation")]
    for s in LABELS:
        total = sum((F.col(f"{s}_{t}") for t in LABELS), F.lit(0))
        for t in LABELS:
            out.append(r(F.when(total > 0, F.col(f"{s}_{t}") / total)).alias(f"{s}_{t}"))
    return matrix.select(*out)


def class_shares(users: DataFrame, label_col: str = "label") -> DataFrame:
    """Label, n, share of all rows."""
    counts = users.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = users.count()
    return counts.withColumn("share", F.col("n") / F.lit(float(total)))


def distinct_summary(users: DataFrame, tweet_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """One row of distinct counts and class shares."""
    both = users.select(F.col(id_col).alias("u"), "label", F.lit(None).cast("string").alias("t")).unionByName(
        tweet_ids.select(F.lit(None).cast("string").alias("u"), F.lit(None).cast("string").alias("label"),
                         F.col(id_col).cast("string").alias("t")))
    one = both.agg(F.count_distinct("u").alias("num_users"),
                   F.count_distinct(F.when(F.col("label") == "human", F.col("u"))).alias("num_humans"),
                   F.count_distinct(F.when(F.col("label") == "bot", F.col("u"))).alias("num_bots"),
                   F.count_distinct("t").alias("num_tweets"))

    def share(c: str) -> Column:
        return F.when(F.col("num_users") > 0, F.col(c) / F.col("num_users"))

    return one.select("num_users", "num_humans", "num_bots", share("num_humans").alias("perc_humans"),
                      share("num_bots").alias("perc_bots"), "num_tweets")


def means_by_label(users: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Metric rows x label columns (human, bot) of means — transposed summary."""
    aggs = [F.avg(F.when(F.col("label") == lab, F.col(c))).alias(f"{name}__{lab}")
            for name, c in metrics.items() for lab in LABELS]
    wide = users.agg(*aggs)
    stack = ", ".join(f"'{name}', `{name}__human`, `{name}__bot`" for name in metrics)
    return wide.selectExpr(f"stack({len(metrics)}, {stack}) AS (metric, human, bot)")


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """Key, n."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def year_histogram(df: DataFrame, ts_col: str, start: int, end: int) -> DataFrame:
    """Counts over integer years with bin edges ``range(start, end)``.

    Bins are [e_i, e_i+1) except the last, [end-2, end-1], closed on both sides. Empty bins
    are reported with 0 (bins come from ``spark.range``, not from the data).
    """
    spark = df.sparkSession
    y = F.year(F.col(ts_col))
    binned = (df.where(y.between(start, end - 1))
              .select(F.least(y, F.lit(end - 2)).alias("bin_start"))
              .groupBy("bin_start").agg(F.count(F.lit(1)).alias("n")))
    bins = spark.range(start, end - 1).select(F.col("id").cast("int").alias("bin_start"))
    return bins.join(binned, "bin_start", "left").fillna({"n": 0})


def scalar_stats(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """A one-row aggregate fetched as Python scalars."""
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).first()
    return row.asDict()


def density_histogram(df: DataFrame, col: str, bins: int, group: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] of ``col``: bin, n, density.

    ``density = n / (N * width)``; the maximum falls in the last bin. With ``group`` the
    range is shared, counts and densities are per group.
    """
    st = scalar_stats(df.where(F.col(col).isNotNull()),
                      {"lo": F.min(col), "hi": F.max(col)})
    lo, hi = st["lo"], st["hi"]
    if lo is None:
        schema = (f"{group} string, " if group else "") + "bin int, n bigint, density double"
        return df.sparkSession.createDataFrame([], schema)
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = ([group] if group else []) + ["bin"]
    counted = (df.where(F.col(col).isNotNull()).select(*([group] if group else []), b.alias("bin"))
               .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    if group:
        totals = (df.where(F.col(col).isNotNull()).groupBy(group)
                  .agg(F.count(F.lit(1)).alias("_N")))
        counted = counted.join(totals, group)
    else:
        counted = counted.withColumn("_N", F.lit(df.where(F.col(col).isNotNull()).count()))
    return (counted.withColumn("density", F.col("n") / (F.col("_N") * F.lit(width)))
            .drop("_N"))


def quantile_table(df: DataFrame, col: str, probs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation as rows: group columns, p, value.

    Spark's ``percentile``/``median`` keep every distinct value of a group in one aggregation
    buffer, which a big group cannot afford. Here equal values are counted first, so that ties
    are one row however many they are; the distinct values are range-partitioned in (group,
    value) order, positions run within each partition, and the partitions' totals, one small
    row each, give what comes before. Rows at the wanted positions are then filtered out.
    """
    g = list(group)
    spark = df.sparkSession
    counts = (df.where(F.col(col).isNotNull()).groupBy(*g, F.col(col).cast("double").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut_lineage(counts.repartitionByRange(n, *g, "_v").withColumn("_pid", F.spark_partition_id()))
    totals = pieces.groupBy(*g, "_pid").agg(F.sum("_c").alias("_t"))
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    offsets = totals.select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col("_pid").alias("_p"),
                            F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"),
                            F.sum("_t").over(whole).alias("_n"))
    same = F.col("_pid") == F.col("_p")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    run = Window.partitionBy(*g, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (pieces.withColumn("_run", F.sum("_c").over(run)).join(offsets, same)
              .withColumn("_hi", F.col("_off") + F.col("_run")).withColumn("_lo", F.col("_hi") - F.col("_c")))
    wanted = F.transform(F.array(*[F.lit(float(p)) for p in probs]),
                         lambda p: F.struct(p.alias("p"), (p * (F.col("_n") - 1)).alias("pos")))
    at = placed.select(*g, "_v", "_lo", "_hi", "_n", F.explode(wanted).alias("_w"))
    low = F.floor(F.col("_w.pos"))
    high = F.least(low + 1, F.col("_n") - 1)
    share = F.col("_w.pos") - low

    def here(position: Column) -> Column:
        return (F.col("_lo") <= position) & (position < F.col("_hi"))

    part = (F.when(here(low), F.col("_v") * (F.lit(1.0) - share)).otherwise(F.lit(0.0))
            + F.when(here(high), F.col("_v") * share).otherwise(F.lit(0.0)))
    return (at.where(here(low) | here(high)).groupBy(*g, F.col("_w.p").alias("p"))
            .agg(F.sum(part).alias("value")))


def quantiles(df: DataFrame, col: str, probs: Sequence[float] = (0.05, 0.95, 0.99),
              group: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, a column for each (``quantile_table``)."""
    g = [group] if group else []
    rows = quantile_table(df, col, probs, g)
    cells = [F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(f"q{int(round(p * 100)):02d}") for p in probs]
    return rows.groupBy(*g).agg(*cells)


def time_range(users: DataFrame, tweets: DataFrame) -> DataFrame:
    """Min over user creation; max over users and tweets."""
    at = F.col("created_at").cast("timestamp")
    both = users.select(at.alias("t"), at.alias("u")).unionByName(
        tweets.select(at.alias("t"), F.lit(None).cast("timestamp").alias("u")))
    return both.agg(F.min("u").alias("min_time"), F.max("t").alias("max_time"))


def class_weights(labels: DataFrame, label_col: str = "y") -> DataFrame:
    """Inverse-frequency weights: w_bot = n_human/N, w_human = n_bot/N."""
    return labels.agg(
        (F.sum(F.when(F.col(label_col) == 0, 1).otherwise(0)) / F.count(F.lit(1))).alias("w_bot"),
        (F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)) / F.count(F.lit(1))).alias("w_human"))


def with_weight(df: DataFrame, label_col: str = "y", out: str = "weight") -> DataFrame:
    w = class_weights(df, label_col).first()
    return df.withColumn(out, F.when(F.col(label_col) == 1, F.lit(w["w_bot"]))
                         .otherwise(F.lit(w["w_human"])))


def graph_summary(vertices: DataFrame, edges: DataFrame, n_relations: int | None = None) -> DataFrame:
    """Nodes (vertices plus any edge endpoint), edges, relations."""
    nodes = (vertices.select("id")
             .unionByName(edges.select(F.explode(F.array("source_id", "target_id")).alias("id")))
             .distinct())
    n_nodes = nodes.count()
    n_edges = edges.count()
    n_rel = n_relations if n_relations is not None else edges.select("relation").distinct().count()
    spark = vertices.sparkSession
    return spark.createDataFrame([("nodes", n_nodes), ("edges", n_edges), ("relations", n_rel)],
                                 "metric string, value bigint")


def kind_counts(ids: DataFrame, kind_col: str = "kind") -> DataFrame:
    """Kind, n."""
    return ids.groupBy(kind_col).agg(F.count(F.lit(1)).alias("n"))
