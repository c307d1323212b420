"""Filters, projections, joins and set operations over the graph tables (B*, C*, F*).

Every function takes and returns DataFrames; none collects. Joins against the user table
are left to adaptive execution: it broadcasts the user side when its measured runtime size
is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, splitting skewed
(hub) partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions import scalar

# --- B: filters and projections ------------------------------------------------------


def relation_filter(edges: DataFrame, relations: Iterable[str]) -> DataFrame:
    """B1: keep edges whose relation is in the list (partition-pruned if the edge table
    is partitioned by relation, pushed to the scan otherwise)."""
    return edges.where(F.col("relation").isin(list(relations)))


def user_to_user(edges: DataFrame, prefix: str = "u") -> DataFrame:
    """B2: both ends are users (id prefix test)."""
    return edges.where(F.col("source_id").startswith(prefix) & F.col("target_id").startswith(prefix))


def with_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Rows whose text is present."""
    return df.where(F.col(col).isNotNull())


def drop_unparseable_times(df: DataFrame, col: str = "created_at", fmt: str | None = None) -> DataFrame:
    """Parse leniently (invalid -> null) and drop rows without a time."""
    return df.withColumn(col, scalar.lenient_timestamp(F.col(col), fmt)).na.drop(subset=[col])


def flatten_metrics(df: DataFrame, struct_col: str = "public_metrics",
                    fields: Sequence[str] = ("followers_count", "following_count", "tweet_count"),
                    default=0) -> DataFrame:
    """Lift nested struct fields to top-level columns, null -> default."""
    keep = [c for c in df.columns if c != struct_col]
    return df.select(*keep, *[F.coalesce(F.col(f"{struct_col}.{f}"), F.lit(default)).alias(f)
                              for f in fields])


def node_kind(id_col: Column) -> Column:
    """Kind of a node from its id prefix (u user, t tweet, l list, h hashtag)."""
    p = F.substring(id_col, 1, 1)
    return (F.when(p == "u", "user").when(p == "t", "tweet").when(p == "l", "list")
            .when(p == "h", "hashtag"))


# The (source kind, target kind) each relation connects in the reference.
RELATION_KINDS = {
    "following": ("user", "user"), "followers": ("user", "user"), "post": ("user", "tweet"),
    "pinned": ("user", "tweet"), "like": ("user", "tweet"), "mentioned": ("tweet", "user"),
    "retweeted": ("tweet", "tweet"), "quoted": ("tweet", "tweet"), "replied": ("tweet", "tweet"),
    "own": ("user", "list"), "followed": ("user", "list"), "membership": ("user", "list"),
    "contain": ("list", "tweet"), "discuss": ("tweet", "hashtag"),
}


def expected_kind(relation: Column, side: int) -> Column:
    expr = None
    for rel, kinds in RELATION_KINDS.items():
        expr = (F.when(relation == rel, kinds[side]) if expr is None
                else expr.when(relation == rel, kinds[side]))
    return expr


def with_kinds(edges: DataFrame) -> DataFrame:
    return (edges.withColumn("source_kind", node_kind(F.col("source_id")))
            .withColumn("target_kind", node_kind(F.col("target_id"))))


def kind_consistent(edges: DataFrame) -> DataFrame:
    """Keep edges whose endpoint kinds are the ones the relation connects."""
    e = with_kinds(edges)
    return e.where((F.col("source_kind") == expected_kind(F.col("relation"), 0))
                   & (F.col("target_kind") == expected_kind(F.col("relation"), 1)))


# --- C: joins -------------------------------------------------------------------------


def dedupe_last(df: DataFrame, key: str, order_col: str | None = None) -> DataFrame:
    """Keep the last row per key by ``order_col`` (label files: last line wins); without one,
    by the order in which the rows are read."""
    others = [c for c in df.columns if c not in (key, order_col)]
    order = F.col(order_col) if order_col else F.col("_read")
    rows = df if order_col else df.withColumn("_read", F.monotonically_increasing_id())
    last = F.max_by(F.struct(*others), order).alias("_last")  # of one row, nulls included
    return rows.groupBy(key).agg(last).select(key, "_last.*")


def users_with_labels(users: DataFrame, labels: DataFrame, order_col: str | None = None) -> DataFrame:
    """Users inner join labels, the last one of an id; unlabelled users are dropped."""
    lab = dedupe_last(labels, "id", order_col)
    return users.join(lab.select("id", "label"), "id", "inner")


def left_join_fill(left: DataFrame, right: DataFrame, key: str, fill: dict) -> DataFrame:
    """Left join, missing values filled with defaults."""
    return left.join(right, key, "left").fillna(fill)


def tweets_of_users(users: DataFrame, tweets: DataFrame, user_cols: Sequence[str] = ("id",)) -> DataFrame:
    """C4: tweets joined to their author on ``'u' || author_id``; rows without text dropped."""
    t = tweets.select(F.concat(F.lit("u"), F.col("author_id").cast("string")).alias("id"),
                      F.col("id").alias("tweet_id"), "created_at", "text")
    return with_text(users.select(*user_cols).join(t, "id", "inner"))


def label_endpoints(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach source and target labels (left joins; null = unlabelled)."""
    ls = labels.select(F.col("id").alias("source_id"), F.col("label").alias("source_label"))
    lt = labels.select(F.col("id").alias("target_id"), F.col("label").alias("target_label"))
    return edges.join(ls, "source_id", "left").join(lt, "target_id", "left")


def first_match(records: DataFrame, ids: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    """Records whose key is in ``ids``; the first by ``order_cols`` per key kept.

    Semi-join first (drops unmatched rows before any shuffle by key), then one window.
    """
    matched = records.join(ids.select(key).distinct(), key, "left_semi")
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc() for c in order_cols])
    return matched.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _flag(ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    return ids.select(F.col("id").alias(id_col)).distinct().withColumn(flag, F.lit(True))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either endpoint in ``ids`` (one pass; multi-edges survive)."""
    return (edges.join(_flag(ids, "source_id", "_s"), "source_id", "left")
            .join(_flag(ids, "target_id", "_t"), "target_id", "left")
            .where(F.col("_s").isNotNull() | F.col("_t").isNotNull())
            .select(*edges.columns))


def within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both endpoints in ``ids``."""
    i = ids.select("id").distinct()
    return (edges.join(i.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
            .join(i.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
            .select(*edges.columns))


def encode_endpoints(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Replace endpoint ids by dense indices (``index``: id, idx); unknown ends drop."""
    s = index.select(F.col("id").alias("source_id"), F.col("idx").alias("src_idx"))
    t = index.select(F.col("id").alias("target_id"), F.col("idx").alias("dst_idx"))
    rest = [c for c in edges.columns if c not in ("source_id", "target_id")]
    return edges.join(s, "source_id").join(t, "target_id").select("src_idx", "dst_idx", *rest)


def align_labels(users: DataFrame, labels: DataFrame,
                 codes: dict | None = None, order_col: str | None = None) -> DataFrame:
    """Id, label code by the last label of an id; a missing or unknown label raises at
    execution."""
    codes = codes or {"human": 0, "bot": 1}
    lab = dedupe_last(labels.select("id", "label", *([order_col] if order_col else [])), "id", order_col)
    code = None
    for name, value in codes.items():
        code = (F.when(F.col("label") == name, F.lit(value)) if code is None
                else code.when(F.col("label") == name, F.lit(value)))
    code = code.otherwise(F.raise_error(F.concat(F.lit("missing or invalid label for "),
                                                 F.col("id"))).cast("int"))
    return users.select("id").join(lab, "id", "left").select("id", code.cast("int").alias("y"))


def reindex_groups(users: DataFrame, grouped: DataFrame, array_col: str) -> DataFrame:
    """C14: one row per user; users without a group get an empty array."""
    elem = grouped.schema[array_col].dataType
    return (users.select("id").join(grouped, "id", "left")
            .withColumn(array_col, F.coalesce(F.col(array_col), F.array().cast(elem))))


def mask_from_ids(nodes: DataFrame, test_ids: DataFrame) -> DataFrame:
    """C20: node -> in_test flag. An id of the list that is no node is an error, checked
    eagerly with one anti join (a validation job, like the reference's lookup failure)."""
    t = test_ids.select("id").distinct()
    unknown = t.join(nodes.select("id"), "id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown test id {unknown[0]['id']}")
    flagged = nodes.select("id").join(t.withColumn("in_test", F.lit(True)), "id", "left")
    return flagged.select("id", F.coalesce(F.col("in_test"), F.lit(False)).alias("in_test"))


# --- F: set operations ----------------------------------------------------------------

# Relation codes of the two social relations in the static graph.
SOCIAL_CODES = {"followers": 0, "following": 1}


def typed_edge_list(edges: DataFrame, codes: dict | None = None) -> DataFrame:
    """union of per-relation edge lists with an integer relation code, in one pass."""
    codes = codes or SOCIAL_CODES
    code = None
    for rel, c in codes.items():
        code = F.when(F.col("relation") == rel, c) if code is None else code.when(
            F.col("relation") == rel, c)
    return relation_filter(edges, codes).withColumn("rel_code", code.cast("int"))


def distinct_union(*dfs: DataFrame) -> DataFrame:
    """set union with duplicates removed."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.distinct()


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other`` (keeps multiplicity)."""
    return df.join(other.select(key).distinct(), key, "left_anti")
