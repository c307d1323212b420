"""Vertex cut: joins of edges with per-node rows where a few nodes hold much of all edges.

A node is hot for an end of the edges if it stands there on more of them than twice the fair
share of a task, so there are at most half as many hot nodes as tasks, whatever the number of
nodes or edges: the table of hot nodes is small enough to broadcast by its definition. A
hot node's row is dealt over copies, as many as its edges fill fair shares, and each edge meets
one copy, chosen by a hash of its other columns. What the copies gather for a node is merged by
a second aggregate.

Adaptive execution splits skewed partitions of sort-merge joins too, by bytes and only
when a join's sides come straight from exchanges; a cut is decided from the counts alone
and holds for every join strategy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions import vectors as vec
from graphweft.operators import aggregates as agg
from graphweft.session import cut_lineage


def collapse(edges: DataFrame) -> DataFrame:
    """Parallel edges as one row: source_id, relation, target_id, n. Written once, because both
    the degrees and the join read it."""
    return cut_lineage(edges.groupBy("source_id", "relation", "target_id").agg(F.count(F.lit(1)).alias("n")))


def hot_nodes(edges: DataFrame, end: str, tasks: int | None = None) -> DataFrame:
    """Nodes that stand at ``end`` on more than two fair shares of the edges, an ``1 / tasks`` of
    all rows each (the session's shuffle partitions by default): end, _copies. At most
    ``tasks / 2`` rows. Null ends match nothing and are never hot; without edges there is none."""
    tasks = tasks or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    degrees = cut_lineage(edges.where(F.col(end).isNotNull()).groupBy(end).agg(F.count(F.lit(1)).alias("_d")))
    total = degrees.agg(F.sum("_d")).first()[0] or 0
    share = max(1.0, total / tasks)
    return (degrees.where(F.col("_d") > F.lit(2 * share))
            .select(end, F.ceil(F.col("_d") / F.lit(share)).cast("int").alias("_copies")))


def join_nodes(edges: DataFrame, nodes: DataFrame, end: str, spread: Sequence[str],
               tasks: int | None = None) -> DataFrame:
    """Inner join of ``edges`` with ``nodes`` on column ``end``, hot nodes cut.

    ``nodes`` has a row for each node; ``spread`` are columns of the edges that differ between a
    node's edges (collapse parallel ones first: rows equal in ``spread`` stay together). The
    result has the columns of both, ``end`` once.
    """
    hot = F.broadcast(hot_nodes(edges, end, tasks))
    dealt, copied = deal(edges, hot, end, spread), copy(nodes, hot, end)
    return dealt.join(copied, [end, "_copy"]).drop("_copy")


def deal(edges: DataFrame, hot: DataFrame, end: str, spread: Sequence[str]) -> DataFrame:
    """``edges`` with the copy of its node (``_copy``, 0 for nodes that are not hot) that each meets."""
    copy_of = F.pmod(F.xxhash64(*spread), F.coalesce(F.col("_copies"), F.lit(1)))
    return edges.join(hot, end, "left").withColumn("_copy", copy_of.cast("int")).drop("_copies")


def copy(nodes: DataFrame, hot: DataFrame, end: str) -> DataFrame:
    """``nodes`` with a row for each of a node's copies (``_copy``)."""
    return copies_of(nodes.join(hot, end, "left"))


def copies_of(nodes: DataFrame) -> DataFrame:
    """Rows with their number of copies (``_copies``, null: one) as a row for each copy (``_copy``)."""
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1)
    return nodes.withColumn("_copy", F.explode(copies)).drop("_copies")


def relational_mean(edges: DataFrame, features: DataFrame, vec_col: str = "vec",
                    tasks: int | None = None) -> DataFrame:
    """H7 (see ``graph.relational_mean``) with a vertex cut at the sources: id, relation, vec.

    Parallel edges are collapsed before vectors meet them and weigh their number; the weight
    goes through the sum as one more element of the vector. A hub target's messages are merged
    by each task and then across tasks.
    """
    x = features.select(F.col("id").alias("source_id"), F.col(vec_col).cast("array<double>").alias("_x"))
    msg = join_nodes(collapse(edges), x, "source_id", ["relation", "target_id"], tasks)
    n = F.col("n").cast("double")
    weighed = msg.select(F.col("target_id").alias("id"), "relation",
                         F.concat(vec.scale(F.col("_x"), n), F.array(n)).alias("_v"))
    total = vec.sum_by(weighed, ["id", "relation"], "_v", out="_v")
    dim = F.size("_v") - 1
    return total.select("id", "relation",
                        vec.scale(F.slice("_v", F.lit(1), dim), 1.0 / F.element_at("_v", -1)).alias("vec"))


def interaction_matrix(edges: DataFrame, labels: DataFrame, tasks: int | None = None) -> DataFrame:
    """D4 (see ``aggregates.interaction_matrix``) with a vertex cut at the sources.

    The targets need none: by source label a hub target is two rows for each relation.
    """
    src = labels.select(F.col("id").alias("source_id"), F.col("label").alias("source_label"))
    tgt = labels.select(F.col("id").alias("target_id"), F.col("label").alias("target_label"))
    from_label = (join_nodes(collapse(edges), src, "source_id", ["relation", "target_id"], tasks)
                  .groupBy("relation", "target_id", "source_label").agg(F.sum("n").alias("n")))
    return agg.label_cells(from_label.join(tgt, "target_id"))
