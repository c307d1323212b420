"""Positions and running sums within groups of any size (helper of operators 9 and 11).

A window over a whole group is one task. Here rows are dealt by ranges of the group and its
order, so that a group that holds a third of a table lies in many ranges, and what the earlier
ranges hold of a group is added from one row for each range and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import cut_lineage


def numbered(rows: DataFrame, group: str, order: Sequence[str], out: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``out``, the position (from 0) within the group in that order, and the
    sums, up to and with the row, that ``sums`` names. Rows with equal ``order`` stand in any
    order, but a fixed one. The result is written."""
    made = sums or {}
    row = F.monotonically_increasing_id()
    ranged = rows.withColumn("__tie", row).repartitionByRange(group, *order, "__tie")
    part = cut_lineage(ranged.withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(group, "__part").orderBy(*order, "__tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = part.select("*", (F.row_number().over(inside) - 1).cast("long").alias("__own"),
                        *[F.sum(c).over(upto).alias(f"__own_{k}") for k, c in made.items()])
    # a row for each range that a group lies in
    held = part.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__n_{k}") for k, c in made.items()])
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("__g", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                       *[F.coalesce(F.sum(f"__n_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in made])
    joined = local.join(held, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return cut_lineage(joined.select(
        *[F.col(f"`{c}`") for c in rows.columns], (F.col("__own") + F.col("__before")).alias(out),
        *[(F.col(f"__own_{k}") + F.col(f"__before_{k}")).alias(k) for k in made]))
