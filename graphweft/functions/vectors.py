"""Dense-vector helpers on ``ARRAY<DOUBLE|FLOAT>`` columns.

Element-wise work uses higher-order functions (``transform``, ``zip_with``,
``aggregate``), which run inside the JVM. Vectors are aggregated across rows whole, by Spark
ML's summarizer (``mean_by``, ``sum_by``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, s: Column | float) -> Column:
    s = F.lit(s) if not isinstance(s, Column) else s
    return F.transform(a, lambda x: x * s)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("double"), dim)


def rounded(a: Column, digits: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x.cast("double"), digits))


def argmax(a: Column) -> Column:
    """0-based position of the (first) largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(a: Column) -> Column:
    m = F.array_max(a)
    ex = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def to_long(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """(keys..., vec) -> (keys..., pos, value)."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "value"))


def flat_columns(dim: int) -> list[str]:
    return [f"_e{k}" for k in range(dim)]


def flat(df: DataFrame, keys: Sequence[str], vec: str, dim: int) -> DataFrame:
    """(keys..., vec) -> (keys..., a double column for each of ``dim`` elements)."""
    return df.select(*keys, *[F.get(F.col(vec), F.lit(k)).cast("double").alias(c) for k, c in enumerate(flat_columns(dim))])


def from_long(df: DataFrame, keys: Sequence[str], value: str = "value", out: str = "vec") -> DataFrame:
    """(keys..., pos, value) -> (keys..., vec) with elements in pos order."""
    return (df.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("_s"))
            .select(*keys, F.col(f"_s.{value}").alias(out)))


def _summed(df: DataFrame, keys: Sequence[str], vec: str, metric: str, out: str, count: str | None) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.select(*keys, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    how = Summarizer.mean if metric == "mean" else Summarizer.sum
    counts = [F.count(F.lit(1)).alias(count)] if count else []
    done = rows.groupBy(*keys).agg(how(F.col("_v")).alias("_a"), *counts)
    return done.select(*keys, vector_to_array("_a").alias(out), *([count] if count else []))


def mean_by(df: DataFrame, keys: Sequence[str], vec: str, out: str = "vec", count: str | None = None) -> DataFrame:
    """Element-wise mean of ``vec`` per group of ``keys`` (and the number of rows as ``count``).

    Whole vectors are aggregated, by Spark ML's summarizer: each task merges its rows of a group
    into one vector before the shuffle, so that a group with many rows (a hub) is a few vectors.
    """
    return _summed(df, keys, vec, "mean", out, count)


def sum_by(df: DataFrame, keys: Sequence[str], vec: str, out: str = "vec", count: str | None = None) -> DataFrame:
    """Element-wise sum of ``vec`` per group of ``keys``; see ``mean_by``."""
    return _summed(df, keys, vec, "sum", out, count)


def running_mean(df: DataFrame, keys: Sequence[str], at: str, vec: str, out: str = "vec") -> DataFrame:
    """Mean of ``vec`` over a key's rows up to ``at``, a row for each ``at`` of a key: keys, at, out.

    Whole vectors meet in one shuffle by ``keys`` and one sort, in the type they come in, and
    Spark ML's summarizer runs over the sorted rows, rows of the same ``at`` together.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    order = Window.partitionBy(*keys).orderBy(at)
    mean = Summarizer.metrics("mean").summary(F.col("_v")).over(order)
    dealt = df.select(*keys, at, vec).repartition(*keys).sortWithinPartitions(*keys, at)
    rows = dealt.select(*keys, at, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    done = rows.select(*keys, at, mean.alias("_m"), F.lead(at).over(order).alias("_next"))
    return (done.where(F.col("_next").isNull() | (F.col("_next") != F.col(at)))
            .select(*keys, at, vector_to_array(F.col("_m.mean")).alias(out)))
