"""Helpers shared by the query registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.session import cut_lineage
from graphweft.sources import driver_tables as dt

_SHARED: dict = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Result of ``build()``, written to the checkpoint folder once for a session and folder of
    tables: iterative stages that several queries start from."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = cut_lineage(build())
    return _SHARED[key]


TS_FMT = "yyyy-MM-dd HH:mm:ss"
DUCK_TS_FMT = "%Y-%m-%d %H:%M:%S"


def ts_str(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, TS_FMT)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round some columns of a query's result (library functions return full precision)."""
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def duck_ts(expr: str) -> str:
    return f"strftime({expr}, '{DUCK_TS_FMT}')"


def tables(spark: SparkSession, sf_dir: str) -> dt.SocialTables:
    return dt.social_tables(spark, sf_dir)
