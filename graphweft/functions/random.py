"""Deterministic pseudo-randomness keyed by row content.

``rand()`` depends on partitioning and task order, so a re-run after an executor loss
could draw other numbers. Every random choice in the library instead hashes
``key:seed`` with md5 and keeps the first 52 bits: a uniform double in [0, 1) that is
the same on every engine (the DuckDB oracles use the same formula).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = float(2 ** 52)


def uniform(key: Column | str, seed: int | str) -> Column:
    """Uniform [0, 1) double from md5(key || ':' || seed)."""
    key = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(TWO_POW_52)


def uniform_sql(key_sql: str, seed: int | str) -> str:
    """The same draw as DuckDB SQL text (used by the oracles)."""
    return (f"(('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || ':{seed}'), 1, 13))::BIGINT"
            f" / 4503599627370496.0)")
