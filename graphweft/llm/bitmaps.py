"""Fixed-size membership filters, built by an aggregate and sent to every task.

A filter of 2^bits bits takes the same room however many keys it holds. It lets everything
through that was put in; what else passes is found out by the join that follows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKET = 32768  # bits of one bitmap of Spark's bitmap functions


@dataclass
class Bitmap:
    bits: int
    data: np.ndarray  # packed, little bit order

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each 64-bit key may have been put in."""
        at = (keys.view(np.uint64) if keys.dtype == np.int64 else keys) & np.uint64((1 << self.bits) - 1)
        at = at.astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame, key: Column, bits: int) -> Bitmap:
    """Filter of a column of 64-bit keys (nulls are left out): 2^bits / 8 bytes reach the
    driver, as maps of 4 KB that each task fills and the aggregate puts together."""
    place = key.bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = (keys.select(place.alias("place")).filter(F.col("place").isNotNull())
            .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map")).collect())
    data = np.zeros(max(1 << bits, _BUCKET) // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * (_BUCKET // 8)
        part = np.frombuffer(bytes(r["map"]), np.uint8)
        data[at:at + len(part)] = part
    return Bitmap(bits, data)


def columns(rows: DataFrame) -> list[Column]:
    """All columns of a table, whatever characters their names hold."""
    return [F.col(f"`{c}`") for c in rows.columns]


def split(rows: DataFrame, keys: DataFrame, on: list[str], bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns ``on`` are certainly not among ``keys``' columns of those names, and
    all others, which a join with ``keys`` has to tell apart. So the first need not be moved, and
    Python sees a hash of each row's key only."""
    code = F.xxhash64(*[F.struct(c) for c in on])
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(keys, code, bits))

    @F.arrow_udf("boolean")
    def maybe(key: pa.Array) -> pa.Array:
        return pa.array(shared.value.has(key.to_numpy(zero_copy_only=False)))

    hit = maybe(code)
    return rows.filter(~hit), rows.filter(hit)
