"""Mixing sources to target weights by pivotal dependent rounding (operator 10).

Every source gets a target number of words: sources share the words of all documents by
weight, a target stops at ``max_epochs`` times its source's words, and the excess is shared
among the others by weight until none is above. A document of a source is wanted
``target / words of the source`` times. The whole part is taken; the fractional parts are
rounded by pairs (Deville and Tille's pivotal method, with words as sizes): mass moves at
random from one document of a pair to the other, words for words, until one of them is
integral, and the other meets the next document. Expected copies stay as wanted, and each
pair keeps its words, so that a source's total misses its target by half of its last open
document at most.

The pairs form a reduction tree on Spark: documents of a source are dealt into groups by a
hash, each group is reduced by itself and leaves at most one fractional document, and these
are the documents of the next level, until one is left for each source. That one is rounded
to the nearer side, so that the total is as near as whole documents allow. All random numbers are hashes of row keys, so reruns agree.

Defined results: a null text has 0 words; documents without words are taken 0 times; a null
source is a source of its own, the last one. Repeated rows are documents of their own, told
apart only by number. An empty table gives an empty mix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from graphweft.llm import words as W
from graphweft.session import cut_lineage


@dataclass(frozen=True)
class MixParams:
    """Weights go to sources in code point order, null last, and repeat. ``group`` is the
    mean number of documents that one reduction takes."""

    weights: Sequence[float] = (1.0, 2.0, 3.0)
    max_epochs: float = 3.0
    group: int = 4096
    seed: str = "mix"


def with_size(documents: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """Replace the text by its number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    keep = [c for c in documents.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for piece in W.slices(batch.column("__text")):
                starts, _ = W.spans(piece.data, piece.offsets, W.SPACED)
                n[piece.first_row:piece.first_row + piece.n_rows] = np.diff(np.searchsorted(starts, piece.offsets))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(n)], [*keep, name])

    rows = documents.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(name, T.LongType())])
    return rows.mapInArrow(run, schema)


def source_targets(sizes: DataFrame, params: MixParams | None = None) -> DataFrame:
    """Targets of sources from (source, source_size): source, source_size, target.

    Sources reach their limit in order of size / weight: with the first k at their limit,
    the others have (total - limits) / (weights) for each unit of weight. That is one pass
    over the sources, ranked by partitions of their order; there are as many rows as sources.
    """
    p = params or MixParams()
    each = F.array(*[F.lit(float(w)) for w in p.weights])
    # one row for each source, which is small next to the documents
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("weight", F.element_at(each, (F.row_number().over(order) - 1) % len(p.weights) + 1))
    limit = F.col("source_size") * float(p.max_epochs)
    ranked = ranked.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (ranked.withColumn("total", F.sum("source_size").over(every).cast("double"))
              .withColumn("all_weight", F.sum("weight").over(every))
              .withColumn("limits", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
              .withColumn("weights", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
              .withColumn("unit", (F.col("total") - F.col("limits")) / (F.col("all_weight") - F.col("weights"))))
    # the first source that stays under its limit fixes what a unit of weight gets
    free = F.min(F.when(F.col("ratio") >= F.col("unit"), F.col("ratio"))).over(every)
    ranked = ranked.withColumn("first_free", free)
    unit = F.max(F.when(F.col("ratio") == F.col("first_free"), F.col("unit"))).over(every)
    return (ranked.withColumn("unit", unit)
            .select("source", "source_size",
                    F.when(F.col("unit").isNull(), F.col("limit"))
                    .otherwise(F.least(F.col("limit"), F.col("unit") * F.col("weight"))).alias("target")))


def _chance(seed: str, level: int, *key) -> float:
    raw = hashlib.blake2b(repr((seed, level, key)).encode(), digest_size=8).digest()
    return int.from_bytes(raw[:7], "big") / 2**56


def pivotal_pass(keys: list, sizes: list[float], shares: list[float], chance) -> tuple[list[float], int | None]:
    """Round shares in [0, 1] pair by pair; returns them and the index of the last
    fractional one, if any is left. ``chance(i)`` is the uniform number of a meeting.

    In a pair with shares a, b and sizes s, t the words s*a + t*b stay: either the first
    gives as much as it can to the second, or the other way round, with the probabilities
    that keep both expectations.
    """
    tiny = 1e-12
    out = list(shares)
    last: int | None = None
    for i in range(len(keys)):
        if out[i] <= tiny or out[i] >= 1 - tiny:
            out[i] = float(round(out[i]))
            continue
        if last is None:
            last = i
            continue
        a, b, s, t = out[last], out[i], sizes[last], sizes[i]
        give = min(a * s, (1 - b) * t)  # words from the first to the second
        take = min((1 - a) * s, b * t)
        if chance(i) * (give + take) < take:
            a, b = a - give / s, b + give / t
        else:
            a, b = a + take / s, b - take / t
        whole_a = a <= tiny or a >= 1 - tiny
        whole_b = b <= tiny or b >= 1 - tiny
        out[last] = float(round(a)) if whole_a else a
        out[i] = float(round(b)) if whole_b else b
        last = None if whole_a and whole_b else (i if whole_a else last)
    return out, last


_ROW = T.StructType([T.StructField("source", T.StringType()), T.StructField("key", T.StringType()),
                     T.StructField("nth", T.LongType()), T.StructField("bucket", T.LongType()),
                     T.StructField("buckets", T.LongType()),
                     T.StructField("size", T.LongType()), T.StructField("share", T.DoubleType())])


def _reduce(seed: str, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what one leaves open meets ever smaller ones, which settle it
        rows = rows.sort_values(["size", "key", "nth"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        keys = list(zip(rows["key"], rows["nth"], strict=True))
        source = rows["source"].iloc[0]
        shares, last = pivotal_pass(keys, rows["size"].tolist(), rows["share"].tolist(),
                                    lambda i: _chance(seed, level, source, keys[i][0], int(keys[i][1])))
        if last is not None and rows["buckets"].iloc[0] <= 1:  # the root of this source's tree
            shares[last] = float(shares[last] >= 0.5)
        rows["share"] = shares
        return rows
    return run


def round_shares(rows: DataFrame, params: MixParams | None = None) -> DataFrame:
    """Round fractional shares: rows (source, key, nth, size, share) with 0 < share < 1 and
    size > 0, (source, key, nth) unique; returns the same rows, each share 0 or 1."""
    p = params or MixParams()
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("buckets", F.ceil(F.col("n") / p.group)).select(F.col("source").alias("s"), "buckets")
    # join by the null-safe key: the source table has one row for each source
    level_rows = (rows.join(counts, F.col("source").eqNullSafe(F.col("s")))
                  .withColumn("bucket", F.pmod(F.xxhash64(F.lit(p.seed), "key", "nth"), F.col("buckets")))
                  .select(*[f.name for f in _ROW]))
    level, done = 0, None
    while True:
        # dealt by both columns, so that a source with many documents is not one task
        dealt = level_rows.repartition("source", "bucket")
        out = cut_lineage(dealt.groupBy("source", "bucket").applyInPandas(_reduce(p.seed, level), _ROW))
        fractional = (F.col("share") > 0) & (F.col("share") < 1)
        settled = out.filter(~fractional)
        done = settled if done is None else done.unionByName(settled)
        left = out.filter(fractional)
        if left.isEmpty():
            return done.select("source", "key", "nth", "size", "share")
        level_rows = (left.withColumn("buckets", F.ceil(F.col("buckets") / p.group))
                      .withColumn("bucket", F.floor(F.col("bucket") / p.group)).select(*[f.name for f in _ROW]))
        level += 1


def mix(sized: DataFrame, params: MixParams | None = None) -> DataFrame:
    """Copies of each document: rows (key string, source, size) give (source, key, nth, size,
    source_size, target, copies). Rows that are alike in all three are numbered by ``nth``;
    they are counted and numbered anew, so they need no task of their own."""
    p = params or MixParams()
    alike = sized.groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("n"))
    alike = cut_lineage(alike)
    sizes = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, p).withColumnRenamed("source", "s")
    each = (alike.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
            .join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = (each.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)))
            .withColumn("whole", F.floor(F.col("rate") + 1e-12))
            .withColumn("share", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))))
    fractional = each.filter(F.col("share") > 1e-12)
    rounded = round_shares(fractional.select("source", "key", "nth", "size", "share"), p)
    rounded = rounded.select(F.col("source").alias("s"), F.col("key").alias("k"), F.col("nth").alias("m"),
                             F.col("size").alias("z"), F.col("share").alias("extra"))
    same = (F.col("source").eqNullSafe(F.col("s")) & F.col("key").eqNullSafe(F.col("k"))
            & (F.col("nth") == F.col("m")) & (F.col("size") == F.col("z")))
    return (each.join(rounded, same, "left")
            .select("source", "key", "nth", "size", "source_size", "target",
                    (F.col("whole") + F.coalesce("extra", F.lit(0.0))).cast("long").alias("copies")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op10: the mix of all documents at source weights 1, 2, 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = with_size(docs.select(F.col("doc_id").cast("string").alias("key"), "source", "text"))
    return mix(sized).select(F.col("key").cast("long").alias("doc_id"), "size", "source_size", "target",
                             (F.col("copies") * F.col("size")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix itself, each document as often as it is taken: the columns of
    ``docs`` and size, source_size, target and copy (from 1); such columns of ``docs`` are
    replaced. Rows alike in doc_id, text and source are copies of one of them."""
    new = ["size", "source_size", "target", "copy"]
    old = [c for c in docs.columns if c not in new]
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"))
    sized = with_size(docs.select(key.alias("key"), "source", "text"))
    wanted = (mix(sized).groupBy(F.col("key").alias("k"), F.col("source").alias("s"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"), F.first("size").alias("size"),
                   F.first("source_size").alias("source_size"), F.first("target").alias("target")).filter("copies > 0"))
    row = F.struct(*[F.col(f"`{c}`") for c in old])
    rows = docs.select(key.alias("key"), F.col("source").alias("own"), row.alias("row"))
    met = rows.join(cut_lineage(wanted), (F.col("key") == F.col("k")) & F.col("own").eqNullSafe(F.col("s")))
    once = met.filter("n = 1").select("row", "copies", "size", "source_size", "target")
    alike = (met.filter("n > 1").groupBy("k", "s")
             .agg(F.min_by("row", F.xxhash64("row")).alias("row"), *[F.first(c).alias(c) for c in ("copies", "size", "source_size", "target")])
             .select("row", "copies", "size", "source_size", "target"))
    each = once.unionByName(alike)
    return each.select("row.*", "size", "source_size", "target",
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
