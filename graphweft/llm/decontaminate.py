"""Benchmark decontamination by greedy string tiling (operator 3).

A benchmark item counts as leaked into a document if enough of the item's words are covered
by tiles: runs of at least ``min_match`` words that stand in both texts, none overlapping
another in either text, longest first (Wise's greedy string tiling with running Karp-Rabin
hashes). The tiles may come in any order, so an item whose sentences were moved is found.

A tile is made of seeds, runs of ``min_match`` consecutive words. Documents are first reduced
to the runs of words whose seeds may be some item's: a fixed-size filter of all items' seeds
goes to every task, and clean documents leave next to nothing. Seeds of what is left are
joined with the items' seeds, and each pair with enough of them is tiled. Nothing that a tile
could use is lost on the way, whatever the size of the benchmark; a fuller filter only lets
more through to the join.

Words are runs of letters, digits and non-ASCII characters of lower-cased text.

Defined results: null or empty texts hold no words. An item with fewer than ``min_match``
words gives no evidence and is never found. Repeated rows are found alike, each of them; a
null doc_id or item_id is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm import words as W
from graphweft.llm.bitmaps import bitmap, columns, split
from graphweft.session import cut_lineage, text_batches


@dataclass(frozen=True)
class DecontaminationParams:
    """``min_match`` words make a tile, ``min_cover`` of an item's words make a leak."""

    min_match: int = 5
    min_cover: float = 0.8
    filter_bits: int = 26


def _seeds(found: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``size`` words within a row."""
    h = found.hashes
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h[:n].copy()
    for k in range(1, size):
        acc = W.mix(acc * np.uint64(3) + h[k:n + k])
    row = found.rows()
    at = np.flatnonzero(row[:n] == row[size - 1:])
    return acc[at], at


def _item_rows(p: DecontaminationParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, seeds, times = [], [], []
            for piece in W.slices(pc.utf8_lower(batch.column("text"))):
                found = W.words(piece, W.ALNUM, lower=False)
                h, at = _seeds(found, p.min_match)
                cut, own = found.row_first, np.searchsorted(at, found.row_first)
                for r in range(piece.n_rows):
                    tokens.append(found.hashes[cut[r]:cut[r + 1]].view(np.int64))
                    k, n = np.unique(h[own[r]:own[r + 1]].view(np.int64), return_counts=True)
                    seeds.append(k)
                    times.append(n)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *(pa.array(x, kind) for x in (tokens, seeds, times))],
                                             ["item_id", "item_words", "seeds", "times"])
    return run


def _reduced(shared, columns: list[str], p: DecontaminationParams):
    """Runs of words that seeds within the filter cover: all of a row's runs in one list, each
    followed by a 0 that parts it from the next, and the distinct seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens, seeds = [], [], []
            for piece in W.slices(pc.utf8_lower(batch.column("__text"))):
                found = W.words(piece, W.ALNUM, lower=False)
                h, at = _seeds(found, p.min_match)
                hit = shared.value.has(h)
                h, at = h[hit], at[hit]
                if not len(at):
                    continue
                row = np.searchsorted(found.row_first, at, side="right") - 1
                # words covered by any seed, and where a run of them begins
                mark = np.zeros(len(found.hashes) + 1, np.int32)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + p.min_match, -1)
                covered = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                # a run also ends between words that no seed joins
                joined = np.zeros(len(found.hashes) + 1, np.int32)
                np.add.at(joined, at + 1, 1)
                np.add.at(joined, at + p.min_match, -1)
                follows = (np.cumsum(joined[:-1]) > 0)[covered]
                covered_row = np.searchsorted(found.row_first, covered, side="right") - 1
                for r in np.unique(row).tolist():
                    own = covered_row == r
                    parts = np.split(found.hashes[covered[own]].view(np.int64), np.flatnonzero(~follows[own])[1:])
                    tokens.append(np.concatenate([np.append(x, 0) for x in parts]))
                    seeds.append(np.unique(h[row == r].view(np.int64)))
                    rows.append(piece.first_row + r)
            kind = pa.list_(pa.int64())
            own = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(c) for c in columns] + [pa.array(tokens, kind), pa.array(seeds, kind)],
                                             [*columns, "doc_words", "seeds"])
    return run


def tile(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, length) of each tile.

    In each round the longest common runs of words that no tile has marked are found, and
    those that do not overlap are marked, in order of their places. Runs of a length are
    found by rolling hashes of that length: the length is searched between ``min_match`` and
    the last round's, since a run of some length holds runs of all smaller ones.
    """
    free_i, free_d = np.ones(len(item), bool), (doc != 0)
    tiles: list[tuple[int, int, int]] = []

    def windows(x: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of free windows of n words and their Karp-Rabin hashes."""
        if len(x) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = W._power_tables(len(x))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x.view(np.uint64) * up[:len(x)], dtype=np.uint64)])
        gaps = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(gaps[n:] == gaps[:-n])
        return at, (sums[at + n] - sums[at]) * down[at]

    def common(n: int) -> list[tuple[int, int]]:
        ai, hi = windows(item, free_i, n)
        ad, hd = windows(doc, free_d, n)
        order = np.argsort(hd, kind="stable")
        lo, up = np.searchsorted(hd[order], hi, "left"), np.searchsorted(hd[order], hi, "right")
        out = []
        for k in np.flatnonzero(up > lo).tolist():
            out.append((int(ai[k]), ad[order[lo[k]:up[k]]]))
        return out

    longest = min(len(item), len(doc))
    while longest >= min_match:
        # largest length with a common run
        low, high, best = min_match, longest, []
        while low <= high:
            mid = (low + high + 1) // 2 if low < high else low
            found = common(mid)
            if found:
                best, low, length = found, mid + 1, mid
            else:
                high = mid - 1
        if not best:
            break
        marked = 0
        for a, places in best:
            if not free_i[a:a + length].all():
                continue
            for b in places.tolist():
                if free_d[b:b + length].all() and np.array_equal(item[a:a + length], doc[b:b + length]):
                    tiles.append((a, b, length))
                    marked += 1
                    free_i[a:a + length] = False
                    free_d[b:b + length] = False
                    break
        longest = length if marked else length - 1  # none: equal hashes of unequal runs
    return tiles


def _tiler(columns: list[str], p: DecontaminationParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, n_words, n_tiles = [], [], []
            items, docs = batch.column("item_words"), batch.column("doc_words")
            for k in range(batch.num_rows):
                item = np.asarray(items[k].values, dtype=np.int64)
                tiles = tile(item, np.asarray(docs[k].values, dtype=np.int64), p.min_match)
                covered.append(sum(t[2] for t in tiles))
                n_words.append(len(item))
                n_tiles.append(len(tiles))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(x, pa.int64()) for x in (n_words, covered, n_tiles)],
                [*columns, "item_words_n", "covered", "tiles"])
    return run


def leaks(documents: DataFrame, benchmark: DataFrame, params: DecontaminationParams | None = None,
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pairs of documents (text) and benchmark items (item_id, text) with a leak: columns
    ``keep`` of the document, item_id, item_words, covered_words, tiles and coverage."""
    p = params or DecontaminationParams()
    own_id = F.struct(*[F.col(c) for c in keep]).alias("row")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        _item_rows(p), "item_id bigint, item_words array<bigint>, seeds array<bigint>, times array<bigint>")
    items = cut_lineage(items.withColumn("item", F.monotonically_increasing_id()))
    item_seeds = (items.select("item", F.size("item_words").alias("n"), F.explode(F.arrays_zip("seeds", "times")).alias("s"))
                  .select("item", "n", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times")))
    filled = bitmap(item_seeds, F.col("seed"), p.filter_bits)
    shared = documents.sparkSession.sparkContext.broadcast(filled)
    rows = documents.select(own_id, F.col("text").alias("__text"))
    words, seeds = (T.StructField(n, T.ArrayType(T.LongType())) for n in ("doc_words", "seeds"))
    reduced = rows.mapInArrow(_reduced(shared, ["row"], p), T.StructType([rows.schema["row"], words, seeds]))
    with text_batches(documents.sparkSession):
        reduced = cut_lineage(reduced.withColumn("doc", F.monotonically_increasing_id()))
    doc_seeds = reduced.select("doc", F.explode("seeds").alias("own"))
    met = doc_seeds.join(item_seeds, F.col("own") == F.col("seed"))
    # t tiles that cover m words hold m - t (min_match - 1) of the item's seeds, which is
    # m / min_match at least, as t is m / min_match at most
    least = F.ceil(F.col("n") * p.min_cover - 1e-9) / p.min_match
    pairs = met.groupBy("doc", "item").agg(F.sum("times").alias("places"), F.first("n").alias("n"))
    pairs = cut_lineage(pairs.filter(F.col("places") >= least).select("doc", "item"))
    own = items.select(F.col("item").alias("i"), "item_id", "item_words")
    text = reduced.select(F.col("doc").alias("d"), "row", "doc_words")
    both = (pairs.join(own, F.col("item") == F.col("i")).join(text, F.col("doc") == F.col("d"))
            .select("row", "item_id", "item_words", "doc_words"))
    schema = T.StructType([both.schema["row"], both.schema["item_id"]]
                          + [T.StructField(n, T.LongType()) for n in ("item_words_n", "covered", "tiles")])
    tiled = both.mapInArrow(_tiler(["row", "item_id"], p), schema)
    coverage = F.col("covered") / F.col("item_words_n")
    return tiled.filter(F.col("covered") >= F.col("item_words_n") * p.min_cover - 1e-9).select(
        "row.*", "item_id", F.col("item_words_n").alias("item_words"), F.col("covered").alias("covered_words"),
        "tiles", coverage.alias("coverage"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document and benchmark item of which it holds a leak."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go, all others stay unchanged."""
    keyed = docs.select(F.xxhash64("text").alias("__hash"), *columns(docs))
    found = leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("doc_id", "__hash"))
    found = cut_lineage(found.select("doc_id", "__hash").distinct())
    rest, some = split(keyed, found, ["doc_id", "__hash"])
    found = found.select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h"))
    some = some.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left_anti")
    return rest.unionByName(some).select(*columns(docs))
