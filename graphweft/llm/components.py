"""Connected components of long-id edges (helper of the near-duplicate operators)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphweft.session import cut_lineage, release

#: the stars below need O(log^2 n) rounds; this many mean that something is wrong
MAX_ROUNDS = 200


def _smaller_first(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return (pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
            .filter(F.col("a") < F.col("b")).distinct())


def _written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The pairs, written, and what tells them from other pairs."""
    seen = Observation()
    code = [F.bit_xor(F.xxhash64(F.lit(k), "a", "b")).alias(f"h{k}") for k in (1, 2)]
    out = cut_lineage(pairs.observe(seen, F.count(F.lit(1)).alias("n"), *code))
    found = seen.get
    return out, (found["n"], found["h1"], found["h2"])


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) of every id in ``edges`` (a, b); component is the smallest id
    that can be reached.

    Alternating large and small stars (Kiveris et al., 2014). The least neighbour of each id
    is written before it is joined, so that both sides of the join are plain exchanges and
    Spark can split those of an id with very many neighbours. Whether a round changed the edges
    is told by a count and hashes of them, observed while they are written; tables of a round
    are deleted when the next one has read them.
    """
    e, seen = _written(_smaller_first(edges, "a", "b"))
    for _ in range(MAX_ROUNDS):
        # large star: larger neighbours of u go to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m")))
        larger = e.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = cut_lineage(larger.distinct())
        release(least)
        # small star: u and its smaller neighbours go to the least of these
        least = cut_lineage(large.groupBy(F.col("x").alias("u")).agg(F.min("y").alias("m")))
        joined = large.join(least, F.col("x") == F.col("u"))
        small = joined.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(
            least.select(F.col("u").alias("x"), F.col("m").alias("y")))
        new, now = _written(_smaller_first(small, "x", "y"))
        release(e, large, least)
        e = new
        if now == seen:
            roots = e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
            return e.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots)
        seen = now
    raise RuntimeError(f"components are not found after {MAX_ROUNDS} rounds")


#: rows of a share that are compared with its other side at once
STRIP = 512


def spanning_stars(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spanning stars (least id, other id) of the sets that a boolean matrix links."""
    some_a, some_b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    ids, at = np.unique(np.concatenate([a[some_a], b[some_b]]), return_inverse=True)
    if not len(ids):
        return []
    ia, ib = at[:len(some_a)], at[len(some_a):]
    m = linked[np.ix_(some_a, some_b)]
    none = np.int32(len(ids))
    label = np.arange(len(ids), dtype=np.int32)
    while True:
        # rows take the least label of their columns, then columns that of their rows
        new = label.copy()
        for lo in range(0, len(ia), STRIP):
            least = np.where(m[lo:lo + STRIP], new[ib][None], none).min(axis=1)
            np.minimum.at(new, ia[lo:lo + STRIP], least)
            across = np.where(m[lo:lo + STRIP], new[ia[lo:lo + STRIP]][:, None], none).min(axis=0)
            np.minimum.at(new, ib, across)
        if np.array_equal(new, label):
            return [(int(ids[root]), int(x)) for root, x in zip(label, ids, strict=True) if ids[root] != x]
        label = new
