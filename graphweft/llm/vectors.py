"""Near-duplicate vectors by an exact metric range join (operator 4).

Vectors on the unit sphere are within cosine c of each other if their distance is at most
r = sqrt(2 - 2c). Pivots drawn from the vectors partition them into cells of the nearest
pivot. A pair across two cells can only be that close if both its vectors are within r of
the plane between the two pivots, which bounds, by the triangle inequality, the vectors that
one cell must also see of another:

    d(x, q) <= d(x, p) + 2r    and    d(x, q)^2 - d(x, p)^2 <= 2 r d(p, q)

for x of the cell of p and a copy of it in the cell of q. Copies go to cells of a smaller
number only, so that each pair meets once. Each cell then is joined by itself; a cell with
many vectors is cut into blocks, and each pair of blocks is a task's share, so that no cell,
however full, is one task.

A share is compared by a matrix product in single precision with a margin, and what comes
near the threshold again in double precision, which decides. No pair leaves a task: it
returns each vector's number of links, and a spanning star of each linked set.

Vectors with equal components are one class from the start and count as many times as there
are of them.

Defined results: a vector that is null, empty, zero, or has null, NaN or infinite components
links with nothing; vectors of different lengths do not link. Repeated rows are vectors of
their own, and so are rows with the same vec_id; a null vec_id is larger than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.components import STRIP, components, spanning_stars
from graphweft.session import cut_lineage


@dataclass(frozen=True)
class RangeJoinParams:
    """Links need a cosine of ``cosine``. ``cell`` vectors are a cell on average, up to
    ``max_pivots`` pivots, which travel with every task; ``block`` vectors of a cell meet
    ``block`` others in one share."""

    cosine: float = 0.95
    cell: int = 4096
    max_pivots: int = 1024
    block: int = 4096


_MARGIN = 1e-4  # far above the rounding of a product of single-precision unit vectors


def _matrix(column) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    values = np.asarray(column.flatten(), dtype=np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # first to size, so that squares stay finite
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _assigner(shared, counting: bool, p: RangeJoinParams):
    """Home cell and copies of each vector: (cell, home, cls, weight, v), or, if counting, how
    many of them each cell gets: (cell, home, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: np.ndarray = shared.value
        k = len(pivots)
        between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
        r = np.sqrt(2 - 2 * p.cosine) + 1e-6
        counts = np.zeros((2, k), np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                x = _unit(_matrix(batch.column("v")))
                square = np.maximum(0, 2 - 2 * x @ pivots.T)
                home = square.argmin(axis=1)
                near = square[np.arange(len(x)), home]
                reach = np.sqrt(square) <= np.sqrt(near)[:, None] + 2 * r
                reach &= square - near[:, None] <= 2 * r * between[home] + 1e-9
                reach &= np.arange(k)[None] < home[:, None]
                reach[np.arange(len(x)), home] = True
                row, cell = np.nonzero(reach)
                at_home = cell == home[row]
                if counting:
                    for side in (0, 1):
                        counts[side] += np.bincount(cell[at_home == bool(side)], minlength=k)
                    continue
                own = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(at_home), own.column("cls"), own.column("weight"),
                     own.column("v")], ["cell", "home", "cls", "weight", "v"])
        if counting:
            side, cell = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(side == 1), pa.array(counts[side, cell])], ["cell", "home", "n"])
    return run


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _joiner(p: RangeJoinParams):
    """Compare the sides of a share: (a, b, n) rows, with a = b for the n links that a class
    has here, and n = 0 for the edges of spanning stars."""
    def run(share: pa.Table) -> pa.Table:
        side = share.column("side").to_numpy()
        v = share.column("v").combine_chunks()
        every = _matrix(v)
        ids, weights = share.column("cls").to_numpy(), share.column("weight").to_numpy()
        ia, ib = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2 meets itself
        unit = _unit(every).astype(np.float32)
        other = unit[ib].T
        linked = np.zeros((len(ia), len(ib)), bool)
        for lo in range(0, len(ia), STRIP):
            i, j = np.nonzero(unit[ia[lo:lo + STRIP]] @ other >= p.cosine - _MARGIN)
            i += lo
            ok = (side[ia[i]] != 2) | (ia[i] < ib[j])
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 1 << 16):
                x, y = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
                yes = _cosines(every[ia[x]], every[ib[y]]) >= p.cosine
                linked[x[yes], y[yes]] = True
        n = np.zeros(len(ids))
        for lo in range(0, len(ia), STRIP):
            strip = linked[lo:lo + STRIP].astype(np.float64)
            n[ia[lo:lo + STRIP]] += strip @ weights[ib]
            n[ib] += weights[ia[lo:lo + STRIP]] @ strip
        some = np.flatnonzero(n)
        stars = np.array(spanning_stars(linked, ids[ia], ids[ib]), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": np.concatenate([ids[some], stars[:, 0]]), "b": np.concatenate([ids[some], stars[:, 1]]),
                         "n": np.concatenate([n[some].astype(np.int64), np.zeros(len(stars), np.int64)])})
    return run


def _shares(placed: DataFrame, n_home: dict[int, int], n_copies: dict[int, int], p: RangeJoinParams) -> DataFrame:
    """Deal the vectors of cells to shares: home blocks meet each other and the blocks of
    copies. The counts of cells, of which there are ``max_pivots`` at most, give the blocks.

    side 0 and 1 are the two sides of a share, side 2 a home block that meets itself.
    """
    def blocks(n: dict[int, int], least: int) -> F.Column:
        per = {c: max(least, -(-k // p.block)) for c, k in n.items()}
        pairs = [F.lit(v) for c, k in sorted(per.items()) for v in (c, k)]
        return F.coalesce(F.create_map(*pairs)[F.col("cell")], F.lit(least)) if pairs else F.lit(least)

    known = placed.withColumn("own", blocks(n_home, 1)).withColumn("copied", blocks(n_copies, 0))
    h = F.xxhash64(F.lit("block"), "cls")
    rest = ["cls", "weight", "v"]

    def upto(n: str) -> F.Column:
        return F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")))

    home = known.filter("home").withColumn("block", F.pmod(h, F.col("own")).cast("int"))
    mine = home.select("cell", "block", upto("own").alias("other"), *rest).select(
        "cell", F.lit(False).alias("outer"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), *rest)
    seeing = home.select("cell", F.lit(True).alias("outer"), F.col("block").alias("x"), upto("copied").alias("y"),
                         F.lit(0).alias("side"), *rest)
    copies = known.filter("not home").withColumn("block", F.pmod(h, F.col("copied")).cast("int"))
    seen = copies.select("cell", F.lit(True).alias("outer"), upto("own").alias("x"), F.col("block").alias("y"),
                         F.lit(1).alias("side"), *rest)
    return mine.unionByName(seeing).unionByName(seen)


def _links(classes: DataFrame, p: RangeJoinParams) -> DataFrame:
    """(a, b, n) rows of all shares of classes (cls, weight, v) of one length."""
    spark = classes.sparkSession
    n_pivots = max(1, min(p.max_pivots, -(-classes.count() // p.cell)))
    drawn = classes.select("v", F.xxhash64(F.lit("pivot"), "v").alias("h")).orderBy("h").limit(n_pivots).select("v").toArrow()
    pivots = _unit(_matrix(drawn.column("v").combine_chunks()))
    shared = spark.sparkContext.broadcast(pivots)
    counted = (classes.select("v").mapInArrow(_assigner(shared, True, p), "cell int, home boolean, n bigint")
               .groupBy("cell", "home").agg(F.sum("n").alias("n")).collect())
    n_home = {r["cell"]: r["n"] for r in counted if r["home"]}
    n_copies = {r["cell"]: r["n"] for r in counted if not r["home"]}
    kind = classes.schema["v"].dataType.simpleString()
    placed = classes.mapInArrow(_assigner(shared, False, p), f"cell int, home boolean, cls bigint, weight bigint, v {kind}")
    shares = _shares(placed, n_home, n_copies, p)
    return shares.groupBy("cell", "outer", "x", "y").applyInArrow(_joiner(p), "a bigint, b bigint, n bigint")


def range_join(vectors: DataFrame, params: RangeJoinParams | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    p = params or RangeJoinParams()
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))

    def bad(x: F.Column) -> F.Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    fit = F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    fit = F.coalesce(fit, F.lit(False))
    grouped = rows.filter(fit).groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    classes = cut_lineage(grouped.withColumn("cls", F.monotonically_increasing_id()))
    sizes = [r["k"] for r in classes.select(F.size("v").alias("k")).distinct().collect()]
    parts = None
    for k in sorted(sizes):  # one, as a rule
        part = _links(classes.filter(F.size("v") == k).select("cls", "weight", "v"), p)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = vectors.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    parts = cut_lineage(parts)
    label = cut_lineage(components(parts.filter("a <> b").select("a", "b")))
    links = parts.filter("a = b").groupBy(F.col("a").alias("i")).agg(F.sum("n").alias("n"))
    named = (classes.select("cls", "least", "weight", "v").join(label, F.col("cls") == F.col("id"), "left")
             .select("cls", "least", "weight", "v", F.coalesce("component", "cls").alias("component")))
    named = named.join(links, F.col("cls") == F.col("i"), "left").select(
        "v", "component", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = cut_lineage(named)
    smallest = cut_lineage(named.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id")))
    named = named.join(smallest, F.col("component") == F.col("c")).select(F.col("v").alias("w"), "n_links", "component_id")
    named = cut_lineage(named)
    marked = rows.withColumn("fit", fit)
    joined = marked.join(named, F.col("fit") & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("fit"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.when(F.col("fit"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                         component.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op4: links and components of all embeddings."""
    return range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same by all pairs.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id),
c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN c ON c.id = e.vec_id
"""
