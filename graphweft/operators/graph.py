"""Graph analytics on (vertices, edges) DataFrames.

Iterative algorithms run one Spark job per round from a driver loop that only fetches a
scalar or two per round (convergence). Each round's state is persisted and the lineage is
cut with a reliable checkpoint every few rounds, so a lost executor recomputes at most a
few rounds from the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F

from graphweft.functions import vectors as vec
from graphweft.functions.random import uniform
from graphweft.operators import aggregates as agg
from graphweft.operators import hubs
from graphweft.session import ROWS_PER_TASK, cut_lineage, release, rounds_on, shuffle_partitions, tasks_for


@dataclass
class Graph:
    """H9: a directed multigraph. ``vertices``: id (+ attributes); ``edges``: source_id,
    relation, target_id (parallel edges allowed). Vertices come first, so isolates stay."""
    vertices: DataFrame
    edges: DataFrame

    @property
    def all_vertices(self) -> DataFrame:
        """Vertices plus any edge endpoint missing from them (as adding an edge would)."""
        ends = self.edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
        return self.vertices.select("id").unionByName(ends).distinct()

    def undirected(self) -> DataFrame:
        """H9: simple undirected view: (a, b) with a < b, self-loops dropped."""
        return (self.edges.where(F.col("source_id") != F.col("target_id"))
                .select(F.least("source_id", "target_id").alias("a"),
                        F.greatest("source_id", "target_id").alias("b"))
                .distinct())


def build_graph(vertices: DataFrame, edges: DataFrame, relations: Sequence[str] | None = None) -> Graph:
    e = edges.where(F.col("relation").isin(list(relations))) if relations else edges
    return Graph(vertices, e)


def _persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


# --- H1 PageRank ------------------------------------------------------------------------

def _dealt_by_source(w: DataFrame, hot: DataFrame, tasks: int) -> DataFrame:
    """Weights of edges in the partitions of their source's copies: id, _copy, target_id, w."""
    return (hubs.deal(w, hot, "source_id", ["target_id"])
            .select(F.col("source_id").alias("id"), "_copy", "target_id", "w")
            .repartition(tasks, "id", "_copy"))


def pagerank(g: Graph, alpha: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6,
             checkpoint_interval: int = 5, fail_on_no_convergence: bool = True) -> DataFrame:
    """H1: PageRank of the directed multigraph (parallel edges add weight).

    Start 1/N, dangling mass spread uniformly, stop when the L1 change is below N*tol;
    raises if ``max_iter`` rounds do not get there (``tol=None`` runs exactly ``max_iter``
    rounds). Returns id, pagerank.

    Plan: multi-edges are collapsed once into weights and dealt by source, hot sources over
    copies (``hubs``), and stay where they are; a round moves only the ranks: a node sends each
    of its copies its rank over its out-weight, one join meets them with the weights, one
    aggregation by target sums up. Rounds run on as many partitions as the graph fills with
    ``ROWS_PER_TASK``, at most the session's, so that a small graph's many rounds do not consist of
    starting tasks. Only two scalars per round reach the driver (dangling mass and the L1 change).
    Tables of superseded rounds are deleted.
    """
    spark = g.edges.sparkSession
    w = cut_lineage(g.edges.where(F.col("source_id").isNotNull())
                    .groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("w")))
    nodes = cut_lineage(g.all_vertices)
    tasks = tasks_for(spark, max(w.count(), nodes.count()), ROWS_PER_TASK)
    with shuffle_partitions(spark, tasks):
        result = _pagerank_rounds(w, nodes, tasks, alpha, max_iter, tol, checkpoint_interval, fail_on_no_convergence)
    release(w, nodes)
    return result


def _pagerank_rounds(w: DataFrame, nodes: DataFrame, tasks: int, alpha: float, max_iter: int, tol: float | None,
                     checkpoint_interval: int, fail_on_no_convergence: bool) -> DataFrame:
    """The rounds of ``pagerank`` over collapsed edges (source_id, target_id, w) and vertices (id)."""
    hot = F.broadcast(cut_lineage(hubs.hot_nodes(w, "source_id", tasks)))
    trans = _persist(_dealt_by_source(w, hot, tasks))
    out_w = w.groupBy(F.col("source_id").alias("id")).agg(F.sum("w").alias("out_w"))
    verts = cut_lineage(nodes.join(out_w, "id", "left")
                        .join(hot.withColumnRenamed("source_id", "id"), "id", "left")
                        .select("id", "out_w", "_copies"))
    n, dangling = verts.agg(F.count(F.lit(1)), F.count(F.when(F.col("out_w").isNull(), 1))).first()
    if n == 0:
        trans.unpersist()
        return cut_lineage(verts.select("id", F.lit(0.0).alias("pagerank")))
    state, dangling_mass = verts.withColumn("pagerank", F.lit(1.0 / n)), dangling / n
    previous, written = None, verts
    for it in range(1, max_iter + 1):
        sent = hubs.copies_of(state.where(F.col("out_w").isNotNull())
                              .select("id", "_copies", (F.col("pagerank") / F.col("out_w")).alias("_s")))
        contrib = (trans.join(sent, ["id", "_copy"])
                   .groupBy(F.col("target_id").alias("id"))
                   .agg(F.sum(F.col("_s") * F.col("w")).alias("c")))
        base = (1.0 - alpha) / n + alpha * dangling_mass / n
        new = (state.withColumnRenamed("pagerank", "_old").join(contrib, "id", "left")
               .select("id", "out_w", "_copies", "_old",
                       (F.lit(alpha) * F.coalesce(F.col("c"), F.lit(0.0)) + F.lit(base)).alias("pagerank")))
        cut = it % checkpoint_interval == 0
        new = cut_lineage(new) if cut else _persist(new)
        stats = new.agg(F.sum(F.abs(F.col("pagerank") - F.col("_old"))).alias("err"),
                        F.sum(F.when(F.col("out_w").isNull(), F.col("pagerank"))).alias("dm")).first()
        if previous is not None:
            previous.unpersist()
        if cut:
            release(written)
            written = new
        previous, state = new, new.drop("_old")
        dangling_mass = stats["dm"] or 0.0
        if tol is not None and stats["err"] < n * tol:
            break
    else:
        if tol is not None and fail_on_no_convergence:
            raise RuntimeError(f"pagerank did not converge in {max_iter} rounds")
    result = cut_lineage(state.select("id", "pagerank"))
    if previous is not None:
        previous.unpersist()
    trans.unpersist()
    release(written)
    return result


# --- H2 degree centrality -----------------------------------------------------------------

def degree_centrality(g: Graph) -> DataFrame:
    """H2: (in + out degree) / (N - 1) for every vertex; multi-edges and self-loops count."""
    verts = g.all_vertices
    n = verts.count()
    d = agg.degree(g.edges.withColumn("relation", F.lit("_")), ["_"])
    scale = 1.0 / (n - 1) if n > 1 else 1.0
    return (verts.join(d, "id", "left")
            .select("id", (F.coalesce(F.col("degree"), F.lit(0)) * F.lit(scale)).alias("degree_centrality")))


# --- H4 connected components ------------------------------------------------------------

def _checksum(e: DataFrame):
    h = F.xxhash64("a", "b")
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
              F.sum(F.pmod(h, F.lit(2147483647))).alias("s")).first()
    return r["n"], r["x"], r["s"]


def connected_components(g: Graph, max_iter: int = 200, checkpoint_interval: int = 2) -> DataFrame:
    """H4: undirected connected components; component = smallest vertex id in it.

    Alternating large-star / small-star (Kiveris et al., SoCC 2014) on the undirected edge
    set; each step is a min-aggregation per vertex and a join, O(log^2 n) rounds. It stops
    when a round leaves the edge set unchanged (count and order-free hash). Isolated
    vertices are their own component. Returns id, component.
    """
    spark, e = g.edges.sparkSession, _persist(g.undirected())
    last = _checksum(e)
    with rounds_on(spark, tasks_for(spark, 2 * last[0])):
        labelled = _star_rounds(e, last, max_iter, checkpoint_interval)
    return (g.all_vertices.join(labelled, "id", "left")
            .select("id", F.coalesce(F.col("component"), F.col("id")).alias("component")))


def _star_rounds(e: DataFrame, last: tuple, max_iter: int, checkpoint_interval: int) -> DataFrame:
    """The rounds of ``connected_components`` over persisted edges (a, b), a < b, and their checksum."""
    for it in range(1, max_iter + 1):
        # large star: every neighbour larger than u links to min(N(u) + u)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where(F.col("b") > F.col("a")).join(m, "a")
                 .select(F.col("b").alias("x"), F.col("m").alias("y")))
        large = (large.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                 .where(F.col("a") != F.col("b")).distinct())
        # small star: u and its smaller neighbours link to min(smaller N(u) + u)
        both2 = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
        m2 = both2.groupBy("u").agg(F.min("v").alias("m"))
        small = (both2.join(m2, "u")
                 .select(F.explode(F.array(
                     F.struct(F.col("v").alias("x"), F.col("m").alias("y")),
                     F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("s"))
                 .select(F.least("s.x", "s.y").alias("a"), F.greatest("s.x", "s.y").alias("b"))
                 .where(F.col("a") != F.col("b")).distinct())
        small = cut_lineage(small) if it % checkpoint_interval == 0 else _persist(small)
        cur = _checksum(small)
        e.unpersist()
        e = small
        if cur == last:
            break
        last = cur
    else:
        raise RuntimeError(f"connected components did not settle in {max_iter} rounds")
    comp = e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    roots = e.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    labelled = cut_lineage(comp.unionByName(roots).groupBy("id").agg(F.min("component").alias("component")))
    e.unpersist()
    return labelled


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_component_share(components: DataFrame, labels: DataFrame) -> DataFrame:
    """H4 + C18: per label, % of its users inside the largest component (ties: smaller id)."""
    sizes = component_sizes(components)
    top = sizes.orderBy(F.desc("size"), F.asc("component")).limit(1).select("component")
    flagged = (components.join(top.withColumn("in_largest", F.lit(True)), "component", "left")
               .select("id", F.coalesce("in_largest", F.lit(False)).alias("in_largest")))
    return (labels.join(flagged, "id", "left")
            .groupBy("label")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.avg(F.coalesce(F.col("in_largest"), F.lit(False)).cast("double")) * 100, 4)
                 .alias("pct_in_largest")))


# --- D21 adjacency sets ---------------------------------------------------------------------

def adjacency_sets(edges: DataFrame) -> DataFrame:
    """The undirected, deduplicated adjacency as rows (id, neighbour).

    Each node's set is the rows with its id; it is never gathered into one array, because a
    hub's neighbour list is as long as its degree.
    """
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbour")).unionByName(
        edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbour")))
    return both.distinct()


# --- H7 / H8 relational aggregation -----------------------------------------------------

def relational_mean(edges: DataFrame, features: DataFrame, vec_col: str = "vec") -> DataFrame:
    """H7: per target and relation, the element-wise mean of its sources' vectors
    (u -> v in r sends x_u to v): id, relation, vec. Nodes without in-edges of a relation
    get no row (the model adds nothing for them).

    Whole vectors meet the edges; a hub target's messages are merged into one vector by each
    task before the shuffle (``vectors.mean_by``).
    """
    x = features.select(F.col("id").alias("source_id"), F.col(vec_col).alias("vec"))
    msg = (edges.select("source_id", "relation", F.col("target_id").alias("id")).join(x, "source_id"))
    return vec.mean_by(msg, ["id", "relation"], "vec")


def normalised_relational_sum(edges: DataFrame, features: DataFrame, vec_col: str = "vec",
                              keys: Sequence[str] = ()) -> DataFrame:
    """H8: per row node and relation, sum over its edges row -> col of
    ``d(row)^-1/2 * d(col)^-1/2 * x_col`` where d counts a node's occurrences as *row* within
    the relation (a col that is never a row weighs 0): id, relation, vec. With ``keys`` (say, a
    snapshot's number) each of their values is a graph of its own.

    The weights depend only on (row, col, relation), so parallel edges are collapsed into a
    multiplicity before the vectors are joined in; a pair carries one whole, scaled vector.
    """
    k = list(keys)
    e = edges.select(*k, F.col("source_id").alias("row"), "relation", F.col("target_id").alias("col"))
    d = e.groupBy(*k, F.col("row").alias("node"), "relation").agg(F.count(F.lit(1)).alias("d"))
    pairs = e.groupBy(*k, "row", "relation", "col").agg(F.count(F.lit(1)).alias("mult"))
    dr = d.select(*k, F.col("node").alias("row"), "relation", F.col("d").alias("d_row"))
    dc = d.select(*k, F.col("node").alias("col"), "relation", F.col("d").alias("d_col"))
    wts = (pairs.join(dr, [*k, "row", "relation"]).join(dc, [*k, "col", "relation"], "left")
           .select(*k, "row", "relation", "col",
                   (F.col("mult") * F.pow(F.col("d_row"), -0.5)
                    * F.coalesce(F.pow(F.col("d_col"), -0.5), F.lit(0.0))).alias("w")))
    x = features.select(F.col("id").alias("col"), F.col(vec_col).alias("x"))
    s = wts.join(x, "col").select(*k, F.col("row").alias("id"), "relation", vec.scale(F.col("x"), F.col("w")).alias("vec"))
    return vec.sum_by(s, [*k, "id", "relation"], "vec")


def with_own_term(sums: DataFrame, features: DataFrame, keys: Sequence[str] = (), vec_col: str = "vec") -> DataFrame:
    """H8 with identity weights: a node's own vector plus its relations' sums: (keys,) id, vec.

    ``features`` (keys, id, vec) has the nodes of each graph; nodes without edges keep their
    own vector."""
    k = [*keys, "id"]
    own = features.select(*k, F.col(vec_col).cast("array<double>").alias("vec"))
    return vec.sum_by(own.unionByName(sums.select(*k, "vec")), k, "vec")


def relational_sum_changes(edges: DataFrame, features: DataFrame, nodes: DataFrame, dim: int,
                           vec_col: str = "vec") -> DataFrame:
    """H8 with identity weights in the cumulative graphs of all snapshots, as change rows: id,
    snapshot_idx, pos, value. A node has rows at its own snapshot and wherever an edge of it or a
    degree that weighs in its sum is new; its value in snapshot i is the row with the largest
    snapshot_idx <= i.

    ``edges`` (source_id, relation, target_id, first_snapshot), ``features`` (id, vec of ``dim``),
    ``nodes`` (id, first_snapshot). A pair sends its scaled vector only when its weight changes.
    Running sums are taken of whole rows, with a column for each element, and only the result has a
    row for each, so that no sort or hash table of a task holds ``dim`` rows for a vector.
    """
    at_pos = vec.flat_columns(dim)
    at = F.col("first_snapshot").cast("bigint").alias("snapshot_idx")
    e = edges.where(F.col("first_snapshot").isNotNull()).select(
        F.col("source_id").alias("row"), "relation", F.col("target_id").alias("col"), at)

    def upto(*keys: str) -> WindowSpec:
        return Window.partitionBy(*keys).orderBy("snapshot_idx").rowsBetween(Window.unboundedPreceding, 0)

    def change(value: Column, *keys: str) -> Column:
        return value - F.coalesce(F.lag(value).over(Window.partitionBy(*keys).orderBy("snapshot_idx")), F.lit(0.0))

    each = e.groupBy("row", "relation", "snapshot_idx").agg(F.count(F.lit(1)).alias("n"))
    degree = each.select("row", "relation", "snapshot_idx", F.sum("n").over(upto("row", "relation")).alias("d"))
    new = e.groupBy("row", "relation", "col", "snapshot_idx").agg(F.count(F.lit(1)).alias("n"))
    of_col = degree.select(F.col("row").alias("col"), "relation", "snapshot_idx", "d")
    turned = e.select("row", "relation", "col").distinct().join(of_col, ["col", "relation"])
    pair = ["row", "relation", "col"]
    steps = (new.withColumn("d", F.lit(None).cast("bigint"))
             .unionByName(turned.withColumn("n", F.lit(0).cast("bigint")))
             .groupBy(*pair, "snapshot_idx").agg(F.sum("n").alias("n"), F.max("d").alias("d")))
    # a col that is never a row weighs 0
    weight = F.sum("n").over(upto(*pair)) * F.coalesce(F.pow(F.last("d", True).over(upto(*pair)), -0.5), F.lit(0.0))
    steps = steps.select(*pair, "snapshot_idx", weight.alias("w"))
    steps = steps.select(*pair, "snapshot_idx", change(F.col("w"), *pair).alias("w")).where("w != 0")
    x = features.select(F.col("id").alias("col"), F.col(vec_col).alias("x"))
    sent = steps.join(x, "col").select("row", "relation", "snapshot_idx", vec.scale(F.col("x"), F.col("w")).alias("vec"))
    sums = vec.sum_by(sent, ["row", "relation", "snapshot_idx"], "vec").withColumn("d", F.lit(None).cast("bigint"))
    key, long = ["row", "relation"], ["row", "relation", "snapshot_idx", "d"]
    both = sums.select(*long, "vec").unionByName(degree.select(*long, vec.zeros(dim).alias("vec")))
    both = (vec.flat(both, long, "vec", dim).groupBy(*key, "snapshot_idx")
            .agg(*[F.sum(c).alias(c) for c in at_pos], F.max("d").alias("d")))
    root = F.coalesce(F.pow(F.last("d", True).over(upto(*key)), -0.5), F.lit(0.0))
    both = both.select(*key, "snapshot_idx", *[(F.sum(c).over(upto(*key)) * root).alias(c) for c in at_pos])
    both = both.select(F.col("row").alias("id"), "snapshot_idx", *[change(F.col(c), *key).alias(c) for c in at_pos])
    born = nodes.where(F.col("first_snapshot").isNotNull()).select("id", at)
    own = vec.flat(born.join(features.where(F.col(vec_col).isNotNull()), "id"), ["id", "snapshot_idx"], vec_col, dim)
    every = own.unionByName(both).groupBy("id", "snapshot_idx").agg(*[F.sum(c).alias(c) for c in at_pos])
    total = every.select("id", "snapshot_idx", *[F.sum(c).over(upto("id")).alias(c) for c in at_pos])
    return total.select("id", "snapshot_idx", F.posexplode(F.array(*at_pos)).alias("pos", "value"))


def _relation_blocks(edges: DataFrame, cur: DataFrame, relations: Sequence[str]) -> DataFrame:
    """id, vec and one mean-of-sources vector per relation, ``r_<relation>`` (zeros where a node
    has no in-edge)."""
    m = relational_mean(edges.where(F.col("relation").isin(list(relations))), cur, "vec")
    wide = m.groupBy("id").agg(*[F.first(F.when(F.col("relation") == r, F.col("vec")), ignorenulls=True).alias(f"r_{r}")
                                 for r in relations])
    none = F.transform("vec", lambda x: F.lit(0.0))
    return cur.join(wide, "id", "left").select(
        "id", "vec", *[F.coalesce(F.col(f"r_{r}"), none).alias(f"r_{r}") for r in relations])


def _root_sum(relations: Sequence[str]) -> Column:
    """A node's own vector plus its relation blocks."""
    return F.aggregate(F.array(*[F.col(f"r_{r}") for r in relations]), F.col("vec"), lambda acc, x: vec.add(acc, x))


def rgcn_propagate(features: DataFrame, edges: DataFrame, relations: Sequence[str],
                   vec_col: str = "vec") -> DataFrame:
    """H7 with identity weights: h_v = x_v + sum_r mean_{u -> v in r} x_u. Returns id, vec.

    The features are written once, because both the messages and a node's own term read them."""
    cur = cut_lineage(features.select("id", F.col(vec_col).cast("array<double>").alias("vec")))
    return _relation_blocks(edges, cur, relations).select("id", _root_sum(relations).alias("vec"))


def stacked_neighbour_features(features: DataFrame, edges: DataFrame, relations: Sequence[str],
                               hops: int = 2, vec_col: str = "vec") -> DataFrame:
    """I8 input: SIGN-style precomputed features (Frasca et al. 2020).

    features = [x, mean_r(x) for r, mean_r(h1) for r, ...] with h1 = rgcn_propagate(x):
    what a two-layer relational GCN sees, computed once as Spark joins so that any Spark ML
    classifier can be trained on it. Each hop reads the written blocks of the hop before.
    Returns id, features (array<double>).
    """
    edges = cut_lineage(edges.select("source_id", "relation", "target_id"))
    cur = cut_lineage(features.select("id", F.col(vec_col).cast("array<double>").alias("vec")))
    out = cur.select("id", F.col("vec").alias("features"))
    for h in range(1, hops + 1):
        blocks = cut_lineage(_relation_blocks(edges, cur, relations))
        out = out.join(blocks.drop("vec"), "id").select(
            "id", F.concat(F.col("features"), *[F.col(f"r_{r}") for r in relations]).alias("features"))
        cur = blocks.select("id", _root_sum(relations).alias("vec"))
    return out


# --- H3 communities ------------------------------------------------------------------------

def weighted_edges(edges: DataFrame) -> DataFrame:
    """Directed weighted view of a multigraph: src, dst, w = number of parallel edges."""
    return (edges.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
            .agg(F.count(F.lit(1)).cast("double").alias("w")))


def modularity(ew: DataFrame, communities: DataFrame, resolution: float = 1.0) -> float:
    """H3: directed modularity (Leicht-Newman) of a partition of a weighted digraph:
    Q = L_in/m - resolution * sum_c Kout_c * Kin_c / m^2. ``ew``: src, dst, w;
    ``communities``: id, community (every endpoint must have one). One job."""
    c = communities.select("id", "community")
    j = (ew.join(c.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src")
         .join(c.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst"))
    inside = F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(F.lit(0.0))
    rows = j.select(F.explode(F.array(
        F.struct(F.col("cs").alias("c"), F.col("w").alias("o"), F.lit(0.0).alias("i"), inside.alias("l")),
        F.struct(F.col("cd").alias("c"), F.lit(0.0).alias("o"), F.col("w").alias("i"), F.lit(0.0).alias("l"))))
        .alias("r")).select("r.*")
    per = rows.groupBy("c").agg(F.sum("o").alias("kout"), F.sum("i").alias("kin"), F.sum("l").alias("l"))
    t = per.agg(F.sum("kout").alias("m"), F.sum("l").alias("l"),
                F.sum(F.col("kout") * F.col("kin")).alias("kk")).first()
    m = t["m"] or 0.0
    if m == 0:
        return 0.0
    return (t["l"] or 0.0) / m - resolution * (t["kk"] or 0.0) / (m * m)


#: rows that a task of Louvain's rounds holds at least: each task's figures go to the driver, in every round
MOVED_ROWS_PER_TASK = 250_000

#: rounds in a row that lose modularity after which a level is settled; each of them moves half
#: as many nodes at once as the one before, as moves at once can spoil each other's gains
IDLE_ROUNDS = 3

#: a level is settled, too, after two rounds that gained less than this share of what it has gained
SETTLED = 0.03


def _move_round(state: DataFrame, nb: DataFrame, m: float, resolution: float, up: bool, share: Column) -> tuple[DataFrame, Row]:
    """One round of moves from ``state`` (id, community, before, kout, kin, waiting).

    ``nb`` (i, j, w) lies in partitions by i and stays there: nodes meet their edges, and moved
    nodes their neighbours, in place, by hash tables of the nodes of a partition.

    Looked at are nodes that wait, nodes that moved in the round before and their neighbours.
    Each goes to the neighbouring community of best directed modularity gain (ties: smallest
    id), but to larger community ids only (``up``) or to smaller ones only, so that two nodes
    do not just change places; a node that gains only the other way, or is not in the
    ``share``, waits. Returns the written state after the round and its figures: ``moved``,
    ``waits``, ``product`` (the sum of kout * kin over communities) and ``inside``, the weight
    within communities that the moves of the round *before* added.
    """
    def by_hash(rows: DataFrame) -> DataFrame:  # one row for each key: no side has to be sorted
        return rows.hint("shuffle_hash")

    state = state.drop("inside")
    changed = state.where(F.col("community") != F.col("before")).select(F.col("id").alias("i"))
    look = (state.where("waiting").select("id").unionByName(changed.select(F.col("i").alias("id")))
            .unionByName(nb.join(by_hash(changed), "i", "left_semi").select(F.col("j").alias("id"))).distinct())
    node = ["i", "own", "was", "kout", "kin"]
    active = state.join(by_hash(look), "id").select(F.col("id").alias("i"), F.col("community").alias("own"),
                                           F.col("before").alias("was"), "kout", "kin")
    other = state.select(F.col("id").alias("j"), F.col("community").alias("c"), F.col("before").alias("c_was"))
    ends = nb.join(by_hash(active), "i").join(by_hash(other), "j")
    # an edge whose ends both moved is met from both of them
    half = F.when(F.col("c") != F.col("c_was"), 0.5).otherwise(1.0)
    more = (F.col("own") == F.col("c")).cast("double") - (F.col("was") == F.col("c_was")).cast("double")
    inside = F.when(F.col("own") != F.col("was"), F.col("w") * more * half).otherwise(0.0)
    links = (ends.select(*node, "c", "w", inside.alias("inside"))
             .unionByName(active.select(*node, F.col("own").alias("c"), F.lit(0.0).alias("w"), F.lit(0.0).alias("inside")))
             .groupBy(*node, "c").agg(F.sum("w").alias("w_ic"), F.sum("inside").alias("inside")))
    tot = state.groupBy(F.col("community").alias("c")).agg(F.sum("kout").alias("t_out"), F.sum("kin").alias("t_in"))
    cand = links.join(by_hash(tot), "c")
    is_own = F.col("c") == F.col("own")
    t_out = F.col("t_out") - F.when(is_own, F.col("kout")).otherwise(F.lit(0.0))
    t_in = F.col("t_in") - F.when(is_own, F.col("kin")).otherwise(F.lit(0.0))
    gain = F.col("w_ic") / F.lit(m) - F.lit(resolution) * (F.col("kout") * t_in + F.col("kin") * t_out) / F.lit(m * m)
    allowed = (F.col("c") > F.col("own") if up else F.col("c") < F.col("own")) & share
    choice = F.struct((-gain).alias("loss"), F.col("c"))
    # best gain of a node, of its ties the smallest community: one partial aggregate
    best = cand.groupBy("i").agg(F.max(F.when(is_own, gain)).alias("g0"), F.min(choice).alias("any"),
                                 F.min(F.when(allowed, choice)).alias("ok"), F.sum("inside").alias("inside"))
    least = F.col("g0") + F.lit(1e-12)
    goes, waits = F.coalesce(-F.col("ok.loss") > least, F.lit(False)), -F.col("any.loss") > least
    marks = best.select("i", F.when(goes, F.col("ok.c")).alias("new_c"), (waits & ~goes).alias("waits"), "inside")
    after = cut_lineage(state.join(by_hash(marks), F.col("id") == F.col("i"), "left").select(
        "id", F.coalesce("new_c", "community").alias("community"), F.col("community").alias("before"), "kout", "kin",
        F.coalesce("waits", F.lit(False)).alias("waiting"), "inside"))
    per = after.groupBy("community").agg(
        (F.sum("kout") * F.sum("kin")).alias("product"), F.sum("inside").alias("inside"),
        F.count(F.when(F.col("community") != F.col("before"), 1)).alias("moved"), F.count(F.when(F.col("waiting"), 1)).alias("waits"))
    figures = per.agg(*[F.sum(c).alias(c) for c in ("product", "inside", "moved", "waits")]).first()
    return after, figures


def _local_moving(ew: DataFrame, m: float, resolution: float, seed: int, level: int, threshold: float,
                  settled: float, tasks: int) -> tuple[DataFrame, float]:
    """One Louvain level: rounds of moves until no node is left to look at, or until two rounds in
    a row (one to each side) gain less than the share ``settled`` of what the level has gained.

    What a round gained is known after the next one. Moves that did not gain ``threshold``
    together are undone, and the round is done again with half the share of nodes (md5 draws);
    the level also ends after ``IDLE_ROUNDS`` of those in a row. Returns the written (id,
    community) of all ends of edges, and the modularity gained.
    """
    ends = ew.select(F.col("src").alias("id"), F.col("w").alias("o"), F.lit(0.0).alias("i")).unionByName(
        ew.select(F.col("dst").alias("id"), F.lit(0.0).alias("o"), F.col("w").alias("i")))
    degree = ends.groupBy("id").agg(F.sum("o").alias("kout"), F.sum("i").alias("kin"))
    # undirected neighbour weights, self-loops excluded (they move with the node)
    arcs = ew.where(F.col("src") != F.col("dst"))
    both = cut_lineage(arcs.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w")
                       .unionByName(arcs.select(F.col("dst").alias("i"), F.col("src").alias("j"), "w"))
                       .groupBy("i", "j").agg(F.sum("w").alias("w")))
    nb = _persist(both.repartition(tasks, "i"))
    nb.count()  # where its rows lie is known to plans once they are there
    base = cut_lineage(degree.select("id", F.col("id").alias("community"), F.col("id").alias("before"), "kout", "kin",
                                     F.lit(True).alias("waiting")))
    product = base.agg(F.sum(F.col("kout") * F.col("kin"))).first()[0] or 0.0
    state, reached, gained, idle, small, r = base, product, 0.0, 0, 0, 0
    while idle < IDLE_ROUNDS:
        draw = uniform(F.concat_ws(":", F.col("i"), F.lit(str(level)), F.lit(str(r))), seed)
        after, now = _move_round(state, nb, m, resolution, r % 2 == 1, draw < 0.5 ** idle if idle else F.lit(True))
        r += 1
        if state is not base:
            gain = (now["inside"] or 0.0) / m - resolution * (reached - product) / (m * m)
            if gain <= threshold:
                release(state, after)
                state, reached, idle = base, product, idle + 1
                continue
            release(base)
            base, product, gained, idle = state, reached, gained + gain, 0
            small = small + 1 if gain < settled * gained else 0
            if small > 1:
                release(after)
                break
        if now["moved"]:
            state, reached = after, now["product"]
        elif now["waits"]:  # the same communities, and other nodes to look at
            release(base)
            base = state = after
        else:
            release(after)
            break
    nb.unpersist()
    release(both)
    return base.select("id", "community"), gained


def louvain(g: Graph, resolution: float = 1.0, seed: int = 42, threshold: float = 1e-7,
            settled: float = SETTLED) -> DataFrame:
    """H3: Louvain communities of the directed multigraph (parallel edges add weight).

    Parallel, not sequential: in each round the nodes next to the last moves go at once to their
    best neighbouring community; rounds that do not raise modularity are undone. A level ends
    when no node is left to move, or earlier when two rounds in a row gain less than the share
    ``settled`` of what the level has gained (0: never earlier). Levels then collapse communities
    into super-vertices (weights summed, self-loops kept) while modularity rises by more than
    ``threshold``; there is no budget of rounds or levels. The visiting order of a sequential implementation cannot be reproduced in parallel;
    the result is a disjoint cover of all vertices. Returns id, community (community = smallest
    member id).
    """
    mapping = cut_lineage(g.all_vertices.select("id", F.col("id").alias("community")))
    ew = cut_lineage(weighted_edges(g.edges))
    m = ew.agg(F.sum("w")).first()[0] or 0.0
    spark, nodes, level = ew.sparkSession, mapping.count(), 0
    while m > 0:
        tasks = tasks_for(spark, max(nodes, 2 * ew.count()), MOVED_ROWS_PER_TASK)
        with rounds_on(spark, tasks):
            comm, gained = _local_moving(ew, m, resolution, seed, level, threshold, settled, tasks)
            if gained <= threshold:
                break
            named = comm.select(F.col("id").alias("community"), F.col("community").alias("c2"))
            old, mapping = mapping, cut_lineage(mapping.join(named, "community", "left").select(
                "id", F.coalesce("c2", "community").alias("community")))
            old_ew, ew = ew, cut_lineage(
                ew.join(comm.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src")
                .join(comm.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
                .groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.sum("w").alias("w")))
            nodes = comm.select("community").distinct().count()
        release(old, old_ew)
        level += 1
    # name each community by its smallest member
    named = mapping.groupBy("community").agg(F.min("id").alias("name"))
    return mapping.join(named, "community").select("id", F.col("name").alias("community"))


def community_summary(communities: DataFrame, labels: DataFrame, top: int = 10) -> DataFrame:
    """D24 + E9: the ``top`` largest communities (ties: smaller name) with size, rank and label
    shares, plus the number of communities and mean size on every row."""
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    stats = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    ranked = sizes.orderBy(F.desc("size"), F.asc("community")).limit(top)
    comp = (communities.join(ranked.select("community"), "community", "left_semi")
            .join(labels, "id", "left")
            .groupBy("community")
            .agg(F.count(F.when(F.col("label") == "human", 1)).alias("humans"),
                 F.count(F.when(F.col("label") == "bot", 1)).alias("bots")))
    w = F.col("humans") + F.col("bots")
    out = ranked.join(comp, "community")
    from graphweft.operators.ordering import rank_desc
    out = rank_desc(out, "size", key="community", out="rank")
    return out.select("rank", "community", "size",
                      F.when(w > 0, F.col("humans") / w).alias("human_pct"),
                      F.when(w > 0, F.col("bots") / w).alias("bot_pct"),
                      F.lit(stats["n"]).alias("num_communities"),
                      F.lit(float(stats["mean"])).alias("mean_size"))
