"""Graph sampling: time bins, stratified seeds, snowball expansion, entity closure
(E3-E5, C19, F4, F5, H5, H6, D10, D19, D25, I14).

Randomness is md5-keyed (``functions.random.uniform``), never ``rand()``: a re-run or a
recomputed partition draws the same numbers, and the DuckDB oracles can reproduce them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.random import uniform
from graphweft.operators import aggregates as agg
from graphweft.operators import relational as rel
from graphweft.operators.ordering import dense_index
from graphweft.session import cut_lineage, release, rounds_on, tasks_for
from graphweft.sources.driver_tables import SOCIAL_RELATIONS

# Fixed values of the reference's sampling call.
N_TIME_BINS = 20
SEED_RATIO = 0.1
HUB_RATIO = 0.7
MAX_PICKS_PER_NODE = 5
RATIO_TOLERANCE = 0.02
SEED = 42


def time_bins(users: DataFrame, q: int = N_TIME_BINS, ts_col: str = "created_at") -> DataFrame:
    """E5: equal-frequency bins on creation time, duplicate edges dropped (``qcut``).

    Edges are exact percentiles (linear interpolation) of epoch microseconds; a value's
    bin is ``max(0, #edges below it - 1)`` — right-closed bins with the lowest value in
    bin 0. The q+1 edges are one bounded aggregate brought to the driver as a literal.
    Adds column ``time_bin``; rows without a time get none.
    """
    micros = F.unix_micros(F.col(ts_col).cast("timestamp"))
    probs = [i / q for i in range(q + 1)]
    rows = agg.quantile_table(users.where(F.col(ts_col).isNotNull()).select(micros.alias("_us")), "_us", probs)
    edges = sorted({r["value"] for r in rows.collect()})
    if not edges:
        return users.withColumn("time_bin", F.lit(None).cast("int"))
    arr = F.array(*[F.lit(float(e)) for e in edges])
    below = F.size(F.filter(arr, lambda e: e < micros.cast("double")))
    return users.withColumn("time_bin", F.when(F.col(ts_col).isNotNull(),
                                               F.greatest(F.lit(0), below - 1)).cast("int"))


@dataclass(frozen=True)
class SeedPlan:
    """Stratum sizes derived from the targets (integer arithmetic, as in the reference)."""
    n_seeds: int
    per_bin: int
    n: int
    n_hubs: int
    n_random: int


def seed_plan(target_users: int, n_bins: int, seed_ratio: float = SEED_RATIO,
              hub_ratio: float = HUB_RATIO) -> SeedPlan:
    n_seeds = int(target_users * seed_ratio)
    per_bin = max(1, n_seeds // max(n_bins, 1))
    n = per_bin // 2
    n_hubs = int(n * hub_ratio)
    return SeedPlan(n_seeds, per_bin, n, n_hubs, n - n_hubs)


def select_seeds(users: DataFrame, target_users: int, seed_ratio: float = SEED_RATIO,
                 hub_ratio: float = HUB_RATIO, seed: int = SEED) -> DataFrame:
    """E3 + C19 + E4 + F4: per (time_bin, label) the ``n_hubs`` highest-degree users, then
    ``n_random`` of the rest in md5 order. ``users``: id, label, degree, time_bin.
    Returns id, seed_kind ('hub' | 'random')."""
    n_bins = users.where(F.col("time_bin").isNotNull()).select("time_bin").distinct().count()
    plan = seed_plan(target_users, n_bins, seed_ratio, hub_ratio)
    strata = users.where(F.col("time_bin").isNotNull() & F.col("label").isin("human", "bot"))
    w_hub = Window.partitionBy("time_bin", "label").orderBy(F.col("degree").desc(), F.col("id").asc())
    hubs = (strata.withColumn("_r", F.row_number().over(w_hub)).where(F.col("_r") <= plan.n_hubs)
            .select("id", F.lit("hub").alias("seed_kind")))
    rest = rel.not_in(strata, hubs, "id")
    w_rnd = Window.partitionBy("time_bin", "label").orderBy(uniform(F.col("id"), seed), F.col("id"))
    rnd = (rest.withColumn("_r", F.row_number().over(w_rnd)).where(F.col("_r") <= plan.n_random)
           .select("id", F.lit("random").alias("seed_kind")))
    return hubs.unionByName(rnd)


def undirected_adjacency(edges: DataFrame, relations=SOCIAL_RELATIONS) -> DataFrame:
    """D21 in edge form: (a, b) for both directions, deduplicated, self-loops dropped."""
    e = rel.relation_filter(edges, relations).where(F.col("source_id") != F.col("target_id"))
    return (e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
            .unionByName(e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b")))
            .distinct())


def snowball(seeds: DataFrame, users: DataFrame, edges: DataFrame, target_users: int,
             bot_ratio: float | None = None, max_per_node: int = MAX_PICKS_PER_NODE,
             max_levels: int | None = None, seed: int = SEED,
             tolerance: float = RATIO_TOLERANCE) -> DataFrame:
    """H5: level-synchronous snowball expansion of ``seeds`` to ``target_users``.

    Each level, every frontier user picks up to ``max_per_node`` unsampled labelled
    neighbours, weighted by degree without replacement (Efraimidis-Spirakis keys
    ``-ln(1-u)/max(degree,1)``, u md5-keyed by (node, neighbour, level)); the picks are
    deduplicated and cut to the remaining target by key. With ``bot_ratio`` set, a level
    takes no bots while the sample's bot share exceeds it by ``tolerance`` and no humans
    while it falls short by as much. Stops at the target, an empty frontier or
    ``max_levels``. ``users``: id, label, degree. Returns id, level (seeds 0).

    The adjacency lies by node and stays there, so that a level moves the frontier and its
    candidates; joins go by exchange (``rounds_on``), the driver gets the counts of a level.
    Per level: one join of the frontier with the adjacency, one anti join with the
    sample, a top-k per frontier node (partial WindowGroupLimit before the shuffle keeps a
    hub's candidate list bounded per task) and, on the last level, a global cut by key that
    only touches the level's candidates. A level's picks are checkpointed, which is one job,
    and counted; the sample is the union of the levels, written together every few levels.
    """
    adj = cut_lineage(undirected_adjacency(edges))
    meta = cut_lineage(users.where(F.col("label").isin("human", "bot")).select(
        F.col("id").alias("b"), "label", F.greatest(F.col("degree"), F.lit(1)).alias("w")))
    sampled = cut_lineage(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    stats = sampled.join(users.select("id", "label"), "id", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == "bot", 1)).alias("bots")).first()
    n, bots = stats["n"], stats["bots"]
    tasks = tasks_for(adj.sparkSession, max(adj.count(), meta.count()))
    with rounds_on(adj.sparkSession, tasks):
        dealt = adj.repartition(tasks, "a").persist(StorageLevel.MEMORY_AND_DISK)
        dealt.count()  # where its rows lie is known to plans once they are there
        sampled = _levels(sampled, n, bots, dealt, meta, target_users, bot_ratio, max_per_node, max_levels, seed, tolerance)
        dealt.unpersist()
    release(adj, meta)
    return sampled


def _levels(sampled: DataFrame, n: int, bots: int, adj: DataFrame, meta: DataFrame, target_users: int,
            bot_ratio: float | None, max_per_node: int, max_levels: int | None, seed: int, tolerance: float) -> DataFrame:
    """The levels of ``snowball`` from the seeds (id, level), of which ``n`` are sampled and ``bots`` bots."""
    level, last = 0, sampled
    while n < target_users and (max_levels is None or level < max_levels):
        cand = (last.select(F.col("id").alias("a")).join(adj, "a")
                .join(sampled.select(F.col("id").alias("b")), "b", "left_anti")
                .join(meta, "b"))
        if bot_ratio is not None and n > 0:
            r = bots / n
            if r > bot_ratio + tolerance:
                cand = cand.where(F.col("label") != "bot")
            if r < bot_ratio - tolerance:
                cand = cand.where(F.col("label") == "bot")
        u = uniform(F.concat_ws(":", F.col("a"), F.col("b"), F.lit(str(level + 1))), seed)
        cand = cand.withColumn("key", -F.log(F.lit(1.0) - u) / F.col("w"))
        wk = Window.partitionBy("a").orderBy(F.col("key").asc(), F.col("b").asc())
        picks = cut_lineage(cand.withColumn("_r", F.row_number().over(wk)).where(F.col("_r") <= max_per_node)
                            .groupBy("b").agg(F.min("key").alias("key"), F.first("label").alias("label")))
        count = [F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == "bot", 1)).alias("bots")]
        add = picks.agg(*count).first()
        if add["n"] > target_users - n:
            picks = dense_index(picks, [F.col("key"), F.col("b")], "_i").where(F.col("_i") < target_users - n)
            add = picks.agg(*count).first()
        if add["n"] == 0:
            break
        level += 1
        last = picks.select(F.col("b").alias("id"), F.lit(level).alias("level"))
        sampled = sampled.unionByName(last)
        if level % 8 == 0:
            sampled = cut_lineage(sampled)
        n += add["n"]
        bots += add["bots"]
    return sampled


@dataclass
class Closure:
    """H6 output: entity ids by kind and the kept edges."""
    entities: DataFrame   # kind, id
    edges: DataFrame      # source_id, relation, target_id


def entity_closure(edges: DataFrame, user_ids: DataFrame, strict: bool = False) -> Closure:
    """H6: tweets, lists and hashtags that belong to a user sample, and the edges kept.

    Rules: post/pinned/like from a sampled user take the tweet; mentioned of a sampled
    user takes the tweet; retweeted/quoted/replied touching the sample take both tweets;
    own/followed/membership take the list on the far side of a sampled user; contain
    (list -> tweet) joins a list or tweet already taken with its partner, to a fixpoint;
    discuss from a taken tweet takes the hashtag. Kept: edges with source in users, tweets
    or lists and target in those or hashtags.

    Order-free: the contain fixpoint grows by whole frontiers, from the lists and tweets
    taken last to their partners, until a round takes nothing new. Each rule reads only its
    relations' edges and meets them with the sample by semi joins; edges are not rewritten.
    ``strict=True`` reproduces the reference's pre-filter: only rows with a sampled user at
    one end are seen, so contain and discuss never fire.
    """
    U = cut_lineage(user_ids.select("id").distinct())

    def touching(relations: Sequence[str], end: str) -> DataFrame:
        return rel.relation_filter(edges, relations).join(U.withColumnRenamed("id", end), end, "left_semi")

    def took(df: DataFrame, kind: str, end: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(end).alias("id"))

    shared = ("retweeted", "quoted", "replied")
    lists = ("own", "followed", "membership")
    either = touching(shared, "source_id").unionByName(touching(shared, "target_id"), allowMissingColumns=True)
    picks = cut_lineage(
        took(touching(("post", "pinned", "like"), "source_id"), "tweet", "target_id")
        .unionByName(took(touching(("mentioned",), "target_id"), "tweet", "source_id"))
        .unionByName(took(either, "tweet", "source_id")).unionByName(took(either, "tweet", "target_id"))
        .unionByName(took(touching(lists, "source_id"), "list", "target_id"))
        .unionByName(took(touching(lists, "target_id"), "list", "source_id")).distinct())
    hashtags = picks.limit(0)
    if not strict:
        contain = cut_lineage(rel.relation_filter(edges, ("contain",)).select("source_id", "target_id").distinct())
        frontier = picks
        while not frontier.isEmpty():
            of_list = frontier.where(F.col("kind") == "list").select(F.col("id").alias("source_id"))
            of_tweet = frontier.where(F.col("kind") == "tweet").select(F.col("id").alias("target_id"))
            new = took(contain.join(of_list, "source_id", "left_semi"), "tweet", "target_id").unionByName(
                took(contain.join(of_tweet, "target_id", "left_semi"), "list", "source_id"))
            frontier = cut_lineage(new.distinct().join(picks, ["kind", "id"], "left_anti"))
            picks = picks.unionByName(frontier)
        picks = cut_lineage(picks)
        tweets = picks.where(F.col("kind") == "tweet").select(F.col("id").alias("source_id"))
        hashtags = took(rel.relation_filter(edges, ("discuss",)).join(tweets, "source_id", "left_semi"),
                        "hashtag", "target_id").distinct()
    entities = U.select(F.lit("user").alias("kind"), "id").unionByName(picks).unionByName(hashtags)
    entities = cut_lineage(entities)
    src_ok = entities.where(F.col("kind") != "hashtag").select(F.col("id").alias("source_id")).distinct()
    tgt_ok = entities.select(F.col("id").alias("target_id")).distinct()
    e = edges.select("source_id", "relation", "target_id")
    if strict:
        own, far = U.withColumnRenamed("id", "source_id"), U.withColumnRenamed("id", "target_id")
        e = e.join(own, "source_id", "left_semi").unionByName(
            e.join(own, "source_id", "left_anti").join(far, "target_id", "left_semi"))
    kept = e.join(src_ok, "source_id", "left_semi").join(tgt_ok, "target_id", "left_semi")
    return Closure(entities, kept.select("source_id", "relation", "target_id"))


def sample_summary(target_users: int, closure: Closure, labels: DataFrame) -> DataFrame:
    """One row — target, actual users, tweets, lists, hashtags, edges, bot ratio."""
    k = {r["kind"]: r["n"] for r in agg.kind_counts(closure.entities).collect()}
    users = closure.entities.where(F.col("kind") == "user").select("id")
    br = users.join(labels, "id", "left").agg(
        F.avg(F.when(F.col("label") == "bot", 1.0).otherwise(0.0)).alias("r")).first()["r"]
    n_edges = closure.edges.count()
    spark = labels.sparkSession
    return spark.createDataFrame(
        [(target_users, k.get("user", 0), k.get("tweet", 0), k.get("list", 0), k.get("hashtag", 0),
          n_edges, br)],
        "target_users bigint, actual_users bigint, tweets bigint, lists bigint, hashtags bigint, "
        "edges bigint, bot_ratio double")


def sample_report(population: DataFrame, sample_ids: DataFrame, bins: int = 50) -> DataFrame:
    """Sample versus population as one tidy table: metric, series, bin, value.

    class_count (bin 0 human, 1 bot), degree_density (each series on its own 50 equal-width
    bins, as two separate histograms would be), time_bin_count (bins 0..19, zeros kept),
    degree_q95 (the display clip). ``population``: id, label, degree, time_bin.
    """
    spark = population.sparkSession
    sample = cut_lineage(population.join(sample_ids.select("id").distinct(), "id", "left_semi"))
    parts = []
    for name, df in (("population", population), ("sample", sample)):
        cls = (df.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("value"))
               .select(F.lit("class_count").alias("metric"), F.lit(name).alias("series"),
                       F.when(F.col("label") == "bot", 1).otherwise(0).alias("bin"), "value"))
        dens = agg.density_histogram(df, "degree", bins).select(
            F.lit("degree_density").alias("metric"), F.lit(name).alias("series"), "bin",
            F.col("density").alias("value"))
        tb = (spark.range(N_TIME_BINS).select(F.col("id").cast("int").alias("bin"))
              .join(df.groupBy(F.col("time_bin").alias("bin")).agg(F.count(F.lit(1)).alias("n")), "bin", "left")
              .select(F.lit("time_bin_count").alias("metric"), F.lit(name).alias("series"), "bin",
                      F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("value")))
        q = agg.quantiles(df, "degree", (0.95,)).select(
            F.lit("degree_q95").alias("metric"), F.lit(name).alias("series"), F.lit(0).alias("bin"),
            F.col("q95").alias("value"))
        parts += [cls, dens, tb, q]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("bin", F.col("bin").cast("int"))


def population(users: DataFrame, edges: DataFrame) -> DataFrame:
    """L1 load + degree + bins: labelled users with a valid time, degree and time bin."""
    u = users.where(F.col("created_at").isNotNull() & F.col("label").isNotNull())
    u = agg.users_with_degree(u.select("id", "label", "created_at"), edges)
    return time_bins(u)

