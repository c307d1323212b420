"""Weekly cumulative snapshots without materialising them (C10-C12, E7, E10, E11, E13-E15,
D18, D22, B6, A10, A11).

The reference re-filters every table once per week: O(weeks x rows). Here each node and
edge gets the index of the first snapshot it belongs to (``first_snapshot``), computed
arithmetically from its time against the weekly grid. Snapshot ``i`` is then
``first_snapshot <= i`` (a pushed-down range filter on a stored table), and per-snapshot
counts are counts per ``first_snapshot`` followed by a running sum over at most a few
thousand pre-aggregated rows. Work is O(rows) plus one shuffle per join.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.operators import relational as rel
from graphweft.operators.ordering import dense_index
from graphweft.sources.driver_tables import SNAPSHOT_RELATIONS, SOCIAL_RELATIONS

DAY_MICROS = 86_400_000_000
WEEK_MICROS = 7 * DAY_MICROS
# Fixed values of the sequence trainer: snapshots with fewer users are skipped, later ones
# are never read, and a sequence closes when it holds more than ``sequence_length``.
MIN_USERS_PER_SNAPSHOT = 10
MAX_SNAPSHOTS = 800  # of that trainer's configuration; no default of the library
SEQUENCE_LENGTH = 10


def node_times(users: DataFrame, tweets: DataFrame) -> DataFrame:
    """Id, time — a user's creation time, else a tweet's (users win on a clash)."""
    u = users.where(F.col("created_at").isNotNull()).select("id", F.col("created_at").alias("time"),
                                                             F.lit(0).alias("prio"))
    t = tweets.where(F.col("created_at").isNotNull()).select("id", F.col("created_at").alias("time"),
                                                              F.lit(1).alias("prio"))
    return (u.unionByName(t).groupBy("id")
            .agg(F.min_by("time", "prio").alias("time")))


def edge_activation(edges: DataFrame, times: DataFrame,
                    relations=SNAPSHOT_RELATIONS) -> DataFrame:
    """E15 + C10: source_id, relation, target_id, active_from = later end time.

    Edges with an end of unknown time are dropped (inner joins, quirk Q8).
    """
    e = rel.relation_filter(edges, relations) if relations else edges
    s = times.select(F.col("id").alias("source_id"), F.col("time").alias("t_src"))
    t = times.select(F.col("id").alias("target_id"), F.col("time").alias("t_dst"))
    return (e.join(s, "source_id").join(t, "target_id")
            .select("source_id", "relation", "target_id",
                    F.greatest("t_src", "t_dst").alias("active_from")))


@dataclass(frozen=True)
class WeeklyGrid:
    """Snapshot i is at ``start_us`` (epoch microseconds) + i weeks; ``count`` in total.

    Times stay numbers on the driver: a Python datetime without a zone would be read in the
    driver process's zone."""
    start_us: int | None
    count: int

    @property
    def start(self) -> dt.datetime | None:
        """Time of snapshot 0 in UTC."""
        return None if self.start_us is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=self.start_us)

    def first_snapshot(self, t: Column) -> Column:
        """Index of the first snapshot whose time is >= t; null if after the last one."""
        if self.start_us is None or self.count == 0:
            return F.lit(None).cast("int")
        k = F.greatest(F.lit(0), F.ceil((F.unix_micros(t.cast("timestamp")) - F.lit(self.start_us))
                                        / F.lit(WEEK_MICROS)).cast("int"))
        return F.when(k < self.count, k).cast("int")

    def timestamp(self, idx: Column) -> Column:
        return F.timestamp_micros(F.lit(self.start_us) + idx.cast("bigint") * F.lit(WEEK_MICROS))


def weekly_grid(users: DataFrame, tweets: DataFrame) -> WeeklyGrid:
    """Sundays from the first on or after the earliest user (keeping its time of day),
    7 days apart, up to the latest user or tweet. Two scalars reach the driver."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    both = users.select(at.alias("t"), at.alias("u")).unionByName(
        tweets.select(at.alias("t"), F.lit(None).cast("bigint").alias("u")))
    row = both.agg(F.min("u").alias("lo"), F.max("t").alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return WeeklyGrid(None, 0)
    weekday = (lo // DAY_MICROS + 3) % 7  # day 0 of the epoch was a Thursday; Monday is 0
    start = lo + (6 - weekday) % 7 * DAY_MICROS
    return WeeklyGrid(start, max(0, (hi - start) // WEEK_MICROS + 1))


@dataclass
class Snapshots:
    """Interval-coded snapshot sequence (A15 layout)."""
    grid: WeeklyGrid
    users: DataFrame    # id, first_snapshot
    tweets: DataFrame   # id, author, first_snapshot
    edges: DataFrame    # source_id, relation, target_id, active_from, first_snapshot


def build_snapshots(users: DataFrame, tweets: DataFrame, edges: DataFrame,
                    relations=SNAPSHOT_RELATIONS) -> Snapshots:
    """C11 + C12 + E15: first snapshot of every user, tweet and edge.

    A tweet is active once it exists and its author is active: ``greatest`` of the two
    first snapshots (inner join on the author; tweets of unknown authors never appear).
    """
    grid = weekly_grid(users, tweets)
    fs_users = (users.where(F.col("created_at").isNotNull())
                .select("id", grid.first_snapshot(F.col("created_at")).alias("first_snapshot"))
                .where(F.col("first_snapshot").isNotNull()))
    authors = fs_users.select(F.col("id").alias("author"), F.col("first_snapshot").alias("fs_author"))
    fs_tweets = (tweets.select("id", F.concat(F.lit("u"), F.col("author_id").cast("string")).alias("author"),
                               grid.first_snapshot(F.col("created_at")).alias("fs_own"))
                 .where(F.col("fs_own").isNotNull())
                 .join(authors, "author")
                 .select("id", "author", F.greatest("fs_own", "fs_author").alias("first_snapshot")))
    act = edge_activation(edges, node_times(users, tweets), relations)
    fs_edges = (act.withColumn("first_snapshot", grid.first_snapshot(F.col("active_from")))
                .where(F.col("first_snapshot").isNotNull()))
    return Snapshots(grid, fs_users, fs_tweets, fs_edges)


def snapshot_index(snap: Snapshots) -> DataFrame:
    """All snapshot indices with their timestamps (a generated range, not a data scan)."""
    spark = snap.users.sparkSession
    return (spark.range(snap.grid.count).select(F.col("id").alias("snapshot_idx"))
            .withColumn("timestamp", snap.grid.timestamp(F.col("snapshot_idx"))))


def _cumulative(idx: DataFrame, per_first: DataFrame, cols: list[str]) -> DataFrame:
    w = Window.orderBy("snapshot_idx").rowsBetween(Window.unboundedPreceding, 0)
    j = idx.join(per_first, "snapshot_idx", "left").fillna({c: 0 for c in cols})
    return j.select(*[c for c in j.columns if c not in cols],
                    *[F.sum(c).over(w).cast("bigint").alias(c) for c in cols])


def snapshot_counts(snap: Snapshots) -> DataFrame:
    """D18 + E14: snapshot_idx, timestamp, num_users, num_tweets, num_edges (cumulative).

    The running sum runs over one pre-aggregated row per week, never over raw rows.
    """
    def per(df, name):
        return (df.groupBy(F.col("first_snapshot").alias("snapshot_idx"))
                .agg(F.count(F.lit(1)).alias(name)))
    counts = (per(snap.users, "num_users")
              .join(per(snap.tweets, "num_tweets"), "snapshot_idx", "full")
              .join(per(snap.edges, "num_edges"), "snapshot_idx", "full"))
    counts = counts.withColumn("snapshot_idx", F.col("snapshot_idx").cast("bigint"))
    return _cumulative(snapshot_index(snap), counts, ["num_users", "num_tweets", "num_edges"])


def kept_snapshots(counts: DataFrame, min_users: int = MIN_USERS_PER_SNAPSHOT,
                   max_snapshots: int | None = None) -> DataFrame:
    """Snapshots the sequence trainer reads: those with enough users, and, if asked for,
    only the first ``max_snapshots``."""
    kept = counts.where(F.col("num_users") >= min_users)
    return kept if max_snapshots is None else kept.where(F.col("snapshot_idx") < max_snapshots)


def sequences(kept: DataFrame, sequence_length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Consecutive kept snapshots cut into sequences of ``sequence_length + 1``
    (the trainer closes a sequence once it holds more than ``sequence_length``); the last
    one may be shorter. Runs over the small per-snapshot table."""
    size = sequence_length + 1
    w = Window.orderBy("snapshot_idx")
    rn = F.row_number().over(w) - 1
    return (kept.withColumn("_rn", rn)
            .withColumn("sequence_id", F.floor(F.col("_rn") / size).cast("int"))
            .withColumn("position", (F.col("_rn") % size).cast("int"))
            .drop("_rn"))


def sequence_sizes(seq: DataFrame) -> DataFrame:
    """Per sequence, its snapshots and the largest user count (padding size)."""
    return seq.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("num_snapshots"),
        F.min("snapshot_idx").alias("first_snapshot"),
        F.max("snapshot_idx").alias("last_snapshot"),
        F.max("num_users").alias("max_nodes"))


def snapshot_at(snap: Snapshots, i: int) -> Snapshots:
    """A10: snapshot ``i`` — range filters on the interval-coded tables."""
    def f(df):
        return df.where(F.col("first_snapshot") <= i)
    return Snapshots(snap.grid, f(snap.users), f(snap.tweets), f(snap.edges))


def active_by_label(snap: Snapshots, labels: DataFrame) -> DataFrame:
    """One job over all snapshots in order — active humans and bots per snapshot."""
    lab = snap.users.join(labels, "id")
    per = (lab.groupBy(F.col("first_snapshot").cast("bigint").alias("snapshot_idx"))
           .agg(F.count(F.when(F.col("label") == "human", 1)).alias("active_humans"),
                F.count(F.when(F.col("label") == "bot", 1)).alias("active_bots")))
    return _cumulative(snapshot_index(snap).drop("timestamp"), per, ["active_humans", "active_bots"])


def relation_edge_counts(snap: Snapshots, relations=SOCIAL_RELATIONS) -> DataFrame:
    """D22 + B7: per snapshot and (source kind, relation, target kind), the number of edges
    whose both ends are active users — the per-relation edge lists the model reads.

    A user-user edge is active from the later of its ends' times, when both ends are active,
    so its first snapshot already implies both ends; the lists are cumulative counts.
    """
    e = (snap.edges.where(F.col("relation").isin(list(relations)))
         .join(snap.users.select(F.col("id").alias("source_id")), "source_id", "left_semi")
         .join(snap.users.select(F.col("id").alias("target_id")), "target_id", "left_semi"))
    per = (e.groupBy(F.col("first_snapshot").cast("bigint").alias("snapshot_idx"))
           .pivot("relation", list(relations)).agg(F.count(F.lit(1))))
    idx = snapshot_index(snap).drop("timestamp")
    cum = _cumulative(idx, per, list(relations))
    return (cum.select("snapshot_idx", F.explode(F.array(*[
        F.struct(F.lit("user").alias("source_kind"), F.lit(r).alias("relation"),
                 F.lit("user").alias("target_kind"), F.col(r).alias("num_edges"))
        for r in relations])).alias("s"))
            .select("snapshot_idx", "s.*"))


def local_user_index(snap: Snapshots) -> DataFrame:
    """Position of a user among the active users of any snapshot it is in.

    Users are cumulative, so ordering them once by (first_snapshot, id) gives every user the
    same local index in every snapshot: id, first_snapshot, local_idx.
    """
    return dense_index(snap.users, [F.col("first_snapshot"), F.col("id")], "local_idx")


def degree_changes(snap: Snapshots, relations=SOCIAL_RELATIONS) -> DataFrame:
    """Degrees of users in the graphs of all snapshots, as change rows: id, snapshot_idx,
    degree (parallel edges and both ends counted), read with ``features.as_of``."""
    e = snap.edges.where(F.col("relation").isin(list(relations)))
    ends = e.select(F.explode(F.array("source_id", "target_id")).alias("id"), F.col("first_snapshot").cast("bigint").alias("snapshot_idx"))
    new = ends.groupBy("id", "snapshot_idx").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("id").orderBy("snapshot_idx").rowsBetween(Window.unboundedPreceding, 0)
    return new.select("id", "snapshot_idx", F.sum("n").over(upto).alias("degree"))


def edge_lists(snap: Snapshots, relations=SOCIAL_RELATIONS) -> DataFrame:
    """D22 + C9: the typed edge lists of all snapshots as one interval-coded table:
    first_snapshot, relation, src_idx, dst_idx by the users' local indices (E7), which are the
    same in every snapshot. Snapshot i's list of a relation is ``first_snapshot <= i``."""
    index = local_user_index(snap)
    e = snap.edges.where(F.col("relation").isin(list(relations))).select(
        "source_id", "relation", "target_id", "first_snapshot")
    return rel.encode_endpoints(e, index.select("id", F.col("local_idx").alias("idx"))).select(
        "first_snapshot", "relation", "src_idx", "dst_idx")


def _runs(indices: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of sorted distinct indices without a gap."""
    firsts = [i for i, before in zip(indices, [None, *indices]) if before != i - 1]
    lasts = [i for i, after in zip(indices, [*indices[1:], None]) if after != i + 1]
    return list(zip(firsts, lasts))


def memberships(snap: Snapshots, snapshot_ids: DataFrame, ranges: bool = False) -> DataFrame:
    """Explode users into the requested snapshots they belong to: snapshot_idx, id.

    ``snapshot_ids`` (snapshot_idx) is a small table; each user expands only to the
    requested indices at or after its first snapshot. With ``ranges`` a row stands for all from
    ``snapshot_idx`` to ``upto``, one for each run of requested indices without a gap; ``each``
    expands it.
    """
    wanted = sorted(r[0] for r in snapshot_ids.select("snapshot_idx").distinct().collect())
    if ranges:
        runs = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in _runs(wanted)])
        runs = runs.cast("array<struct<lo:bigint,hi:bigint>>")
        active = F.filter(runs, lambda r: r["hi"] >= F.col("first_snapshot"))
        return (snap.users.select(F.explode(active).alias("r"), "first_snapshot", "id")
                .select(F.greatest("r.lo", F.col("first_snapshot").cast("bigint")).alias("snapshot_idx"),
                        F.col("r.hi").alias("upto"), "id"))
    arr = F.array(*[F.lit(int(i)) for i in wanted]) if wanted else F.array().cast("array<bigint>")
    return (snap.users.select(F.explode(F.filter(arr, lambda i: i >= F.col("first_snapshot"))).alias("s"), "id")
            .select(F.col("s").cast("bigint").alias("snapshot_idx"), "id"))


def each(ranges: DataFrame, at: str = "snapshot_idx", upto: str = "upto") -> DataFrame:
    """Rows that stand for the snapshots ``at`` to ``upto``, once for each of them."""
    rest = [c for c in ranges.columns if c not in (at, upto)]
    return ranges.select(F.explode(F.sequence(at, upto)).alias(at), *rest)
