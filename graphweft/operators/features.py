"""Per-user and per-snapshot features.

Vector work is long form ``(key, pos, value)`` for aggregation and higher-order functions
for element-wise math; matrix products (random projections) are numpy inside an iterator
pandas UDF, with the weights generated from a seed on each worker (nothing broadcast).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions import scalar
from graphweft.functions import vectors as vec
from graphweft.operators import aggregates as agg
from graphweft.operators import relational as rel
from graphweft.operators.temporal import Snapshots
from graphweft.session import cut_parts, release

# Fixed values of the reference's feature configuration.
MAX_TWEETS_PER_USER = 20
USER_EMBEDDING_DIM = 128
TWEET_EMBEDDING_DIM = 128
ZSCORE_EPS = 1e-8
LEAKY_SLOPE = 0.01
# Turns in which vectors that are written are made, and the posts from which on there are several.
TURNS = 8
ROWS_PER_TURN = 2_000_000


# --- E1 / E2 / D15: recent tweets and their pooled vector ---------------------------------

def recent_tweets(users: DataFrame, tweets: DataFrame, k: int = MAX_TWEETS_PER_USER) -> DataFrame:
    """The k most recent tweets with text per user: id, tweet_id, created_at, rn.

    Ties on time are broken by tweet id. ``row_number() <= k`` lets Catalyst insert a
    partial WindowGroupLimit before the shuffle, so a user with a huge share of all tweets
    sends at most k rows per map task, not its whole history.
    """
    j = rel.tweets_of_users(users, tweets)
    w = Window.partitionBy("id").orderBy(F.col("created_at").desc(), F.col("tweet_id").asc())
    return (j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
            .select("id", "tweet_id", "created_at", "rn"))


def recent_tweet_lists(users: DataFrame, tweets: DataFrame, k: int = MAX_TWEETS_PER_USER) -> DataFrame:
    """E2 + C14: id, tweet_ids (most recent first); users without tweets get []."""
    r = recent_tweets(users, tweets, k)
    lists = (r.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rn", "tweet_id"))).alias("_s"))
             .select("id", F.col("_s.tweet_id").alias("tweet_ids")))
    return rel.reindex_groups(users.select("id"), lists, "tweet_ids")


def recent_tweet_vector(users: DataFrame, tweets: DataFrame, tweet_vecs: DataFrame, dim: int,
                        k: int = MAX_TWEETS_PER_USER) -> DataFrame:
    """Id, vec = mean vector of the user's k most recent tweets that have a vector
    (C15: tweets without one are skipped); zeros when there is none.

    A user's group holds at most k vectors (the top-k is limited before the shuffle), so the
    vectors are summed element-wise inside the group instead of exploding to long form. They
    travel in the type they come in and are summed as doubles.
    """
    r = recent_tweets(users, tweets, k)
    tv = tweet_vecs.select(F.col("id").alias("tweet_id"), "vec")
    summed = (r.select("id", "tweet_id").join(tv, "tweet_id").select("id", "vec").repartition("id")
              .groupBy("id").agg(F.collect_list("vec").alias("_vs")))
    total = F.aggregate(F.col("_vs"), vec.zeros(dim), lambda acc, x: vec.add(acc, x.cast("array<double>")))
    pooled = summed.select("id", vec.scale(total, 1.0 / F.size("_vs")).alias("vec"))
    return (users.select("id").join(pooled, "id", "left")
            .select("id", F.coalesce(F.col("vec"), vec.zeros(dim)).alias("vec")))


# --- D17 / I4 / I5: numeric and categorical blocks -------------------------------------------

def zscore(df: DataFrame, cols: Sequence[str], eps: float = ZSCORE_EPS, suffix: str = "_z") -> DataFrame:
    """(x - mean) / (sample std + eps) for each column; stats from one aggregate."""
    exprs = {}
    for c in cols:
        exprs[f"{c}__m"] = F.avg(F.col(c).cast("double"))
        exprs[f"{c}__s"] = F.stddev_samp(F.col(c).cast("double"))
    st = agg.scalar_stats(df, exprs)
    out = df
    for c in cols:
        mu, sd = st[f"{c}__m"], st[f"{c}__s"]
        sd = sd if sd is not None else float("nan")
        out = out.withColumn(f"{c}{suffix}", (F.col(c).cast("double") - F.lit(mu)) / F.lit(sd + eps))
    return out


def numeric_block(records: DataFrame, edges: DataFrame, include_tweet_count: bool = True) -> DataFrame:
    """I4: id, numeric = [z(followers), z(following), z(active_days), z(name_len),
    z(like_count)(, z(tweet_count))].

    B5 defaults, G3 floored account age against 2020-09-05 UTC, G4 name length, C3 left join
    of D2 distinct likes.
    """
    base = records.select(
        "id",
        F.coalesce(F.col("public_metrics.followers_count"), F.lit(0)).cast("double").alias("followers"),
        F.coalesce(F.col("public_metrics.following_count"), F.lit(0)).cast("double").alias("following"),
        scalar.account_age_days(F.col("created_at")).cast("double").alias("active_days"),
        scalar.char_len(F.col("name")).cast("double").alias("name_len"),
        F.coalesce(F.col("public_metrics.tweet_count"), F.lit(0)).cast("double").alias("tweet_count"))
    base = rel.left_join_fill(base, agg.distinct_likes(edges), "id", {"like_count": 0})
    cols = ["followers", "following", "active_days", "name_len", "like_count"]
    if include_tweet_count:
        cols.append("tweet_count")
    z = zscore(base, cols)
    return z.select("id", F.array(*[F.col(f"{c}_z") for c in cols]).alias("numeric"))


def categorical_block(records: DataFrame,
                      default_image: str = "https://abs.twimg.com/sticky/default_profile_images/"
                                           "default_profile_normal.png") -> DataFrame:
    """Id, categorical = [protected, verified, default_image] as 0/1 floats."""
    return records.select("id", F.array(
        scalar.bool_flag(F.col("protected")).cast("double"),
        scalar.bool_flag(F.col("verified")).cast("double"),
        scalar.default_image_flag(F.col("profile_image_url"), default_image).cast("double"))
        .alias("categorical"))


# --- I2 / I3: seeded random projections ---------------------------------------------------------

def _u(s: str) -> float:
    return int(hashlib.md5(s.encode()).hexdigest()[:13], 16) / float(2 ** 52)


def projection_weights(name: str, in_dim: int, out_dim: int, seed: int = 42):
    """Seeded Linear(in_dim, out_dim) weights: uniform(-1/sqrt(in), 1/sqrt(in)) drawn from
    md5('name:i:j:seed') — the same numbers the SQL oracle derives."""
    bound = 1.0 / np.sqrt(in_dim)
    w = np.array([[(2.0 * _u(f"{name}:{i}:{j}:{seed}") - 1.0) * bound for j in range(in_dim)]
                  for i in range(out_dim)])
    b = np.array([(2.0 * _u(f"{name}:b:{i}:{seed}") - 1.0) * bound for i in range(out_dim)])
    return w, b


def project(c: Column, name: str, in_dim: int | None, out_dim: int, seed: int = 42,
            activation: str = "leaky_relu") -> Column:
    """I2 building block: activation(W x + b) per row, numpy on Arrow batches. Without
    ``in_dim`` it is the length of the vectors."""
    @F.pandas_udf("array<double>")
    def _proj(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = None
        for s in it:
            if len(s) == 0:
                yield pd.Series([], dtype=object)
                continue
            x = np.stack([np.asarray(v, dtype="float64") for v in s.tolist()])
            weights = weights or projection_weights(name, in_dim or x.shape[1], out_dim, seed)
            w, b = weights
            y = x @ w.T + b
            if activation == "leaky_relu":
                y = np.where(y > 0, y, LEAKY_SLOPE * y)
            elif activation == "relu":
                y = np.maximum(y, 0.0)
            yield pd.Series(list(y))
    return _proj(c)


def static_fuse(desc: DataFrame, numeric: DataFrame, categorical: DataFrame,
                tweet: DataFrame | None = None, dim: int = USER_EMBEDDING_DIM, seed: int = 42) -> DataFrame:
    """Id, vec. Each block projected to dim/4 (leaky ReLU) and concatenated in the order
    desc, tweet, numeric, categorical; with the tweet block a final dim x dim layer follows,
    without it the result has 3*dim/4 entries. Inputs: (id, vec|numeric|categorical)."""
    q = dim // 4
    blocks = [("desc", desc, "vec")] + ([("tweet", tweet, "vec")] if tweet is not None else []) + [
        ("numeric", numeric, "numeric"), ("categorical", categorical, "categorical")]
    out = None
    names = []
    for name, df, c in blocks:
        p = df.select("id", project(F.col(c), f"{name}_proj", None, q, seed).alias(name))
        out = p if out is None else out.join(p, "id")
        names.append(name)
    fused = out.select("id", F.concat(*[F.col(n) for n in names]).alias("vec"))
    if tweet is not None:
        fused = fused.select("id", project(F.col("vec"), "final_proj", dim, dim, seed).alias("vec"))
    return fused


def posted_vector_changes(snap: Snapshots, tweet_vecs: DataFrame,
                          through: Callable[[Column], Column] | None = None) -> DataFrame:
    """Running mean of the vectors of a user's ``post``-ed tweets, one row per user and
    snapshot where it changes: id, snapshot_idx, vec.

    The value for snapshot i is the row with the largest snapshot_idx <= i (as-of read, see
    ``vectors_at``); users with no post yet have zeros. Vectors stay whole: they meet the posts,
    are dealt by user once and averaged along the user's posts (``vectors.running_mean``).
    ``through`` (such as ``project``) is what the vectors go through before; posts meet them as
    they are given, as Spark no longer knows how rows are dealt once Python has had them.
    """
    posted = _posted_vectors(snap, tweet_vecs)
    if through:
        posted = posted.select("id", "snapshot_idx", through(F.col("vec")).alias("vec"))
    return vec.running_mean(posted, ["id"], "snapshot_idx", "vec")


def _posted_vectors(snap: Snapshots, tweet_vecs: DataFrame) -> DataFrame:
    """id, snapshot_idx, vec: the vector of each ``post``, from its first snapshot on."""
    posts = snap.edges.where(F.col("relation") == "post").select(
        F.col("source_id").alias("id"), F.col("target_id").alias("tweet_id"),
        F.col("first_snapshot").cast("bigint").alias("snapshot_idx"))
    tv = tweet_vecs.select(F.col("id").alias("tweet_id"), "vec")
    return posts.join(tv, "tweet_id").select("id", "snapshot_idx", "vec")


def posted_vector_changes_in_turns(snap: Snapshots, tweet_vecs: DataFrame, turns: int = TURNS,
                                   rows: int = ROWS_PER_TURN) -> Iterator[DataFrame]:
    """``posted_vector_changes`` of all users, some after the others, for a result that is written:
    every user is in one of up to ``turns`` tables, which have ``rows`` posts or more.

    Posts and their vectors are written once, by users. Only those of one turn are dealt and sorted
    at a time, and they are deleted when the next turn is asked for, so that the posts' vectors
    make room on disk for the result.
    """
    for posted in cut_parts(_posted_vectors(snap, tweet_vecs), ["id"], turns, rows):
        yield vec.running_mean(posted, ["id"], "snapshot_idx", "vec")
        release(posted)


def as_of(changes: DataFrame, requests: DataFrame, key: str = "id", at: str = "snapshot_idx") -> DataFrame:
    """As-of merge: each distinct request (at, key) with the values of the key's last change
    (at, key, ...) at or before it; nulls where there is none yet.

    One union and one window over a key's changes and requests, of which there is one for each
    snapshot at most; changes come before requests of the same snapshot, and of equal requests,
    which the window's order puts side by side, the first is kept.
    """
    values = [c for c in changes.columns if c not in (key, at)]
    spot = F.col(at).cast("bigint").alias(at)
    row = F.struct(*[F.col(c) for c in values])
    both = changes.select(key, spot, F.lit(False).alias("_ask"), row.alias("_row")).unionByName(
        requests.select(key, spot, F.lit(True).alias("_ask")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "_ask")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last = both.select(key, at, "_ask", F.last("_row", ignorenulls=True).over(upto).alias("_row"),
                       F.lag(F.struct(at, "_ask")).over(order).alias("_prev"))
    asked = F.col("_ask") & ~F.col("_prev").eqNullSafe(F.struct(at, "_ask"))
    return last.where(asked).select(key, at, *[F.col(f"_row.{c}").alias(c) for c in values])


def as_of_ranges(changes: DataFrame, requests: DataFrame, key: str = "id", at: str = "snapshot_idx",
                 upto: str = "upto") -> DataFrame:
    """As-of merge of ranges: what is asked of a key, every whole number from ``at`` to ``upto``,
    cut where the key's values change. Returns key, at, upto and the values of the key's last
    change at or before ``at``, nulls where there is none yet; each number asked for is in
    exactly one row of the key, also where its ranges overlap.

    A range is one row and is dealt to the changes; those stay as dealt and sorted by a window
    over the key.
    """
    values = [c for c in changes.columns if c not in (key, at)]
    spot = F.col(at).cast("bigint")
    order = Window.partitionBy(key).orderBy(at)
    seen = F.max(upto).over(order.rowsBetween(Window.unboundedPreceding, -1)).cast("bigint")
    asked = requests.select(key, F.greatest(spot, seen + 1).alias("_from"), F.col(upto).cast("bigint").alias("_upto"))
    known = changes.select(key, spot.alias("_at"), F.lead(at).over(order).cast("bigint").alias("_next"),
                           F.lag(at).over(order).isNull().alias("_first"),
                           F.struct(*[F.col(c) for c in values]).alias("_row"))
    none_yet = F.struct(F.col("_from").alias("lo"), F.least("_upto", F.col("_at") - 1).alias("hi"),
                        F.coalesce("_first", F.lit(True)).alias("is_piece"), F.lit(False).alias("known"))
    own = F.struct(F.greatest("_from", "_at").alias("lo"), F.least("_upto", F.col("_next") - 1).alias("hi"),
                   F.col("_at").isNotNull().alias("is_piece"), F.lit(True).alias("known"))
    pieces = (asked.where(F.col("_from") <= F.col("_upto")).join(known, key, "left")
              .select(key, "_row", F.explode(F.array(none_yet, own)).alias("_p"))
              .where(F.col("_p.is_piece") & (F.col("_p.lo") <= F.col("_p.hi"))))
    return pieces.select(key, F.col("_p.lo").alias(at), F.col("_p.hi").alias(upto),
                         *[F.when(F.col("_p.known"), F.col(f"_row.{c}")).alias(c) for c in values])


def vectors_as_of(changes: DataFrame, requests: DataFrame, dim: int) -> DataFrame:
    """Change rows (``posted_vector_changes``, ``temporal_user_vectors``) read for many
    (snapshot_idx, id) requests at once; zeros before the first change. Requests of ranges
    (snapshot_idx, upto, id) are answered by ranges, see ``as_of_ranges``."""
    ranges = ["upto"] if "upto" in requests.columns else []
    read = as_of_ranges(changes, requests) if ranges else as_of(changes, requests)
    return read.select("id", "snapshot_idx", *ranges, F.coalesce("vec", vec.zeros(dim)).alias("vec"))


def vectors_at(changes: DataFrame, snapshot_idx: int, users: DataFrame, dim: int) -> DataFrame:
    """The same at one snapshot for the given users: id, vec."""
    asked = users.select("id", F.lit(snapshot_idx).alias("snapshot_idx"))
    return vectors_as_of(changes, asked, dim).drop("snapshot_idx")


def temporal_user_vectors(snap: Snapshots, static_vecs: DataFrame, tweet_vecs: DataFrame,
                          tweet_dim: int = TWEET_EMBEDDING_DIM, seed: int = 42) -> DataFrame:
    """Per (snapshot, user) vector = static vector ++ mean projected vector of its posts.

    Stored as changes only: one row per user at its first snapshot and at every snapshot
    where its post mean changes: id, snapshot_idx, vec. Read with ``vectors_at``.
    """
    q = tweet_dim // 4
    ch = posted_vector_changes(snap, tweet_vecs, lambda v: project(v, "tweet_proj", None, q, seed))
    stay = snap.users.select("id", F.col("first_snapshot").cast("bigint").alias("snapshot_idx"),
                             F.lit(snap.grid.count - 1).cast("bigint").alias("upto"))
    means = vectors_as_of(ch, stay, q).select("id", "snapshot_idx", F.col("vec").alias("post_vec"))
    return (means.join(static_vecs.select("id", F.col("vec").alias("static_vec")), "id")
            .select("id", "snapshot_idx", F.concat("static_vec", "post_vec").alias("vec")))


# --- E12: top-k nodes per snapshot ---------------------------------------------------------

def scorer_vector(dim: int, seed: int = 42) -> np.ndarray:
    bound = 1.0 / np.sqrt(dim)
    return np.array([(2.0 * _u(f"topk:{i}:{seed}") - 1.0) * bound for i in range(dim)])


def topk_per_snapshot(snap: Snapshots, node_vecs: DataFrame, k: int, seed: int = 42, dim: int | None = None) -> DataFrame:
    """Per snapshot the k active users with the highest ``x . p / (|p| + 1e-8)``.

    Returns snapshot_idx, rank (1..k), id, score, weight = tanh(score), vec = x * weight.
    Fewer than k active users: the last selected one repeats; none: one zero row per rank.

    Users are cumulative, so a user that is not in the top k of its own arrival week
    never is later: only the top k of each arrival week are candidates (at most k per
    week), and each candidate is expanded to the weeks from its arrival on. The final window
    runs over at most k * (weeks so far) rows per snapshot, independent of the user count.
    Ids and scores alone are expanded; vectors meet the chosen rows at the end. Without ``dim``
    a first job looks the vectors' length up.
    """
    dim = dim or node_vecs.select(F.size("vec").alias("d")).first()["d"]
    p = scorer_vector(dim, seed)
    pn = float(np.linalg.norm(p))
    score = vec.dot(F.col("vec"), F.array(*[F.lit(float(v)) for v in p])) / F.lit(pn + 1e-8)
    scored = (snap.users.join(node_vecs, "id")
              .select("id", F.col("first_snapshot").cast("bigint").alias("fs"), score.alias("score")))
    wa = Window.partitionBy("fs").orderBy(F.col("score").desc(), F.col("id").asc())
    cand = scored.withColumn("_r", F.row_number().over(wa)).where(F.col("_r") <= k).drop("_r")
    n = snap.grid.count
    expanded = cand.withColumn("snapshot_idx", F.explode(F.sequence(F.col("fs"), F.lit(n - 1))))
    ws = Window.partitionBy("snapshot_idx").orderBy(F.col("score").desc(), F.col("id").asc())
    top = expanded.withColumn("rank", F.row_number().over(ws)).where(F.col("rank") <= k)
    cnt = top.groupBy("snapshot_idx").agg(F.count(F.lit(1)).alias("_n"))
    slots = (snap.users.sparkSession.range(n).select(F.col("id").alias("snapshot_idx"))
             .withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k)))))
    filled = (slots.join(cnt, "snapshot_idx", "left")
              .withColumn("_src", F.least(F.col("rank"), F.coalesce(F.col("_n"), F.lit(0)))))
    picked = filled.join(top.select("snapshot_idx", F.col("rank").alias("_src"), "id", "score"),
                         ["snapshot_idx", "_src"], "left").join(node_vecs.select("id", "vec"), "id", "left")
    weight = F.tanh(F.col("score"))
    return picked.select(
        "snapshot_idx", F.col("rank").cast("int").alias("rank"), "id", "score",
        F.coalesce(weight, F.lit(0.0)).alias("weight"),
        F.coalesce(vec.scale(F.col("vec"), weight), vec.zeros(dim)).alias("vec"))
