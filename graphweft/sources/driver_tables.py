"""Derive the social-graph inputs (users, tweets, edges, labels) from the driver tables.

The test data is a TPC-H-like star schema, not a social network. These views map it onto
the data model the operators expect (FIXTURES.md section 2):

* a customer is a user ``'u' || c_custkey``; its first order date is its creation time;
  market segment MACHINERY marks a bot;
* an order is a tweet ``'t' || o_orderkey`` written by its customer;
* edges: ``post`` (customer -> order), ``following``/``followers`` between the customers of
  consecutive expensive orders, ``like`` and ``membership`` from line items, ``contain``
  (supplier list -> part tweet) and ``discuss`` (part -> brand hashtag).

Everything is lazily planned; nothing is collected. Columns are pruned at the scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed vocabulary (values that must equal the reference's for the same results).
SOCIAL_RELATIONS = ("following", "followers")
SNAPSHOT_RELATIONS = ("following", "followers", "post", "like", "retweeted", "quoted",
                      "replied", "mentioned", "pinned")
ALL_RELATIONS = ("following", "followers", "post", "pinned", "like", "mentioned", "retweeted",
                 "quoted", "replied", "own", "followed", "membership", "contain", "discuss")
DEFAULT_PROFILE_IMAGE = ("https://abs.twimg.com/sticky/default_profile_images/"
                         "default_profile_normal.png")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _prefixed(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, created_at (timestamp, UTC), followers_count, tweet_count, label."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal",
                                                    "c_mktsegment")
    first = (table(spark, sf_dir, "orders")
             .groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("first_order"), F.count(F.lit(1)).alias("n_orders")))
    return (cust.join(first, cust.c_custkey == first.o_custkey, "left")
            .select(_prefixed("u", "c_custkey").alias("id"),
                    F.col("c_name").alias("name"),
                    F.col("first_order").cast("timestamp").alias("created_at"),
                    F.floor(F.abs(F.col("c_acctbal"))).cast("bigint").alias("followers_count"),
                    F.coalesce(F.col("n_orders"), F.lit(0)).cast("bigint").alias("tweet_count"),
                    F.when(F.col("c_mktsegment") == "MACHINERY", "bot").otherwise("human")
                    .alias("label")))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label — the label file of the reference (one row per labelled user)."""
    return users(spark, sf_dir).select("id", "label")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, author_id (numeric, no prefix), created_at, text."""
    return (table(spark, sf_dir, "orders")
            .select(_prefixed("t", "o_orderkey").alias("id"),
                    F.col("o_custkey").alias("author_id"),
                    F.col("o_orderdate").cast("timestamp").alias("created_at"),
                    F.col("o_orderpriority").alias("text")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, relation, target_id: a directed, typed multigraph."""
    orders = table(spark, sf_dir, "orders")
    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")

    post = orders.select(_prefixed("u", "o_custkey").alias("source_id"),
                         F.lit("post").alias("relation"),
                         _prefixed("t", "o_orderkey").alias("target_id"))

    a = (orders.where(F.col("o_totalprice") > 450000)
         .select((F.col("o_orderkey") + 1).alias("next_key"), "o_custkey", "o_orderstatus"))
    b = orders.select(F.col("o_orderkey").alias("next_key"), F.col("o_custkey").alias("b_cust"))
    social = (a.join(b, "next_key")
              .select(_prefixed("u", "o_custkey").alias("source_id"),
                      F.when(F.col("o_orderstatus") == "F", "followers").otherwise("following")
                      .alias("relation"),
                      _prefixed("u", "b_cust").alias("target_id")))

    # `like` and `membership` both come from line items joined with their order: one join,
    # then each qualifying line emits one row per rule it satisfies.
    is_like = (F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 5)
    is_member = (F.col("l_linenumber") == 1) & (F.col("l_quantity") <= 3)
    li = (lineitem.where(is_like | is_member)
          .select("l_orderkey", "l_partkey", "l_suppkey",
                  is_like.alias("is_like"), is_member.alias("is_member")))
    li = li.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rules = F.array(
        F.when(F.col("is_like"), F.struct(F.lit("like").alias("relation"),
                                          _prefixed("t", "l_partkey").alias("target_id"))),
        F.when(F.col("is_member"), F.struct(F.lit("membership").alias("relation"),
                                            _prefixed("l", "l_suppkey").alias("target_id"))))
    user_item = (li.select(_prefixed("u", "o_custkey").alias("source_id"),
                           F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
                 .select("source_id", "r.relation", "r.target_id"))

    contain = (lineitem.where((F.col("l_linenumber") == 2) & (F.col("l_quantity") <= 3))
               .select(_prefixed("l", "l_suppkey").alias("source_id"),
                       F.lit("contain").alias("relation"),
                       _prefixed("t", "l_partkey").alias("target_id"))
               .distinct())
    discuss = part.select(_prefixed("t", "p_partkey").alias("source_id"),
                          F.lit("discuss").alias("relation"),
                          _prefixed("h", "p_brand").alias("target_id"))
    return (post.unionByName(social).unionByName(user_item)
            .unionByName(contain).unionByName(discuss))


def hub_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense social graph with a hub: source_id, relation, target_id.

    Each order links its customer to the next order's customer, at every price; orders whose
    key divides by three link to user ``u1`` instead, and those whose key leaves 1 by six come
    from ``u1``, so that one node stands on half of all edges.
    """
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    a = orders.select((key + 1).alias("next_key"), key, "o_custkey", "o_orderstatus")
    b = orders.select(key.alias("next_key"), F.col("o_custkey").alias("b_cust"))
    hub = F.lit("u1")
    return (a.join(b, "next_key")
            .select(F.when(F.pmod(key, F.lit(6)) == 1, hub).otherwise(_prefixed("u", "o_custkey")).alias("source_id"),
                    F.when(F.col("o_orderstatus") == "F", "followers").otherwise("following").alias("relation"),
                    F.when(F.pmod(key, F.lit(3)) == 0, hub).otherwise(_prefixed("u", "b_cust")).alias("target_id")))


def user_records(spark: SparkSession, sf_dir: str, edges_df: DataFrame | None = None) -> DataFrame:
    """Full user records in the reference's JSON shape.

    id, created_at, name, description, protected, verified, profile_image_url,
    public_metrics{followers_count, following_count, tweet_count}. The driver tables
    carry no profile fields, so these stand-ins are derived (documented in README):
    following_count = number of ``following`` edges out of the user; protected =
    negative account balance; verified = AUTOMOBILE segment; description = customer name;
    profile image: none for users without orders, the default image for negative balances,
    a per-user URL otherwise.
    """
    base = users(spark, sf_dir)
    cust = table(spark, sf_dir, "customer").select(
        _prefixed("u", "c_custkey").alias("id"), "c_acctbal", "c_mktsegment")
    e = edges_df if edges_df is not None else edges(spark, sf_dir)
    following = (e.where(F.col("relation") == "following")
                 .groupBy(F.col("source_id").alias("id"))
                 .agg(F.count(F.lit(1)).alias("following_count")))
    image = (F.when(F.col("tweet_count") == 0, F.lit(None).cast("string"))
             .when(F.col("c_acctbal") < 0, F.lit(DEFAULT_PROFILE_IMAGE))
             .otherwise(F.concat(F.lit("https://img.example/"), F.col("id"), F.lit(".png"))))
    return (base.join(cust, "id").join(following, "id", "left")
            .select("id", "created_at", "name",
                    F.col("name").alias("description"),
                    (F.col("c_acctbal") < 0).alias("protected"),
                    (F.col("c_mktsegment") == "AUTOMOBILE").alias("verified"),
                    image.alias("profile_image_url"),
                    F.struct(F.col("followers_count"),
                             F.coalesce(F.col("following_count"), F.lit(0)).cast("bigint")
                             .alias("following_count"),
                             F.col("tweet_count")).alias("public_metrics"),
                    "label"))


@dataclass
class SocialTables:
    users: DataFrame
    tweets: DataFrame
    edges: DataFrame
    labels: DataFrame


def social_tables(spark: SparkSession, sf_dir: str) -> SocialTables:
    u = users(spark, sf_dir)
    return SocialTables(users=u, tweets=tweets(spark, sf_dir), edges=edges(spark, sf_dir),
                        labels=u.select("id", "label"))


#: numbers in vectors, with 8 more for each row, up to which a table of them is broadcast to the tweets
BROADCAST_NUMBERS = 8_388_608


def tweet_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id ('t' || o_orderkey), vec: the text vector of each tweet.

    The driver's ``embeddings`` table stands in for the text model's output: tweet
    ``o_orderkey`` takes vector ``o_orderkey mod n`` where n is the size of that table (one
    scalar count). The join key is computed. A vector table of up to ``BROADCAST_NUMBERS`` (some
    tens of MB) is broadcast to tweets dealt by id, so that joins by id move no vectors; a larger
    one meets them by exchange. The number of partitions is given, as adaptive execution would
    merge them by the size of the ids alone.
    """
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n, numbers = emb.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    tweet = table(spark, sf_dir, "orders").select(_prefixed("t", "o_orderkey").alias("id"), "o_orderkey")
    if numbers + 8 * n <= BROADCAST_NUMBERS:
        tweet = tweet.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
        emb = F.broadcast(emb)
    return (tweet.join(emb, F.pmod(F.col("o_orderkey"), F.lit(n)) == F.col("vec_id"))
            .select("id", F.col("embedding").alias("vec")))
