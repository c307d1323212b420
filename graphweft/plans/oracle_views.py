"""The driver-table views as DuckDB SQL, shared by every oracle query.

``with_views(body)`` prefixes a query with the CTEs ``ax_users``, ``ax_tweets``,
``ax_edges``, ``ax_records``. The text mirrors ``graphweft.sources.driver_tables``.
"""

AX_USERS = """ax_users AS (
  SELECT concat('u', c.c_custkey) AS id, c.c_name AS name, f.created_at,
         CAST(floor(abs(c.c_acctbal)) AS BIGINT) AS followers_count,
         CAST(coalesce(f.n_orders, 0) AS BIGINT) AS tweet_count,
         CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'bot' ELSE 'human' END AS label
  FROM customer c
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at, count(*) AS n_orders
             FROM orders GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey)"""

AX_TWEETS = """ax_tweets AS (
  SELECT concat('t', o_orderkey) AS id, o_custkey AS author_id,
         o_orderdate AS created_at, o_orderpriority AS text
  FROM orders)"""

AX_EDGES = """ax_edges AS (
  SELECT concat('u', o_custkey) AS source_id, 'post' AS relation, concat('t', o_orderkey) AS target_id FROM orders
  UNION ALL
  SELECT concat('u', a.o_custkey),
         CASE WHEN a.o_orderstatus = 'F' THEN 'followers' ELSE 'following' END,
         concat('u', b.o_custkey)
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_totalprice > 450000
  UNION ALL
  SELECT concat('u', o_custkey), 'like', concat('t', l_partkey)
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity <= 5
  UNION ALL
  SELECT concat('u', o_custkey), 'membership', concat('l', l_suppkey)
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND l_quantity <= 3
  UNION ALL
  SELECT DISTINCT concat('l', l_suppkey), 'contain', concat('t', l_partkey)
  FROM lineitem WHERE l_linenumber = 2 AND l_quantity <= 3
  UNION ALL
  SELECT concat('t', p_partkey), 'discuss', concat('h', p_brand) FROM part)"""

AX_RECORDS = """ax_records AS (
  SELECT u.id, u.created_at, u.name, u.name AS description,
         c.c_acctbal < 0 AS protected, c.c_mktsegment = 'AUTOMOBILE' AS verified,
         CASE WHEN u.tweet_count = 0 THEN NULL
              WHEN c.c_acctbal < 0 THEN 'https://abs.twimg.com/sticky/default_profile_images/default_profile_normal.png'
              ELSE 'https://img.example/' || u.id || '.png' END AS profile_image_url,
         u.followers_count, CAST(coalesce(fo.following_count, 0) AS BIGINT) AS following_count,
         u.tweet_count, u.label
  FROM ax_users u JOIN customer c ON concat('u', c.c_custkey) = u.id
  LEFT JOIN (SELECT source_id AS id, count(*) AS following_count FROM ax_edges
             WHERE relation = 'following' GROUP BY source_id) fo ON fo.id = u.id)"""


def with_views(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    """``WITH <views>[, extra] <body>``; ``body`` starts with SELECT."""
    ctes = ",\n".join([AX_USERS, AX_TWEETS, AX_EDGES, AX_RECORDS])
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip().rstrip(",")
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def uniform_sql(key_sql: str, seed) -> str:
    return (f"(('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || ':{seed}'), 1, 13))::BIGINT"
            f" / 4503599627370496.0)")
