"""Registered queries: features."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.operators import features as ft
from graphweft.operators import graph as gr
from graphweft.operators import temporal as tp
from graphweft.plans.common import duck_ts, ts_str
from graphweft.plans.oracle_views import with_views
from graphweft.plans.q_graph import UV_CTES, long_rounded, user_vectors
from graphweft.plans.q_temporal import GRID_CTES
from graphweft.session import cut_lineage, spent_shuffles
from graphweft.sources import driver_tables as dt

QUERIES = {}
ORACLES = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


_RT = """SELECT id, tweet_id, created_at, rn FROM (
    SELECT u.id, t.id AS tweet_id, t.created_at,
           CAST(row_number() OVER (PARTITION BY u.id ORDER BY t.created_at DESC, t.id ASC) AS INTEGER) AS rn
    FROM ax_users u JOIN ax_tweets t ON u.id = 'u' || t.author_id WHERE t.text IS NOT NULL) WHERE rn <= 20"""


@register("e1_recent_tweets", with_views(
    f"SELECT id, tweet_id, {duck_ts('created_at')} AS created_at, rn FROM ({_RT})"))
def e1(spark, sf):
    r = ft.recent_tweets(dt.users(spark, sf), dt.tweets(spark, sf))
    return r.select("id", "tweet_id", ts_str("created_at").alias("created_at"), "rn")


@register("e2_c14_recent_tweet_lists", with_views(
    f"""SELECT u.id, coalesce(string_agg(r.tweet_id, ',' ORDER BY r.rn), '') AS tweet_ids
        FROM ax_users u LEFT JOIN ({_RT}) r ON r.id = u.id GROUP BY u.id"""))
def e2(spark, sf):
    lists = ft.recent_tweet_lists(dt.users(spark, sf), dt.tweets(spark, sf))
    return lists.select("id", F.array_join("tweet_ids", ",").alias("tweet_ids"))


@register("d15_c15_recent_tweet_vector", with_views(
    "SELECT id, pos, round(value, 6) AS value FROM uv", UV_CTES))
def d15(spark, sf):
    return long_rounded(user_vectors(spark, sf), ["id"])


@register("d17_zscore_followers", with_views(
    """SELECT id, round((followers_count - avg(followers_count) OVER ())
                        / (stddev_samp(followers_count) OVER () + 1e-8), 6) AS followers_z FROM ax_users"""))
def d17(spark, sf):
    z = ft.zscore(dt.users(spark, sf).select("id", "followers_count"), ["followers_count"], suffix="_z")
    return z.select("id", F.round("followers_count_z", 6).alias("followers_z"))


_NUM_CTES = """nb AS (SELECT r.id, r.followers_count::DOUBLE AS f0, r.following_count::DOUBLE AS f1,
       coalesce(floor((epoch_us(TIMESTAMP '2020-09-05 00:00:00') - epoch_us(r.created_at)) / 86400000000), 0)::DOUBLE AS f2,
       length(coalesce(r.name, ''))::DOUBLE AS f3, coalesce(l.like_count, 0)::DOUBLE AS f4,
       r.tweet_count::DOUBLE AS f5
     FROM ax_records r LEFT JOIN (SELECT source_id AS id, count(DISTINCT target_id) AS like_count
                                  FROM ax_edges WHERE relation = 'like' GROUP BY source_id) l ON l.id = r.id),
nz AS (SELECT id,
       (f0 - avg(f0) OVER ()) / (stddev_samp(f0) OVER () + 1e-8) AS z0,
       (f1 - avg(f1) OVER ()) / (stddev_samp(f1) OVER () + 1e-8) AS z1,
       (f2 - avg(f2) OVER ()) / (stddev_samp(f2) OVER () + 1e-8) AS z2,
       (f3 - avg(f3) OVER ()) / (stddev_samp(f3) OVER () + 1e-8) AS z3,
       (f4 - avg(f4) OVER ()) / (stddev_samp(f4) OVER () + 1e-8) AS z4,
       (f5 - avg(f5) OVER ()) / (stddev_samp(f5) OVER () + 1e-8) AS z5 FROM nb)"""


@register("i4_d17_g3_g4_numeric_block", with_views(
    " UNION ALL ".join(f"SELECT id, {i} AS pos, round(z{i}, 6) AS value FROM nz" for i in range(6)),
    _NUM_CTES))
def i4(spark, sf):
    e = dt.edges(spark, sf)
    nb = ft.numeric_block(dt.user_records(spark, sf, e), e)
    return long_rounded(nb, ["id"], "numeric")


@register("i5_g5_g6_categorical_block", with_views(
    """SELECT id, 0 AS pos, CAST(coalesce(protected, false) AS DOUBLE) AS value FROM ax_records
       UNION ALL SELECT id, 1, CAST(coalesce(verified, false) AS DOUBLE) FROM ax_records
       UNION ALL SELECT id, 2, CASE WHEN profile_image_url IS NULL OR trim(profile_image_url) = ''
            OR profile_image_url = 'https://abs.twimg.com/sticky/default_profile_images/default_profile_normal.png'
            THEN 1.0 ELSE 0.0 END FROM ax_records"""))
def i5(spark, sf):
    cb = ft.categorical_block(dt.user_records(spark, sf))
    return long_rounded(cb, ["id"], "categorical")


@register("i1_hashing_text_embedding", """WITH toks AS (
    SELECT doc_id, tok FROM (SELECT doc_id,
        unnest(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r]+')) AS tok FROM documents) WHERE tok <> ''),
  h AS (SELECT doc_id, md5(tok || ':0') AS h FROM toks),
  c AS (SELECT doc_id, CAST(('0x' || substr(h, 1, 8))::BIGINT % 64 AS INTEGER) AS pos,
               CASE WHEN ('0x' || substr(h, 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM h),
  n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
  v AS (SELECT c.doc_id, c.pos, sum(c.s) / max(n.n) AS value FROM c JOIN n USING (doc_id) GROUP BY c.doc_id, c.pos)
  SELECT d.doc_id, p.pos, round(coalesce(v.value, 0.0), 6) AS value
  FROM documents d CROSS JOIN (SELECT CAST(range AS INTEGER) AS pos FROM range(64)) p
  LEFT JOIN v ON v.doc_id = d.doc_id AND v.pos = p.pos""")
def i1(spark, sf):
    docs = dt.table(spark, sf, "documents").select("doc_id", "text")
    emb = text.hashing_embed(docs, "doc_id", "text", dim=64)
    return long_rounded(emb, ["doc_id"])


def _weights_sql(name: str, in_dim: int, out_dim: int, seed: int = 42) -> str:
    bound = f"(1.0 / sqrt({in_dim}))"
    u = "(('0x' || substr(md5({k}), 1, 13))::BIGINT / 4503599627370496.0)"
    wk = f"'{name}:' || i || ':' || j || ':{seed}'"
    bk = f"'{name}:b:' || i || ':{seed}'"
    return (f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, (2.0 * {u.format(k=wk)} - 1.0) * {bound} AS w "
            f"FROM range({out_dim}) a(i) CROSS JOIN range({in_dim}) b(j)",
            f"SELECT CAST(i AS INTEGER) AS i, (2.0 * {u.format(k=bk)} - 1.0) * {bound} AS b FROM range({out_dim}) a(i)")


_PW, _PB = _weights_sql("tweet_proj", 64, 32)
PROJ_CTES = f"""pw AS ({_PW}), pb AS ({_PB}),
el AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j,
              CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
pe_raw AS (SELECT el.vec_id, pw.i, sum(pw.w * el.x) + max(pb.b) AS y FROM el JOIN pw ON pw.j = el.j
           JOIN pb ON pb.i = pw.i GROUP BY el.vec_id, pw.i),
pemb AS (SELECT vec_id, i AS pos, CASE WHEN y > 0 THEN y ELSE 0.01 * y END AS value FROM pe_raw),
ptv AS (SELECT 't' || o.o_orderkey AS tweet_id, p.pos, p.value FROM orders o
        JOIN pemb p ON p.vec_id = o.o_orderkey % (SELECT count(*) FROM embeddings))"""


def projected_posts(spark, sf, snap):
    """Change rows of the mean projected posts."""
    return ft.posted_vector_changes(snap, dt.tweet_vectors(spark, sf), lambda v: ft.project(v, "tweet_proj", 64, 32))


@register("d16_i3_posted_vector_changes", with_views(
    """SELECT id, fs AS snapshot_idx, pos,
              round(sum(s) OVER w / sum(n) OVER w, 6) AS value FROM (
         SELECT pe.id, pe.fs, p.pos, sum(p.value) AS s, count(*) AS n
         FROM (SELECT ea.source_id AS id, ea.target_id AS tweet_id,
                      (SELECT min(snapshot_idx) FROM grid WHERE grid.ts >= ea.active_from) AS fs
               FROM ea WHERE ea.relation = 'post') pe
         JOIN ptv p ON p.tweet_id = pe.tweet_id WHERE pe.fs IS NOT NULL GROUP BY pe.id, pe.fs, p.pos)
       WINDOW w AS (PARTITION BY id, pos ORDER BY fs ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    GRID_CTES + ",\n" + PROJ_CTES))
def d16(spark, sf):
    snap = tp.build_snapshots(dt.users(spark, sf), dt.tweets(spark, sf), dt.edges(spark, sf))
    ch = projected_posts(spark, sf, snap)
    return long_rounded(ch, ["id", "snapshot_idx"])


@register("i3_temporal_user_vectors")
def i3(spark, sf):
    """Static vector (pooled tweets) ++ running mean of projected posts, as change rows. The static
    vectors, one of a user, are written first: what their tweets' vectors took on disk is free again
    when those of the posts are dealt."""
    snap = tp.build_snapshots(dt.users(spark, sf), dt.tweets(spark, sf), dt.edges(spark, sf))
    with spent_shuffles(spark):
        static = cut_lineage(user_vectors(spark, sf))
    return ft.temporal_user_vectors(snap, static, dt.tweet_vectors(spark, sf), tweet_dim=128)


@register("i3_vectors_as_of", with_views(
    """SELECT g.snapshot_idx, u.id, round(coalesce(sum(p.total) / nullif(count(p.tweet_id), 0), 0.0), 5) AS total
       FROM grid g JOIN ax_users u ON u.created_at <= g.ts
       LEFT JOIN (SELECT ea.source_id AS id, ea.active_from, ea.target_id AS tweet_id, t.total FROM ea
                  JOIN (SELECT tweet_id, sum(value) AS total FROM ptv GROUP BY tweet_id) t ON t.tweet_id = ea.target_id
                  WHERE ea.relation = 'post') p ON p.id = u.id AND p.active_from <= g.ts
       GROUP BY g.snapshot_idx, u.id""",
    GRID_CTES + ",\n" + PROJ_CTES))
def i3_as_of(spark, sf):
    """Mean projected posts of every active user in every snapshot, read from change rows; a
    vector is returned as the sum of its entries. Users stay in ranges of snapshots until the end."""
    snap = tp.build_snapshots(dt.users(spark, sf), dt.tweets(spark, sf), dt.edges(spark, sf))
    changes = projected_posts(spark, sf, snap)
    asked = tp.memberships(snap, tp.snapshot_index(snap), ranges=True)
    total = F.aggregate("vec", F.lit(0.0).cast("double"), lambda a, x: a + x)
    read = ft.vectors_as_of(changes, asked, 32).select("snapshot_idx", "upto", "id", F.round(total, 5).alias("total"))
    return tp.each(read)


@register("i2_static_fuse")
def i2(spark, sf):
    """Desc (hashing embedder), pooled tweets, numeric and categorical blocks fused to 128."""
    e = dt.edges(spark, sf)
    recs = dt.user_records(spark, sf, e)
    desc = text.hashing_embed(recs, "id", "description", dim=64)
    return ft.static_fuse(desc, ft.numeric_block(recs, e), ft.categorical_block(recs),
                          tweet=user_vectors(spark, sf), dim=128)


_P_CTES = """pv AS (SELECT CAST(range AS INTEGER) AS pos,
   (2.0 * (('0x' || substr(md5('topk:' || range || ':42'), 1, 13))::BIGINT / 4503599627370496.0) - 1.0)
   * (1.0 / sqrt(64)) AS p FROM range(64)),
sc AS (SELECT uv.id, sum(uv.value * pv.p) / ((SELECT sqrt(sum(p * p)) FROM pv) + 1e-8) AS score, sum(uv.value) AS total
       FROM uv JOIN pv ON pv.pos = uv.pos GROUP BY uv.id),
act AS (SELECT g.snapshot_idx, u.id, sc.score, sc.total FROM grid g JOIN ax_users u ON u.created_at <= g.ts
        JOIN sc ON sc.id = u.id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_idx ORDER BY score DESC, id) AS rank
        FROM act) WHERE rank <= 5),
cnt AS (SELECT snapshot_idx, count(*) AS n FROM top GROUP BY snapshot_idx),
slots AS (SELECT g.snapshot_idx, r.rank, least(r.rank, coalesce(c.n, 0)) AS src FROM grid g
          CROSS JOIN (SELECT range + 1 AS rank FROM range(5)) r LEFT JOIN cnt c ON c.snapshot_idx = g.snapshot_idx)"""


@register("e12_topk_nodes_per_snapshot", with_views(
    """SELECT s.snapshot_idx, CAST(s.rank AS INTEGER) AS rank, t.id, round(t.score, 8) AS score,
              round(coalesce(tanh(t.score), 0.0), 6) AS weight, round(coalesce(t.total * tanh(t.score), 0.0), 6) AS vec_total
       FROM slots s LEFT JOIN top t ON t.snapshot_idx = s.snapshot_idx AND t.rank = s.src""",
    GRID_CTES + ",\n" + UV_CTES + ",\n" + _P_CTES))
def e12(spark, sf):
    snap = tp.build_snapshots(dt.users(spark, sf), dt.tweets(spark, sf), dt.edges(spark, sf))
    top = ft.topk_per_snapshot(snap, user_vectors(spark, sf), k=5, dim=64)
    total = F.aggregate("vec", F.lit(0.0).cast("double"), lambda a, x: a + x)
    return top.select("snapshot_idx", "rank", "id", F.round("score", 8).alias("score"), F.round("weight", 6).alias("weight"),
                      F.round(total, 6).alias("vec_total"))


@register("h8_per_snapshot", with_views(
    """SELECT o.snapshot_idx, o.id, o.pos, round(o.value + coalesce(r.value, 0), 6) AS value
       FROM (SELECT k.snapshot_idx, uv.id, uv.pos, uv.value FROM snaps k JOIN ax_users u ON u.created_at <= k.ts
             JOIN uv ON uv.id = u.id) o
       LEFT JOIN (SELECT p.snapshot_idx, p.row AS id, uv.pos,
                         sum(p.mult * pow(dr.d, -0.5) * coalesce(pow(dc.d, -0.5), 0) * uv.value) AS value
                  FROM (SELECT snapshot_idx, source_id AS row, relation, target_id AS col, count(*) AS mult FROM es
                        GROUP BY 1, 2, 3, 4) p
                  JOIN dd dr ON dr.snapshot_idx = p.snapshot_idx AND dr.node = p.row AND dr.relation = p.relation
                  LEFT JOIN dd dc ON dc.snapshot_idx = p.snapshot_idx AND dc.node = p.col AND dc.relation = p.relation
                  JOIN uv ON uv.id = p.col GROUP BY p.snapshot_idx, p.row, uv.pos) r
         ON r.snapshot_idx = o.snapshot_idx AND r.id = o.id AND r.pos = o.pos""",
    GRID_CTES + ",\n" + UV_CTES + """,
    snaps AS (SELECT snapshot_idx, ts FROM grid WHERE snapshot_idx IN (50, 150)),
    es AS (SELECT k.snapshot_idx, ea.source_id, ea.relation, ea.target_id FROM snaps k JOIN ea ON ea.active_from <= k.ts
           WHERE ea.relation IN ('following','followers')),
    dd AS (SELECT snapshot_idx, source_id AS node, relation, count(*) AS d FROM es GROUP BY 1, 2, 3)"""))
def h8_snapshots(spark, sf):
    """Own vector plus the normalised sums of the relations, in the graphs of two snapshots."""
    snap = tp.build_snapshots(dt.users(spark, sf), dt.tweets(spark, sf), dt.edges(spark, sf))
    wanted = F.array(*[F.lit(i).cast("bigint") for i in (50, 150)])
    at = F.explode(F.filter(wanted, lambda i: i >= F.col("first_snapshot"))).alias("snapshot_idx")
    edges = snap.edges.where(F.col("relation").isin(list(dt.SOCIAL_RELATIONS))).select(at, "source_id", "relation", "target_id")
    vectors = user_vectors(spark, sf)
    nodes = snap.users.select(at, "id").join(vectors, "id")
    sums = gr.normalised_relational_sum(edges, vectors, keys=["snapshot_idx"])
    return long_rounded(gr.with_own_term(sums, nodes, keys=["snapshot_idx"]), ["snapshot_idx", "id"])


@register("h8_all_snapshots")
def h8_all(spark, sf):
    """The same in the graphs of all snapshots, as change rows."""
    snap = tp.build_snapshots(dt.users(spark, sf), dt.tweets(spark, sf), dt.edges(spark, sf))
    edges = snap.edges.where(F.col("relation").isin(list(dt.SOCIAL_RELATIONS)))
    changes = gr.relational_sum_changes(edges, user_vectors(spark, sf), snap.users, dim=64)
    return changes.withColumn("value", F.round("value", 6))


@register("c16_snapshot_100_user_vectors", with_views(
    """SELECT uv.id, CASE WHEN u.label = 'bot' THEN 1 ELSE 0 END AS y, uv.pos, round(uv.value, 6) AS value
       FROM uv JOIN ax_users u ON u.id = uv.id
       WHERE u.created_at <= (SELECT ts FROM grid WHERE snapshot_idx = 100)""",
    GRID_CTES + ",\n" + UV_CTES))
def c16(spark, sf):
    """Vectors and label codes of the users active in snapshot 100 (joined by id)."""
    from graphweft.operators import relational as rel
    users = dt.users(spark, sf)
    snap = tp.snapshot_at(tp.build_snapshots(users, dt.tweets(spark, sf), dt.edges(spark, sf)), 100)
    codes = rel.align_labels(users, dt.labels(spark, sf))
    active = snap.users.select("id").join(codes, "id").join(user_vectors(spark, sf), "id")
    return long_rounded(active, ["id", "y"])


@register("g13_record_json")
def g13(spark, sf):
    """Records to JSON text (the extractor's output lines); JSON formatting is engine-specific,
    so this one is checked by rows only."""
    recs = dt.user_records(spark, sf)
    return recs.select("id", F.to_json(F.struct(*[c for c in recs.columns])).alias("json"))
