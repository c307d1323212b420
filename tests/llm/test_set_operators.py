"""Operators on pairs, conversations and mixes, and the pipeline, held against brute force."""

import collections
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphweft.llm import bitmaps, chat, components, decontaminate, langid, minhash, mixing, vectors
from graphweft.session import text_batches

from .helpers import SCHEMA, rows_of, sentence


def reach(n, linked):
    """Smallest index that each index reaches."""
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i]] + [root[j] for j in linked[i]]) for i in range(n)]
        if new == root:
            return root
        root = new


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 5), (9, 8), (8, 9), (141, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in [7, 141, *range(200, 260)]} == {7}
    assert got[9] == got[8] == 8 and 5 not in got


def test_spanning_stars_join_what_is_linked():
    rng = np.random.default_rng(3)
    for _ in range(20):
        linked = rng.random((9, 7)) < 0.12
        a, b = np.arange(9), np.arange(9, 16)
        near = [[] for _ in range(16)]
        for i, j in zip(*np.nonzero(linked)):
            near[i].append(int(b[j]))
            near[b[j]].append(int(i))
        stars = [[] for _ in range(16)]
        for x, y in components.spanning_stars(linked, a, b):
            stars[x].append(y)
            stars[y].append(x)
        assert reach(16, near) == reach(16, stars)


def test_bitmap_lets_all_keys_through(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k"))
    made = bitmaps.bitmap(keys, F.col("k"), 20)
    mine = np.array([r.k for r in keys.collect()], np.int64)
    other = np.array([r.k for r in spark.range(1, 3000, 3).select(F.xxhash64("id").alias("k")).collect()], np.int64)
    assert made.has(mine).all() and made.has(other).mean() < 0.01


def near_copies(rng):
    """Families of copies with one to many changed words, chains and a family under the threshold."""
    texts = []
    for family in range(3):
        base = sentence("en", 120, rng).split()
        for copy in range(12):
            own = list(base)
            for _ in range(copy % 4):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(own))
        chain = list(base)
        for step in range(8):
            chain[13 * step + 3] = f"c{family}{step}"
            texts.append(" ".join(chain))
    for copy in range(40):  # alike, but hardly linked
        own = base[:]
        for k in rng.sample(range(120), 4):
            own[k] = f"v{copy}{k}"
        texts.append(" ".join(own))
    return texts + ["a b", "A  b", "a b c d e", "", None, None, " "]


def brute_components(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    near = [[j for j, b in enumerate(sets) if a and b and 100 * len(a & b) >= 85 * len(a | b)] for a in sets]
    return [len(s) for s in sets], reach(len(texts), near)


@pytest.mark.parametrize("block", [8])
def test_near_duplicates_are_exact_components(spark, rng, block):
    texts = near_copies(rng)
    docs = spark.createDataFrame(rows_of(texts, first=0), SCHEMA)
    sizes, want = brute_components(texts)
    p = minhash.MinHashParams(block=block, block_members=1 << 20 if block > 8 else 300)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, p).collect()}
    assert [got[k].n_shingles for k in range(len(texts))] == sizes
    assert [got[k].component_id for k in range(len(texts))] == want
    assert [got[k].kept for k in range(len(texts))] == [k == w for k, w in enumerate(want)]


def test_pipeline_stage_links_from_080(spark, rng):
    texts = []
    for family in range(30):  # one word changed: 5 of n shingles differ
        base = [f"f{family}w{k}" for k in range(40 + family)]
        texts += [" ".join(base), " ".join([*base[:20], "x", *base[21:]])]
    low = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    share = [100 * len(a & b) / len(a | b) for a, b in zip(low[::2], low[1::2])]
    assert min(share) < 80 < 85 < max(share) and sum(80 <= x < 85 for x in share) > 5
    left = {r.doc_id for r in minhash.stage(spark, spark.createDataFrame(rows_of(texts, first=0), SCHEMA), "").collect()}
    assert left == {2 * k for k in range(30)} | {2 * k + 1 for k, x in enumerate(share) if x < 80}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stages_send_python_no_whole_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, "a benchmark item of some nine or ten words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (langid.stage, minhash.stage, decontaminate.stage):
        assert "MapInArrow" not in _plan(stage(spark, odd, str(tmp_path)))


def test_text_batches_are_small_whatever_the_texts(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    texts = spark.range(0, 40, numPartitions=1).select(F.expr("repeat('x', 1000000)").alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with text_batches(spark):
        found = [r.n for r in texts.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) == 40 and max(found) <= 6
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(4)
    p = minhash.MinHashParams()
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    other = base.copy()
    other[:150] = rng.integers(0, 2**63, 150, dtype=np.uint64)  # similarity 0.86
    far = base.copy()
    far[:1200] = rng.integers(0, 2**63, 1200, dtype=np.uint64)  # 0.25
    sketch = minhash.odd_sketch(minhash._signatures(np.concatenate([base, other, far]), np.array([0, 2000, 4000, 6000]), p), p.sketch_bits)
    bits = [int(np.bitwise_count(sketch[0] ^ sketch[k]).sum()) for k in (1, 2)]
    assert bits[0] <= minhash.sketch_distance_limit(p) < bits[1]


def test_near_duplicate_rows_with_nulls_and_repeats(spark, odd, clash, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.component_id == 9 for r in by[9] + by[10]) and [r.kept for r in by[10]] == [False]
    assert sorted(str(r.component_id) for r in by[None]) == ["9", "None", "None"]
    left = minhash.stage(spark, clash, "")
    ids = collections.Counter(r.doc_id for r in left.collect())
    assert left.columns == clash.columns and ids[9] == 1 and ids[10] == 0 and ids[1] == 1 and ids[None] == 2
    assert minhash.near_duplicates(empty).count() == 0 and minhash.stage(spark, empty, "").count() == 0


@pytest.mark.parametrize("params", [vectors.RangeJoinParams(cell=40, block=25)])
def test_range_join_is_exact(spark, params):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(15, 8))
    x = np.concatenate([b + rng.normal(scale=s, size=(9, 8)) for b in base for s in (0.05, 0.25)]).astype(np.float32)
    x = np.concatenate([x, x[:6], 3 * x[:2], rng.normal(size=(40, 8)).astype(np.float32)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, []),
           (905, [1.0, 2.0]), (906, [1.0, 2.1]), (None, [5.0, -5.0]), (905, [1.0, 2.0])]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for r in vectors.range_join(table, params).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    d = x.astype(np.float64)
    n = np.sqrt((d * d).sum(axis=1))
    linked = [[j for j in range(len(d)) if j != i and d[i] @ d[j] / (n[i] * n[j]) >= 0.95] for i in range(len(d))]
    root = reach(len(d), linked)
    assert [got[k] for k in range(len(d))] == [[(len(linked[k]), root[k], root[k] == k)] for k in range(len(d))]
    assert [got[k] for k in (900, 901, 902, 903, 904)] == [[(0, k, True)] for k in (900, 901, 902, 903, 904)]
    assert got[905] == [(2, 905, True)] * 2 and got[906] == [(2, 905, False)] and got[None] == [(0, None, True)]
    assert vectors.range_join(table.limit(0)).count() == 0


def test_targets_fill_up_to_their_limits(spark):
    sizes = {None: 50.0, "a": 1000.0, "b": 10.0, "c": 5.0, "d": 400.0, "e": 0.0}
    got = {r.source: r.target for r in mixing.source_targets(
        spark.createDataFrame([(s, int(n)) for s, n in sizes.items()], "source string, source_size bigint")).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        unit = (total - sum(fixed.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if unit * weight[s] > 3 * sizes[s]]
        if not above:
            break
        fixed |= {s: 3 * sizes[s] for s in above}
    want = {s: fixed.get(s, unit * weight[s]) for s in names}
    assert got == pytest.approx(want)


def test_pivotal_pass_keeps_words_and_expectations():
    rng = np.random.default_rng(6)
    sizes, shares = [50.0, 20.0, 10.0, 5.0, 5.0], [0.3, 0.6, 0.5, 0.2, 0.7]
    mean = np.zeros(5)
    for _ in range(4000):
        out, last = mixing.pivotal_pass(list(range(5)), sizes, shares, lambda _: rng.random())
        assert sum(s * x for s, x in zip(sizes, out)) == pytest.approx(sum(s * x for s, x in zip(sizes, shares)))
        assert sum(0 < x < 1 for x in out) == (last is not None)
        mean += out
    assert mean / 4000 == pytest.approx(shares, abs=0.03)


def test_mix_is_near_its_targets_and_the_same_on_reruns(spark, odd, clash, empty, rng):
    rows = [(k, sentence("en", rng.randint(1, 60), rng), "en", f"s{k % 5}" if k % 3 else "s0", 1) for k in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd)
    sized = mixing.with_size(docs.select(F.col("doc_id").cast("string").alias("key"), "source", "text"))
    p = mixing.MixParams(group=32)
    got = mixing.mix(sized, p).collect()
    again = mixing.mix(sized.repartition(7), p).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == docs.count()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.copies <= 3 for r in own)
    out = mixing.stage(spark, clash, "")
    assert set(clash.columns) <= set(out.columns) and out.filter("doc_id is null and text is null").isEmpty()
    assert mixing.stage(spark, empty, "").count() == 0
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()]
    assert sorted(r.size for r in got) == sorted(words)


def test_snapshots_collapse_into_the_longest(spark):
    full = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "")]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(full[:2])] + [(2, k, r, t) for k, (r, t) in enumerate(full)]
    rows += [(3, k, r, t) for k, (r, t) in enumerate(full)] + [(4, 0, "user", "other"), (4, 0, "user", "other")]
    rows += [(5, k, r, t) for k, (r, t) in enumerate(full[:3])] + [(5, 3, "assistant", "<|im_end|> x")]
    rows += [(6, None, None, None), (None, 0, "user", "lost"), (7, 0, "user", "two"), (7, 0, "system", "two"), (8, 2000, "user", "late"),
             (8, 0, "user", "early")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("h1", F.lit(3))
    got = chat.render(turns, chat.maximal(turns)).collect()
    assert sorted((str(r.conv_id), r.part) for r in got if r.conv_id not in (6,)) == [
        ("2", 0), ("4", 0), ("5", 0), ("7", 0), ("8", 0), ("None", 0)]  # parts are cut by rows, not by turn numbers
    by = {(r.conv_id, r.part): r for r in got}
    assert by[2, 0].text.startswith("<|im_start|>user\nhi<|im_end|>\n") and by[2, 0].n_turns == 4
    assert by[4, 0].n_turns == 1 and "< |im_end|> x<|im_end|>" in by[5, 0].text
    con = duckdb.connect()
    conversations = turns.drop("h1").filter("turn is not null").toPandas()  # noqa: F841  (read by the SQL)
    want = con.execute(chat.ORACLE).fetchall()
    known = [tuple(r) for r in chat.render(turns.filter("turn is not null"), chat.maximal(turns.filter("turn is not null"))).collect()]
    assert sorted(map(str, known)) == sorted(str((None if c != c or c is None else int(c), p, n, t)) for c, p, n, t in want)
    assert chat.render(turns.limit(0), chat.maximal(turns.limit(0))).count() == 0


def test_pipeline_applies_every_stage(spark, tmp_path, rng):
    import corpus_pipeline

    item = sentence("de", 30, rng)
    secret = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"
    base = sentence("en", 100, rng)
    texts = [base, base + " more", f"{sentence('de', 20, rng)} {item}", f"token={secret} {sentence('fr', 30, rng)}", None, "1 2 3"]
    rows = [(k, t, lang, f"s{k % 2}", 1) for k, (t, lang) in enumerate(zip(texts, ["en", "en", "de", "fr", "en", "en"]))]
    rows += [(10 + k, sentence(x, 25, rng), x, f"s{k % 3}", 1) for k, x in enumerate(["en", "de", "fr"] * 30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [set(s) for s in seen]
    every = {r[0] for r in rows}
    assert every - ids[0] == {4, 5} and ids[0] - ids[1] == {1} and ids[1] - ids[2] == {2} and ids[2] == ids[3]
    assert secret not in seen[3][3].text and seen[3][0].text == base
    mix = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in mix} <= ids[3] and max(r.copy for r in mix) <= 3
    for s in {r.source for r in mix}:
        own = [r for r in mix if r.source == s]
        assert abs(sum(r.size for r in own) - own[0].target) <= max(r.size for r in own)


def test_rendering_is_cut_by_rows_whatever_the_turn_numbers(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(None, None, "user", f"text {k:04d}") for k in range(500)]  # a third of the rows, all with one null turn
    rows += [(7, 0, "user", f"same turn {k:04d}") for k in range(500)] + [(10 + k, k % 3, "user", f"t{k}") for k in range(500)]
    turns = spark.createDataFrame(rows, schema).repartition(5)
    kept = turns.select("conv_id").distinct()
    got = chat.render(turns, kept, chat.ChatParams(block=64)).collect()
    assert max(r.n_turns for r in got) == 64 and sum(r.n_turns for r in got) == len(rows)
    for conv, first in ((None, "text"), (7, "same turn")):
        own = sorted((r.part, r.text) for r in got if r.conv_id == conv)
        assert [p for p, _ in own] == list(range(8))
        assert re.findall(rf"{first} (\d+)", "".join(t for _, t in own)) == [f"{k:04d}" for k in range(500)]
