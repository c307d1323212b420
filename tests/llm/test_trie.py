"""The prefix trie, held against a dictionary of all prefixes."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.llm import prefix_trie as trie
from graphweft.llm import running

TURNS = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += cost
            leaves[k[:d]] += k not in children
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items())


def result(spark, rows, **params):
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    got = trie.trie(df, trie.TrieParams(**params)).select(*COLUMNS).collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in got)


def made(seed, n=160, few=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(-25, n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", " ", "d  e f"][:few])))
    return rows


@pytest.mark.parametrize("block,chunk,few", [(4096, 64, 3), (7, 2, 2), (16, 1, 4), (1, 3, 2)])
def test_nodes_are_those_of_a_dictionary(spark, block, chunk, few):
    rows = made(block, few=few)
    same = [(500 + k, t, "user", f"x{t} y") for k in range(70) for t in range(3)]
    chain = [(1000 + k, t, "user", f"s{t}") for k in range(12) for t in range(k * 3 + 4)]
    rows += same + chain
    assert result(spark, rows, block=block, chunk=chunk, ids=8) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 2, "user", "x " * 70_000),
            (None, 1, "user", "lost"), (None, None, None, None), (2, 0, "user", ""), (2, None, "", "first"),
            (2**62, 1, "user", "far"), (-(2**62), 1, "user", "far"), (41, 0, "user", "z"), (40, 0, "user", "q")]
    assert result(spark, rows) == brute(rows)
    clash = spark.createDataFrame(rows, TURNS)
    for name in ("depth", "idx", "words", "part", "place", "class", "key", "lcp"):
        clash = clash.withColumn(name, F.lit("7"))
    got = trie.trie(clash)
    assert got.columns == COLUMNS and got.count() == len(brute(rows))
    assert trie.trie(spark.createDataFrame([], TURNS)).collect() == []
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).columns == COLUMNS


def test_minima_search_both_sides_alike():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        values = rng.integers(0, 5, n)
        table = trie.Minima(values)
        for at in range(n):
            for least in range(6):
                r = at
                while r + 1 < n and values[r + 1] >= least:
                    r += 1
                left = at
                while left >= 0 and values[left] >= least:
                    left -= 1
                one = np.array([at]), np.array([least])
                assert (table.right(*one)[0], table.left(*one)[0]) == (r, left)
            for hi in range(at, n):
                assert table.least(np.array([at]), np.array([hi]))[0] == values[at:hi + 1].min()


def test_positions_and_sums_of_a_hot_group(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("long").alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("o"),
                                  F.col("id").alias("v"))
    df = df.withColumn("g", F.when(F.col("v") > 5, F.col("g")))  # most rows under null and two groups
    rows = running.numbered(df, "g", ["o"], "pos", {"upto": F.col("v")}).collect()
    for g in {r.g for r in rows}:
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own))) and [r.o for r in own] == sorted(r.o for r in own)
        assert [r.upto for r in own] == np.cumsum([r.v for r in own]).tolist()
