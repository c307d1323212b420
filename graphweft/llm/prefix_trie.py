"""Prefix trie of conversations by range minima over sorted LCPs (operator 11).

Conversations with equal turns are one class. Classes are sorted by the hashes of their
turns, turn after turn, so that the members of every prefix stand next to each other, and
``lcp`` of a class is the number of turns it shares with the one before it. A node of the trie
is a pair (place, depth): the first class that starts with the prefix, and the prefix's
length, which is above that class's ``lcp``. Blocks of places build a sparse table of range
minima over ``lcp``, and each candidate prefix searches it for its own left and right end,
independently of all others: to the right for every shared prefix that begins at a place, to
the left for the prefix that a place shares with the one before, which is the parent of its
first new node. What reaches over a block's border is looked up once for each (block, depth)
in a second sparse table, over the minima of the blocks, and ends in the block found there.
Numbers of members, of leaves and of saved tokens are differences of running sums over places,
the smallest member a second range minimum.

Sizes: no conversation is ever put together in one row or task. Turns are 40-byte rows of
hashes and word counts, numbered by ranges. A sort key holds as many chunks of turn hashes as
a class has in common with another class, and one more, so it is long only where two
different conversations agree over long stretches. There are ``max_blocks`` blocks at most,
so the block table that travels with the tasks has a fixed bound; blocks grow instead.

Defined results: rows without conv_id belong to no conversation and are left out. A null turn
comes first; rows with the same turn stand in the order of their role, then of a hash of
their text; repeated rows are turns like all others. A null role or text is empty. Ties of
whole conversations are members of one node. Texts are hashed whole; other columns are not
carried along. An empty table gives no rows, not even a root. ``%`` is the remainder with the
sign of the dividend.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.llm.running import numbered
from graphweft.session import cut_lineage


@dataclass(frozen=True)
class TrieParams:
    """``chunk`` turns of a sort key are compared at once. A block has ``block`` places, or
    more if there were more than ``max_blocks`` otherwise. ``ids`` conv_ids at most are put
    into one string while the list of a node's ends is hashed."""

    chunk: int = 64
    block: int = 4096
    max_blocks: int = 1 << 16
    ids: int = 4096
    base_step: int = 20
    head_turns: int = 4


def coded_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, idx (from 0), t1 and t2 (128-bit hash of role and text) and words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turn = F.col("turn").cast("long")
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.isNotNull().alias("has_turn"), turn.alias("turn"),
        role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"),
        words.cast("long").alias("words"))
    return numbered(rows, "conv_id", ["has_turn", "turn", "role", "t1", "t2"], "idx").select(
        "conv_id", "idx", "t1", "t2", "words")


def rebuilt(turns: DataFrame, p: TrieParams) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the head of another one: turns (conv_id, idx, t1, t2,
    words) and conversations (conv_id, size), those without turns too.

    A conversation's first h turns are those of the conversation conv_id - conv_id % step, and
    its own follow from the h-th on; h is a hash of its conv_id, below ``head_turns``.
    """
    conv = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    ids = sizes.select("conv_id", "own", (conv - conv % p.base_step).alias("base"),
                       (F.crc32(conv.cast("string")) % p.head_turns).alias("h"))
    base_size = sizes.select(F.col("conv_id").alias("b"), F.col("own").alias("base_own"))
    ids = cut_lineage(ids.join(base_size, F.col("base") == F.col("b"), "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("head"),
        (F.least("h", F.coalesce("base_own", F.lit(0))) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")))
    heads = (turns.filter((conv % p.base_step == 0) & (F.col("idx") < p.head_turns - 1))
             .withColumnRenamed("conv_id", "b"))
    first = (ids.select("conv_id", "base", "h").join(heads, (F.col("base") == F.col("b")) & (F.col("idx") < F.col("h")))
             .select("conv_id", "idx", "t1", "t2", "words"))
    own = (turns.join(ids.select(F.col("conv_id").alias("c"), "h", "head"), conv == F.col("c"))
           .filter(F.col("idx") >= F.col("h"))
           .select("conv_id", (F.col("idx") - F.col("h") + F.col("head")).alias("idx"), "t1", "t2", "words"))
    return first.unionByName(own), ids.select("conv_id", "size")


def classes(turns: DataFrame, convs: DataFrame, p: TrieParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Equal conversations as one: members (conv_id, class), where class is the smallest
    conv_id; classes (class, size, n); and the turns of that conversation (class, idx, t1, t2,
    words)."""
    # each turn's hash depends on its place, so a conversation is an exclusive-or of hashes
    code = [F.bit_xor(F.xxhash64(F.lit(seed), "idx", "t1", "t2")).alias(f"s{seed}") for seed in (1, 2)]
    whole = turns.groupBy("conv_id").agg(*code)
    named = convs.join(whole.withColumnRenamed("conv_id", "c"), F.col("conv_id") == F.col("c"), "left").select(
        "conv_id", "size", F.coalesce("s1", F.lit(0)).alias("s1"), F.coalesce("s2", F.lit(0)).alias("s2"))
    named = cut_lineage(named)
    each = cut_lineage(named.groupBy("size", "s1", "s2").agg(F.min("conv_id").alias("class"), F.count(F.lit(1)).alias("n")))
    same = [F.col(c) == F.col(f"k_{c}") for c in ("size", "s1", "s2")]
    keyed = each.select(*[F.col(c).alias(f"k_{c}") for c in ("size", "s1", "s2")], "class")
    members = cut_lineage(named.join(keyed, same).select("conv_id", "class"))
    kept = turns.join(each.select(F.col("class").alias("c")), F.col("conv_id") == F.col("c"), "left_semi")
    return members, each.select("class", "size", "n"), kept.withColumnRenamed("conv_id", "class")


def sort_keys(each: DataFrame, turns: DataFrame, p: TrieParams) -> DataFrame:
    """class, size, n and key: the turn hashes that tell the class from all others, in order.

    Of the chunks that a class has it needs those whose end it reaches with the same turns as
    another class, and one more.
    """
    chunk = F.floor(F.col("idx") / p.chunk).cast("long")
    coded = turns.select("class", chunk.alias("chunk"), "idx", F.xxhash64(F.lit(3), "t1", "t2").alias("turn"),
                         *[F.xxhash64(F.lit(seed), "idx", "t1", "t2").alias(f"s{seed}") for seed in (1, 2)])
    # the state of a class at the end of each whole chunk: chunks of it are rows, not turns
    sums = coded.groupBy("class", "chunk").agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"),
                                               F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy("class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    state = sums.filter(F.col("rows") == p.chunk).select(
        "class", "chunk", F.bit_xor("s1").over(upto).alias("s1"), F.bit_xor("s2").over(upto).alias("s2"))
    state = cut_lineage(state)
    shared = state.groupBy("chunk", "s1", "s2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    same = [F.col(c) == F.col(f"k_{c}") for c in ("chunk", "s1", "s2")]
    shared = shared.select(*[F.col(c).alias(f"k_{c}") for c in ("chunk", "s1", "s2")])
    need = (state.join(shared, same, "left_semi").groupBy(F.col("class").alias("c"))
            .agg((F.max("chunk") + 1).alias("last")))
    wanted = (coded.join(need, F.col("class") == F.col("c"), "left")
              .filter(F.col("chunk") <= F.coalesce("last", F.lit(0))).select("class", "idx", "turn"))
    keys = wanted.groupBy(F.col("class").alias("c")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "turn"))), lambda x: x["turn"]).alias("key"))
    none = F.array().cast("array<bigint>")
    return each.join(keys, F.col("class") == F.col("c"), "left").select("class", "size", "n", F.coalesce("key", none).alias("key"))


def _common(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each list and the one before it (0 for the first)."""
    size = np.diff(first)
    least = np.minimum(size[1:], size[:-1])
    stop = np.cumsum(least)
    step = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - least, least)
    differ = flat[np.repeat(first[:-2], least) + step] != flat[np.repeat(first[1:-1], least) + step]
    at = np.append(np.flatnonzero(differ), len(differ))
    stands = at[np.searchsorted(at, stop - least)]  # first place from its start on that differs
    return np.concatenate([[0], np.minimum(stands - (stop - least), least)])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted rows of a part and adds the LCP with the row before (null for the
    first). The first and the last row of the part keep their key."""
    last, row = None, 0
    held: pa.RecordBatch | None = None

    def out(batch: pa.RecordBatch, lcp: np.ndarray, begin: int, first: bool, end: bool) -> pa.RecordBatch:
        edge = np.zeros(batch.num_rows, bool)
        edge[0] |= first
        edge[-1] |= end
        key = batch.column("key").take(pa.array(np.arange(batch.num_rows), mask=~edge))
        none = np.zeros(batch.num_rows, bool)
        none[0] = first
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("part", "class", "size", "n")]
            + [pa.array(np.arange(begin, begin + batch.num_rows)), pa.array(lcp, mask=none), key],
            ["part", "class", "size", "n", "row", "lcp", "key"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("key")
        flat, first = np.asarray(lists.flatten()), np.asarray(lists.offsets).astype(np.int64)
        first = first - first[0]
        if last is not None:
            flat, first = np.concatenate([last, flat]), np.concatenate([[0], first + len(last)])
            lcp = _common(flat, first)[1:]
        else:
            lcp = _common(flat, first)
        if held is not None:
            yield out(held, held_lcp, row, row == 0, False)
            row += held.num_rows
        held, held_lcp = batch, lcp
        last = flat[first[-2]:first[-1]].copy()
    if held is not None:
        yield out(held, held_lcp, row, row == 0, True)


_SORTED = "part int, class bigint, size bigint, n bigint, row bigint, lcp bigint, key array<bigint>"


def places(keys: DataFrame, p: TrieParams) -> tuple[DataFrame, int]:
    """Classes in sorted order: place, class, size, n, lcp (-1 at place 0), block. And the
    number of places in a block."""
    ranged = (keys.repartitionByRange("key", "class").sortWithinPartitions("key", "class")
              .select(F.spark_partition_id().alias("part"), "class", "size", "n", "key"))
    rows = cut_lineage(ranged.mapInArrow(_neighbours, _SORTED))
    held = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # a row for each range of the sort
    total = held.agg(F.sum("rows")).first()[0] or 0
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.select(F.col("part").alias("at"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    # LCPs across the borders of the ranges: two rows of each range, compared in one task
    edges = (rows.filter("key IS NOT NULL").select("part", "class", "size", "n", "row", "key")
             .coalesce(1).sortWithinPartitions("part", "row").drop("row"))
    border = (edges.mapInArrow(_neighbours, _SORTED).groupBy(F.col("part").alias("at"))
              .agg(F.min_by(F.coalesce("lcp", F.lit(-1)), "row").alias("border")))
    block = max(p.block, -(-total // p.max_blocks))
    offset = cut_lineage(offset.join(border, "at"))
    place = F.col("row") + F.col("before")
    return cut_lineage(rows.join(offset, F.col("part") == F.col("at")).select(
        place.alias("place"), "class", "size", "n", F.coalesce("lcp", "border").alias("lcp"),
        F.floor(place / block).cast("long").alias("block"))), block


class Minima:
    """Sparse table of range minima: level k holds the minima of 2^k values in a row."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 1 << len(self.levels) <= len(values):
            before, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(before[:-half], before[half:]))
        self.n = len(values)

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Largest r such that all values behind ``at`` up to r are ``least`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at + 1 < len(level)
            go = np.zeros(len(at), bool)
            go[fits] = level[at[fits] + 1] >= least[fits]
            at[go] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest l such that all values from behind l up to ``at`` are ``least`` or more;
        -1 if the value at 0 is too."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            low = at - (1 << k) + 1
            fits = low >= 0
            go = np.zeros(len(at), bool)
            go[fits] = self.levels[k][low[fits]] >= least[fits]
            at[go] -= 1 << k
        return at

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of the values lo..hi (lo <= hi)."""
        k = np.log2(hi - lo + 1).astype(np.int64)
        out = np.empty(len(lo), np.int64)
        for step in np.unique(k):
            some = k == step
            level = self.levels[step]
            out[some] = np.minimum(level[lo[some]], level[hi[some] - (1 << step) + 1])
        return out


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


_EXTENT = "kind string, block bigint, place bigint, depth bigint, bound bigint, least bigint"


def _extents(table: pa.Table) -> pa.Table:
    """Extents of the candidate prefixes of one block, as far as the block tells.

    kind ``right``: (place, depth) is a node shared by several classes, bound is its last
    place here, or null if it goes on behind the block; least is its smallest conv_id here.
    kind ``left``: the prefix of ``lcp`` turns at a place begins at bound, or before the block
    (null). kind ``block``: least LCP (bound) and least conv_id of the block.
    """
    order = np.argsort(table.column("place").to_numpy())
    block, place, lcp, after, conv = (c[order] for c in _columns(table, "block", "place", "lcp", "after", "class"))
    start, n = int(place[0]), len(place)
    minima, convs = Minima(lcp), Minima(conv)
    # to the right: depths that a place shares with the next one but not with the one before
    shared = np.maximum(after - lcp, 0)
    at = np.repeat(np.arange(n), shared)
    depth = np.repeat(lcp, shared) + 1 + np.arange(shared.sum()) - np.repeat(np.cumsum(shared) - shared, shared)
    right = minima.right(at, depth)
    ends = (right < n - 1) | (after[-1] < depth)
    # to the left: the prefix that a place shares with the one before
    spot = np.flatnonzero(lcp >= 0)
    left = minima.left(spot, lcp[spot])
    rows = [("right", place[at], depth, np.where(ends, right + start, -1), convs.least(at, right)),
            ("left", place[spot], lcp[spot], np.where(left >= 0, left + start, -1), np.zeros(len(spot), np.int64)),
            ("block", place[:1], lcp[:1], np.array([lcp.min()]), np.array([conv.min()]))]
    made = [pa.table({"kind": pa.array([kind] * len(a), pa.string()), "block": pa.array(np.full(len(a), block[0]), pa.int64()),
                      "place": pa.array(a, pa.int64()), "depth": pa.array(d, pa.int64()),
                      "bound": pa.array(b, pa.int64(), mask=(b < 0) & (kind != "block")), "least": pa.array(m, pa.int64())})
            for kind, a, d, b, m in rows]
    return pa.concat_tables(made)


def _over(shared, which: str):
    """Finds the block in which a prefix ends that goes over the border of a block, and the
    least conv_id of the whole blocks between."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima, convs = shared.value
        for batch in batches:
            block, depth = (batch.column(c).to_numpy() for c in ("block", "depth"))
            least = np.full(len(block), np.iinfo(np.int64).max)
            if which == "right":
                to = minima.right(block, depth) + 1  # the first block with a smaller LCP
                between = to - block > 1
                least[between] = convs.least(block[between] + 1, to[between] - 1)
            else:
                to = minima.left(block - 1, depth)  # the prefix begins in this one
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("depth"), pa.array(to), pa.array(least)],
                                             ["block", "depth", "to", "least"])
    return run


def _resolve(key: tuple, queries: pa.Table, table: pa.Table) -> pa.Table:
    """Ends, in one block, of prefixes that come from its left (right ends) or right (left
    ends): side, block, depth, bound and the least conv_id of what belongs to them."""
    if not queries.num_rows:
        return queries.select(["side", "block", "depth"]).append_column("bound", queries.column("depth")).append_column(
            "least", queries.column("least"))
    side, block, depth, to_least = _columns(queries, "side", "block", "depth", "least")
    order = np.argsort(table.column("place").to_numpy())
    place, lcp, conv = (c[order] for c in _columns(table, "place", "lcp", "class"))
    start, n = int(place[0]), len(place)
    minima, convs = Minima(lcp), Minima(conv)
    rightward = side == "right"
    bound = np.empty(len(side), np.int64)
    # the run from the block's first place on; it is empty if that one's LCP is too small
    open_ = lcp[0] >= depth[rightward]
    end = np.where(open_, minima.right(np.zeros(int(rightward.sum()), np.int64), depth[rightward]), -1)
    bound[rightward] = end + start
    bound[~rightward] = minima.left(np.full(int((~rightward).sum()), n - 1), depth[~rightward]) + start
    least = to_least.copy()
    some = np.flatnonzero(rightward)[end >= 0]
    least[some] = np.minimum(least[some], convs.least(np.zeros(len(some), np.int64), end[end >= 0]))
    return pa.table({"side": pa.array(side, pa.string()), "block": pa.array(block, pa.int64()),
                     "depth": pa.array(depth, pa.int64()), "bound": pa.array(bound, pa.int64()), "least": pa.array(least, pa.int64())})


def extents(ordered: DataFrame, p: TrieParams) -> tuple[DataFrame, DataFrame]:
    """Shared nodes (place, depth, last, least) of two and more classes, least being the
    smallest conv_id; and parents (place, depth, first): the node (first, depth) is the parent
    of the first new node of a place."""
    spark = ordered.sparkSession
    after = ordered.select((F.col("place") - 1).alias("at"), F.col("lcp").alias("after"))
    rows = cut_lineage(ordered.join(after, F.col("place") == F.col("at"), "left").select(
        "block", "place", "lcp", F.coalesce("after", F.lit(-1)).alias("after"), "class"))
    found = cut_lineage(rows.groupBy("block").applyInArrow(_extents, _EXTENT))
    each = found.filter("kind = 'block'").orderBy("block").select("bound", "least").toArrow()  # max_blocks rows at most
    least_lcp, least_conv = _columns(each, "bound", "least")
    shared = spark.sparkContext.broadcast((Minima(least_lcp), Minima(least_conv)))
    sides = []
    for side in ("right", "left"):
        asked = found.filter((F.col("kind") == side) & F.col("bound").isNull()).select("block", "depth").distinct()
        went = asked.mapInArrow(_over(shared, side), "block bigint, depth bigint, to bigint, least bigint")
        sides.append(went.withColumn("side", F.lit(side)))
    queries = cut_lineage(sides[0].unionByName(sides[1]))
    blocks = rows.select(F.col("block").alias("to"), "place", "lcp", "class")
    # a prefix that goes on behind the last block ends at the last place
    total = int(ordered.agg(F.max("place")).first()[0])
    inside = queries.filter(F.col("to") < len(least_lcp))
    past = queries.filter(F.col("to") >= len(least_lcp)).select(
        "side", "block", "depth", F.lit(total).cast("long").alias("bound"), "least")
    solved = inside.groupBy("to").cogroup(blocks.groupBy("to")).applyInArrow(
        _resolve, "side string, block bigint, depth bigint, bound bigint, least bigint")
    solved = cut_lineage(solved.unionByName(past)).select(
        F.col("side").alias("s"), F.col("block").alias("b"), F.col("depth").alias("d"), F.col("bound").alias("over"),
        F.col("least").alias("over_least"))
    met = found.filter("kind <> 'block'").join(
        solved, (F.col("kind") == F.col("s")) & (F.col("block") == F.col("b")) & (F.col("depth") == F.col("d"))
        & F.col("bound").isNull(), "left")
    met = cut_lineage(met.select("kind", "place", "depth", F.coalesce("bound", "over").alias("bound"),
                                 F.least("least", "over_least").alias("least")))
    return (met.filter("kind = 'right'").select("place", "depth", F.col("bound").alias("last"), "least"),
            met.filter("kind = 'left'").select("place", "depth", F.col("bound").alias("first")))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each class, which come in order; one piece at a
    time is held."""
    own, made = None, None
    for batch in batches:
        done, hashes = [], []
        for c, text in zip(batch.column("class").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if c != own:
                if made is not None:
                    done.append(own)
                    hashes.append(made.hexdigest())
                own, made = c, hashlib.sha256(text.encode())
            else:
                made.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array(hashes, pa.string())], ["class", "hash"])
    if made is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([made.hexdigest()])], ["class", "hash"])


def end_hashes(members: DataFrame, p: TrieParams) -> DataFrame:
    """class and hash: SHA-256 of the members' conv_ids, in order and comma-joined. Pieces of
    ``ids`` consecutive numbers are joined apart, so that the last step has few rows."""
    # a whole number of pieces, rounded towards 0
    piece = members.groupBy("class", F.expr(f"conv_id div {p.ids}").alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("text"))
    return piece.repartition("class").sortWithinPartitions("class", "piece").mapInArrow(_hash_lists, "class bigint, hash string")


def trie(conversations: DataFrame, params: TrieParams | None = None) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    p = params or TrieParams()
    turns, convs = rebuilt(coded_turns(conversations), p)
    turns = cut_lineage(turns)
    members, each, own_turns = classes(turns, convs, p)
    ordered, _ = places(sort_keys(each, own_turns, p), p)
    if ordered.isEmpty():
        return conversations.sparkSession.createDataFrame([], _NODE)
    shared, parents = extents(ordered, p)
    # running numbers of members and of leaves: a class is a leaf if the next one does not go on from it
    follows = ordered.select((F.col("place") - 1).alias("at"), F.col("lcp").alias("after"))
    leaf = (F.coalesce("after", F.lit(-1)) < F.col("size")).cast("long")
    one = ordered.join(follows, F.col("place") == F.col("at"), "left").select(
        "place", "class", "size", "n", "lcp", leaf.alias("leaf"), F.lit(0).alias("all"))
    sums = numbered(one, "all", ["place"], "same_place", {"n_upto": F.col("n"), "leaves_upto": F.col("leaf")})
    # nodes: the root and every turn that is no part of the class before
    own = own_turns.join(sums.select(F.col("class").alias("c"), "place", "lcp"), F.col("class") == F.col("c")).filter(
        F.col("idx") >= F.col("lcp")).select("place", (F.col("idx") + 1).alias("depth"), "words")
    root = sums.filter("place = 0").select("place", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"))
    spans = shared.select(F.col("place").alias("sp"), F.col("depth").alias("sd"), "last", "least")
    nodes = own.unionByName(root).join(spans, (F.col("place") == F.col("sp")) & (F.col("depth") == F.col("sd")), "left").select(
        "place", "depth", "words", F.coalesce("last", "place").alias("last"), "least")
    begin = sums.select(F.col("place").alias("bp"), F.col("class"), "size", F.col("lcp").alias("begin_lcp"),
                        (F.col("n_upto") - F.col("n")).alias("n_before"), (F.col("leaves_upto") - F.col("leaf")).alias("leaves_before"))
    end = sums.select(F.col("place").alias("ep"), F.col("n_upto").alias("n_end"), F.col("leaves_upto").alias("leaves_end"))
    nodes = cut_lineage(nodes.join(begin, F.col("place") == F.col("bp")).join(end, F.col("last") == F.col("ep")).select(
        "place", "depth", "last", "size", "begin_lcp", "class", F.coalesce("least", "class").alias("conv_id"),
        (F.col("n_end") - F.col("n_before")).alias("n_convs"), (F.col("leaves_end") - F.col("leaves_before")).alias("n_leaves"),
        ((F.col("n_end") - F.col("n_before") - 1) * F.col("words")).alias("saved")))
    # what a node's subtree saves: the rest of its own place from its depth on, and all places up to its last
    below = numbered(nodes.select("*", (-F.col("depth")).alias("up")), "place", ["up"], "from_end", {"saved_below": F.col("saved")})
    per_place = nodes.groupBy(F.col("place")).agg(F.sum("saved").alias("saved")).withColumn("all", F.lit(0))
    saved = numbered(per_place, "all", ["place"], "same_place", {"saved_upto": F.col("saved")}).select(
        F.col("place").alias("p2"), "saved_upto")
    start = saved.select(F.col("p2").alias("p1"), F.col("saved_upto").alias("saved_start"))
    # places without nodes do not occur: each class has one that the class before has not
    below = below.join(start, F.col("place") == F.col("p1")).join(saved, F.col("last") == F.col("p2"))
    saved_tokens = F.col("saved_below") + F.col("saved_upto") - F.col("saved_start")
    # children: the next turn of the same place, and the places that part from the node
    branches = parents.groupBy(F.col("first").alias("f"), F.col("depth").alias("fd")).agg(F.count(F.lit(1)).alias("branches"))
    full = below.join(branches, (F.col("place") == F.col("f")) & (F.col("depth") == F.col("fd")), "left").select(
        "place", "depth", "begin_lcp", "conv_id", "n_convs", "n_leaves", saved_tokens.alias("saved_tokens"),
        ((F.col("depth") < F.col("size")).cast("long") + F.coalesce("branches", F.lit(0))).alias("n_children"),
        F.when(F.col("depth") == F.col("size"), F.col("class")).alias("ends"))
    full = cut_lineage(full)
    # the parent is the node above at the same place, or that of the prefix shared with the place before
    at_left = parents.select(F.col("place").alias("pp"), F.col("first"))
    chain = full.select(F.col("place"), F.col("depth"), (F.col("depth") - 1).alias("above"), "begin_lcp")
    chain = chain.join(at_left, (F.col("place") == F.col("pp")) & (F.col("above") == F.col("begin_lcp")), "left").select(
        F.col("place").alias("np"), F.col("depth").alias("nd"), "above", F.coalesce("first", "place").alias("home"))
    named = full.select(F.col("place").alias("hp"), F.col("depth").alias("hd"), F.col("conv_id").alias("parent_conv_id"))
    chain = chain.join(named, (F.col("home") == F.col("hp")) & (F.col("above") == F.col("hd"))).select("np", "nd", "parent_conv_id")
    hashes = end_hashes(members, p).select(F.col("class").alias("hc"), "hash")
    out = full.join(chain, (F.col("place") == F.col("np")) & (F.col("depth") == F.col("nd")), "left").join(
        hashes, F.col("ends") == F.col("hc"), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("hash", F.lit(empty)).alias("ends_sha256"))


_NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, ends_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op11: prefix trie of all rebuilt conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same by grouping all prefixes of all conversations.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS idx
  FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 of the decimal conv_id: a bit at a time, 8 for each digit
digits AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
crc AS (
  WITH RECURSIVE step(conv_id, s, k, c) AS (
    SELECT conv_id, s, 0, CAST(4294967295 AS BIGINT) FROM digits
    UNION ALL
    SELECT conv_id, s, k + 1,
           CASE WHEN (b & 1) = 1 THEN xor(b >> 1, CAST(3988292384 AS BIGINT)) ELSE b >> 1 END
    FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE c END AS b
          FROM step WHERE k < 8 * length(s)))
  SELECT conv_id, xor(c, CAST(4294967295 AS BIGINT)) % 4 AS h FROM step WHERE k = 8 * length(s)),
r AS (
  SELECT c.conv_id, t.idx, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.idx < c.h
  UNION ALL
  SELECT c.conv_id, t.idx - c.h + 1000000, t.role, t.text FROM crc c JOIN t ON t.conv_id = c.conv_id AND t.idx >= c.h),
seq AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS depth, text,
         length(role) || '|' || role || '|' || length(text) || '|' || text AS code
  FROM r),
pre AS (
  SELECT conv_id, depth, text, sha256(string_agg(code, '/') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM seq
  UNION ALL SELECT conv_id, 0, '', '' FROM crc),
size AS (SELECT conv_id, max(depth) AS size FROM pre GROUP BY conv_id),
up AS (
  SELECT p.*, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM pre p),
node AS (
  SELECT node, up.depth, any_value(parent) AS parent, min(up.conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS saved,
         coalesce(string_agg(CASE WHEN size = up.depth THEN CAST(up.conv_id AS VARCHAR) END, ',' ORDER BY up.conv_id), '') AS ends
  FROM up JOIN size USING (conv_id) GROUP BY node, up.depth),
child AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
top AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN child c ON c.parent = n.node AND c.depth = n.depth),
-- each node and those above it, by one conversation that goes through it
anc AS (
  SELECT t.node AS below, t.depth AS below_depth, a.node, a.depth, t.saved, t.n_children
  FROM top t JOIN pre a ON a.conv_id = t.conv_id AND a.depth <= t.depth),
sub AS (
  SELECT node, depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM anc GROUP BY 1, 2)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM top t JOIN sub s ON s.node = t.node AND s.depth = t.depth
LEFT JOIN top p ON p.node = t.parent AND p.depth = t.depth - 1
"""
