"""Cross-tokenizer alignment of texts (operator 12).

Texts are shuffled by their full text, so that each distinct one is tokenised and aligned
once, however many copies there are. A is a byte-level BPE vocabulary and encodes a blank and
the text; B is a piece vocabulary, which adds the blank itself. Byte offsets at which a token
of A and one of B both end cut the two into groups, and link the two tokens. The corpus-wide
count of a pair of ids is the number of links that hold it, where each distinct text counts
with its number of copies. Measures of the distinct texts are joined to the doc_ids in the
end, by the SHA-256 of the text.

Counts of the most frequent pairs, 2^18 at most, travel with the tasks that sum them up; all
other pairs of a text are joined with their counts, so the result does not depend on that.

Defined results: texts that are null, empty, or that A's or B's tokens do not give back byte
for byte (after the blank) have no tokens: zeros and an empty ``groups_sha256``. Rows without
doc_id and repeated rows are rows of the result like all others, and count as copies. Ties
for the highest count of a B id all count as best. Other columns are not carried along. An
empty table gives no rows.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import vocab as V
from graphweft.llm import words as W
from graphweft.llm.token_counts import PreTokens
from graphweft.session import cut_lineage

#: an id pair as one number: a * PAIR + b
PAIR = 1 << 32
_MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@dataclass(frozen=True)
class AlignParams:
    """Tokenizers by path, or by name among the public ones. ``frequent`` pairs at most travel
    with the tasks; a task remembers the tokens of ``remembered`` pre-tokens at a time."""

    a: str = "byte_bpe_50k.json"
    b: str = "piece_bpe_32k.model"
    frequent: int = 1 << 18
    remembered: int = 1 << 18


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges that begin at ``begin`` and have ``size`` places."""
    stop = np.cumsum(size)
    return np.repeat(begin - stop + size, size) + np.arange(size.sum())


class Spelling:
    """Bytes of the tokens of a vocabulary, in one array."""

    def __init__(self, tokens: list[bytes | None]):
        self.size = V.lengths(tokens)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_gather(self.begin[ids], self.size[ids])]


class GroupText:
    """Writes groups as ``a1,a2|b1;a3|b2,b3`` with numpy: a row of digits for each token."""

    def __init__(self, n_ids: int):
        width = len(str(max(n_ids - 1, 1)))
        shown = np.char.ljust(np.arange(n_ids).astype(f"S{width}"), width)
        self.digits = np.zeros((n_ids, width + 1), np.uint8)
        self.digits[:, :width] = np.frombuffer(shown.tobytes(), np.uint8).reshape(n_ids, width)
        self.size = (self.digits > 0x20).sum(axis=1)

    def __call__(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups with a mark behind each token, and where each group begins (and the last
        ends); ``cut_a`` and ``cut_b`` are the indices of the tokens that end a group."""
        side = np.concatenate([2 * np.repeat(np.arange(len(cut_a)), np.diff(cut_a, prepend=-1)),
                               2 * np.repeat(np.arange(len(cut_b)), np.diff(cut_b, prepend=-1)) + 1])
        order = np.argsort(side, kind="stable")
        ids, side = np.concatenate([a, b])[order], side[order]
        out, size = self.digits[ids], self.size[ids]
        mark = np.full(len(ids), ord(","), np.uint8)
        ends = np.append(side[1:] != side[:-1], True)[:len(side)]
        mark[ends] = np.where(side[ends] % 2 == 0, ord("|"), ord(";"))
        out[np.arange(len(ids)), size] = mark
        upto = np.concatenate([[0], np.cumsum(size + 1)])
        begins = upto[np.searchsorted(side, 2 * np.arange(len(cut_a) + 1))]
        return out[np.arange(out.shape[1])[None] <= size[:, None]].tobytes(), begins


class ByteLevelIds:
    """Token ids of texts in a byte-level vocabulary. Pre-tokens are encoded one by one, so
    each different one is merged by the library once for as long as it is remembered."""

    def __init__(self, raw: bytes, remembered: int):
        library = V.byte_level_tokenizer(raw, special=False)
        self._cutter, self._merge, self._symbol = PreTokens(library), library.model.tokenize, V.byte_symbols()
        self._known: dict[int, bytes] = {}
        self._remembered = remembered

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[bytes]:
        """Ids of each pre-token as 32-bit numbers."""
        if len(self._known) > self._remembered:
            self._known.clear()
        known, keys = self._known, hashes.tolist()
        new = [k for k, h in enumerate(keys) if h not in known]
        raw = data.tobytes().decode("latin-1").translate(self._symbol)
        for k, i, j in zip(new, starts[new].tolist(), ends[new].tolist(), strict=True):
            known[keys[k]] = array.array("i", [t.id for t in self._merge(raw[i:j])]).tobytes()
        return [known[h] for h in keys]

    def __call__(self, piece: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and the number of tokens of each text."""
        starts, ends = self._cutter.cut(piece.data, piece.offsets)
        hashes = W.span_hashes(piece.data, starts, ends)
        each, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        ids = self._ids(piece.data, starts[first], ends[first], each)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), np.int32).astype(np.int64)
        every = flat[_gather((np.cumsum(size) - size)[back], size[back])]
        # tokens before each text: those of the pre-tokens that begin before it
        before = np.concatenate([[0], np.cumsum(size[back])])[np.searchsorted(starts, piece.offsets)]
        return every, np.diff(before)


class PieceIds:
    """The same for a piece vocabulary, of texts without their first byte, a blank."""

    def __init__(self, raw: bytes):
        self.library = V.piece_tokenizer(raw)

    def __call__(self, piece: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        raw, cuts = piece.data.tobytes(), piece.offsets.tolist()
        ids = self.library.encode([raw[i + 1:j].decode() for i, j in zip(cuts[:-1], cuts[1:], strict=True)],
                                  out_type=int, num_threads=1)
        size = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64, size.sum()), size


def _exact(piece: W.Slice, ids: np.ndarray, n: np.ndarray, spell: Spelling) -> np.ndarray:
    """Which texts of a slice their tokens give back byte for byte."""
    size = np.diff(piece.offsets)
    row = np.repeat(np.arange(piece.n_rows), n)
    same = np.bincount(row, spell.size[ids], piece.n_rows).astype(np.int64) == size
    got = spell(ids[same[row]])
    at = np.repeat(np.arange(piece.n_rows), size)
    inside = same[at]
    wrong = at[inside][got != piece.data[inside]]
    same[wrong] = False
    return same


def _aligner(raw_a: bytes, raw_b: bytes, p: AlignParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        enc_a, enc_b = ByteLevelIds(raw_a, p.remembered), PieceIds(raw_b)
        spell_a, spell_b = Spelling(V.byte_level_tokens(raw_a)), Spelling(V.piece_tokens(enc_b.library))
        show = GroupText(max(len(spell_a.size), len(spell_b.size)))

        def align(piece: W.Slice) -> list[pa.Array]:
            (a, n_a), (b, n_b) = enc_a(piece), enc_b(piece)
            good = _exact(piece, a, n_a, spell_a) & _exact(piece, b, n_b, spell_b) & (np.diff(piece.offsets) > 1)
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
            # both spell the same bytes, text after text, so ends are places in these bytes
            _, at_a, at_b = np.intersect1d(np.cumsum(spell_a.size[a]), np.cumsum(spell_b.size[b]), True, True)
            row = np.repeat(np.arange(piece.n_rows), n_a)[at_a]
            groups = np.bincount(row, minlength=piece.n_rows)
            text, begins = show(a, b, at_a, at_b)
            cuts = begins[np.concatenate([[0], np.cumsum(groups)])].tolist()
            shown = [hashlib.sha256(text[lo:hi - 1]).hexdigest() if hi > lo else ""
                     for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            pair = a[at_a] * PAIR + b[at_b]
            order = np.lexsort((pair, row))
            pair, row = pair[order], row[order]
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            off = pa.array(np.searchsorted(row[first], np.arange(piece.n_rows + 1)).astype(np.int32), pa.int32())
            times = np.diff(np.append(first, len(pair))).astype(np.int32)
            return [pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(groups), pa.array(shown, pa.string()),
                    pa.ListArray.from_arrays(off, pa.array(pair[first])), pa.ListArray.from_arrays(off, pa.array(times))]

        for batch in batches:
            for piece in W.slices(batch.column("blank_text")):
                kept = [batch.column(c).slice(piece.first_row, piece.n_rows) for c in ("code", "copies")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *align(piece)],
                    ["code", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
    return run


_ALIGNED = ("code binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
            "groups_sha256 string, pairs array<bigint>, times array<int>")


def aligned_texts(documents: DataFrame, text: str = "text", params: AlignParams | None = None) -> DataFrame:
    """Each distinct text once: code (SHA-256), copies, n_a, n_b, n_groups, n_links,
    groups_sha256, and its linked id pairs with their numbers of links."""
    p = params or AlignParams()
    texts = documents.select(F.col(f"`{text}`").alias("text")).filter("text <> ''")
    distinct = texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    coded = distinct.select(F.concat(F.lit(" "), "text").alias("blank_text"), "copies", F.unhex(F.sha2("text", 256)).alias("code"))
    return coded.mapInArrow(_aligner(V.read(p.a), V.read(p.b), p), _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (links that hold the pair in all documents) and best (no other pair of its B id
    has more)."""
    each = aligned.select("copies", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    n = (each.groupBy(F.col("x.pairs").alias("pair"))
         .agg(F.sum(F.col("copies") * F.col("x.times")).alias("n")))
    n = cut_lineage(n.withColumn("b", F.col("pair") % PAIR))
    top = n.groupBy(F.col("b").alias("of")).agg(F.max("n").alias("most"))  # a row for each B id at most
    return n.join(top, F.col("b") == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, limit: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A count from which on no more than ``limit`` pairs have it, and these pairs in order,
    their counts and whether they are best. The counts are told apart by a histogram."""
    step = F.floor(F.log2("n") * 16)
    found = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).collect()
    least, room = np.iinfo(np.int64).max, limit
    for r in sorted(found, key=lambda r: -r["step"]):
        room -= r["pairs"]
        if room < 0:
            break
        least = r["least"]
    rows = counts.filter(F.col("n") >= F.lit(int(least))).toArrow().combine_chunks()
    pair = rows.column("pair").to_numpy()
    order = np.argsort(pair)
    return least, pair[order], rows.column("n").to_numpy()[order], rows.column("best").to_numpy()[order]


def _summer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            lists, n = batch.column("pairs"), batch.num_rows
            flat, times = np.asarray(lists.flatten()), np.asarray(batch.column("times").flatten()).astype(np.int64)
            row = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, row[hit], times[hit] * count[at[hit]])
            np.add.at(n_best, row[hit], times[hit] * best[at[hit]])
            off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=n))]).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("code"), pa.array(n_best), pa.array(total), pa.ListArray.from_arrays(off, pa.array(flat[~hit])),
                 pa.ListArray.from_arrays(off, pa.array(times[~hit]))], ["code", "n_best", "count_sum", "pairs", "times"])
    return run


def align(documents: DataFrame, text: str = "text", params: AlignParams | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of
    ``documents``."""
    p = params or AlignParams()
    aligned = cut_lineage(aligned_texts(documents, text, p))
    counts = cut_lineage(pair_counts(aligned))
    least, *head = _frequent(counts, p.frequent)
    shared = documents.sparkSession.sparkContext.broadcast(head)
    sums = cut_lineage(aligned.select("code", "pairs", "times").mapInArrow(
        _summer(shared), "code binary, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"))
    rest = sums.select("code", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "code", F.col("x.pairs").alias("of"), F.col("x.times").alias("t"))
    rare = counts.filter(F.col("n") < F.lit(int(least)))
    more = (rest.join(rare, F.col("of") == F.col("pair"))
            .select("code", (F.col("t") * F.col("best").cast("long")).alias("n_best"), (F.col("t") * F.col("n")).alias("count_sum")))
    both = sums.select("code", "n_best", "count_sum").unionByName(more)
    total = both.groupBy(F.col("code").alias("c")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    measures = cut_lineage(aligned.drop("pairs", "times").join(total, F.col("code") == F.col("c")).drop("c", "copies"))
    docs = documents.select("doc_id", F.unhex(F.sha2(F.col(f"`{text}`"), 256)).alias("own"))
    joined = docs.join(measures, F.col("own") == F.col("code"), "left")
    return joined.select("doc_id", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in _MEASURES],
                         F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op12: alignment of all documents."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
