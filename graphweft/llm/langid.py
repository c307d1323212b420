"""Language identification (operator 1).

A document's vector is the average of the embeddings of its hashed subwords (byte n-grams
of lower-cased text in which every byte that no letter uses is a blank); a linear softmax
on it gives the language. Embeddings and softmax are trained by stochastic gradient descent
in numpy on a bounded number of labelled documents for each language. The confidence is
calibrated by a temperature on labelled documents that the descent has not seen, and
documents whose calibrated confidence stays under a threshold from the same documents are
rejected.

Scoring is linear in the subwords, so tasks carry only (buckets x languages) figures.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected; one
that is too short for any subword gets the language with the largest bias; without any labelled row every text is ``und``. Repeated rows get equal results; ties
between languages go to the first in code point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm import words as W
from graphweft.llm.bitmaps import columns, split
from graphweft.session import cut_lineage, text_batches


@dataclass(frozen=True)
class LangIdParams:
    """``train_per_lang`` bounds the labelled documents that the fit sees for each language;
    every language that occurs is learnt, and scoring covers every row."""

    bits: int = 15
    dim: int = 16
    ngrams: tuple[int, ...] = (2, 3, 4)
    train_per_lang: int = 700
    epochs: int = 6
    rate: float = 4.0
    seed: int = 11
    false_reject: float = 0.001
    max_threshold: float = 0.6


_LETTER = np.array([0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
#: lower-cased letters as they are, everything else a blank
_CLEAN = np.where(_LETTER[W.LOWER], W.LOWER, 0x20).astype(np.uint8)
#: a letter in the sense of Unicode; the byte classes above are only features
_HAS_LETTER = r"\p{L}"


def _subwords(piece: W.Slice, p: LangIdParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: bucket of every n-gram that has a letter, and how many each row has."""
    data = _CLEAN[piece.data].astype(np.uint32)
    ends = piece.offsets
    row_end = np.repeat(ends[1:], np.diff(ends))
    gram = data.copy()
    blank = data == 0x20
    some = ~blank
    for n in range(1, max(p.ngrams) + 1):
        if n > 1:
            if len(gram) < 2:
                return
            gram = gram[:-1] * np.uint32(257) + data[n - 1:]
            some = some[:-1] | ~blank[n - 1:]
        if n in p.ngrams:
            ok = some & (np.arange(n, n + len(gram)) <= row_end[:len(gram)])
            at = np.flatnonzero(ok)
            ids = ((gram[at] + np.uint32(n * 7919)) * np.uint32(2654435761)) >> np.uint32(32 - p.bits)
            yield ids, np.diff(np.searchsorted(at, ends))


def _document_features(p: LangIdParams, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_out, val_out = [], []
            for piece in W.slices(batch.column("text")):
                parts = [(i, np.repeat(np.arange(piece.n_rows), k)) for i, k in _subwords(piece, p)]
                ids = np.concatenate([x[0] for x in parts]) if parts else np.zeros(0, np.uint32)
                rows = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, np.int64)
                key, n = np.unique(rows.astype(np.int64) << 32 | ids, return_counts=True)
                cut = np.searchsorted(key >> 32, np.arange(piece.n_rows + 1))
                for r in range(piece.n_rows):
                    k = n[cut[r]:cut[r + 1]]
                    ids_out.append((key[cut[r]:cut[r + 1]] & 0xFFFFFFFF).astype(np.int32))
                    val_out.append((k / max(1, k.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(ids_out, pa.list_(pa.int32())), pa.array(val_out, pa.list_(pa.float32()))],
                [*columns, "ids", "vals"])
    return run


def in_fold(doc_id: Column, fold: int, of: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder (a null id: it doesn't)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == fold, F.lit(False))


def draw(doc_id: Column, salt: str) -> Column:
    """Uniform number in [0, 1) from the id alone, the same on every run."""
    h = F.xxhash64(F.lit(salt), doc_id.cast("string"))
    return F.pmod(h, F.lit(1 << 30)) / float(1 << 30)


@dataclass
class LangIdModel:
    """Logits of each hashed subword, its language names and the calibration."""

    params: LangIdParams
    langs: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def _descend(docs: list[tuple[int, np.ndarray, np.ndarray]], n_langs: int, p: LangIdParams):
    rng = np.random.default_rng(p.seed)
    emb = rng.uniform(-1 / p.dim, 1 / p.dim, (1 << p.bits, p.dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (p.dim, n_langs)).astype(np.float32)
    bias = np.zeros(n_langs, np.float32)
    steps, done = p.epochs * len(docs), 0
    for _ in range(p.epochs):
        for k in rng.permutation(len(docs)):
            y, ids, vals = docs[k]
            rate = np.float32(p.rate * (1 - done / steps))
            done += 1
            x = vals @ emb[ids]
            err = _softmax(x @ out + bias)
            err[y] -= 1
            back = out @ err
            out -= rate * np.outer(x, err)
            bias -= np.float32(0.05) * rate * err
            emb[ids] -= np.outer(vals * (rate * np.float32(20)), back)
    return emb @ out, bias


def fit(documents: DataFrame, params: LangIdParams | None = None, text: str = "text",
        label: str = "lang", doc_id: str = "doc_id") -> LangIdModel:
    """Fit on labelled ``documents`` (rows with a null label are left out).

    Counts of labels are aggregated over all rows; the documents that the descent sees are
    drawn by a hash of their id, ``train_per_lang`` for each language.
    """
    p = params or LangIdParams()
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(label).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull())
    counts = (rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect())  # a row for each language
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return LangIdModel(p, [], np.zeros((1 << p.bits, 0), np.float32), np.zeros(0), 1.0, 0.0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, p.train_per_lang / r["count"]))])
    picked = rows.filter(draw(F.col("id"), "langid") < share[F.col("lang")]).limit(2 * p.train_per_lang * len(langs))
    picked = picked.select("lang", draw(F.col("id"), "calibrate").alias("u"), "text")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("u", T.DoubleType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("vals", T.ArrayType(T.FloatType()))])
    got = picked.mapInArrow(_document_features(p, ["lang", "u"]), schema).toArrow()
    at = {x: k for k, x in enumerate(langs)}
    found = [(u, at[x], np.asarray(i.values), np.asarray(v.values)) for x, u, i, v in
             zip(got["lang"].to_pylist(), got["u"].to_pylist(), got["ids"], got["vals"], strict=True)]
    found = sorted((f for f in found if len(f[2])), key=lambda f: (f[0], f[1], len(f[2]), float(f[3][0])))
    train = [f[1:] for f in found if f[0] >= 0.2] or [f[1:] for f in found]
    held = [f[1:] for f in found if f[0] < 0.2] or train
    if not train:
        return LangIdModel(p, [], np.zeros((1 << p.bits, 0), np.float32), np.zeros(0), 1.0, 0.0)
    table, bias = _descend(train, len(langs), p)
    logits = np.array([v @ table[i] + bias for _, i, v in held], dtype=np.float64)
    truth = np.array([y for y, _, _ in held])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = _softmax(logits / temperature).max(axis=1)
    threshold = min(p.max_threshold, float(np.quantile(sure, p.false_reject)))
    return LangIdModel(p, langs, table.astype(np.float32), bias.astype(np.float64), temperature, threshold)


def _scorer(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LangIdModel = shared.value
        n_langs = len(m.langs)
        for batch in batches:
            n = batch.num_rows
            text = batch.column("__text")
            sums, grams = np.zeros((n, n_langs)), np.zeros(n)
            for piece in W.slices(text) if n_langs else ():
                part = slice(piece.first_row, piece.first_row + piece.n_rows)
                for ids, count in _subwords(piece, m.params):
                    grams[part] += count
                    if len(ids):
                        full = np.flatnonzero(count)
                        begin = np.concatenate([[0], np.cumsum(count[full])[:-1]])
                        hit = m.table[ids]
                        sums[piece.first_row + full] += np.add.reduceat(hit, begin, axis=0, dtype=np.float64)
            ok = np.asarray(pc.fill_null(pc.match_substring_regex(text, _HAS_LETTER), False).to_numpy(zero_copy_only=False), bool)
            if n_langs:
                prob = _softmax((sums / np.maximum(grams, 1)[:, None] + m.bias) / m.temperature)
                best, score = prob.argmax(axis=1), np.where(ok, prob.max(axis=1), 0.0)
            else:
                best, score, ok = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
            names = np.array([*m.langs, "und"], dtype=object)
            pred = names[np.where(ok, best, n_langs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(pred, pa.string()), pa.array(score), pa.array(~ok | (score < m.threshold))],
                [*columns, "lang_pred", "score", "rejected"])
    return run


def predict(documents: DataFrame, model: LangIdModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Score every whole text: the columns ``keep`` (all by default, but for those of the
    result's names) plus ``lang_pred``, ``score`` and ``rejected``."""
    new = ["lang_pred", "score", "rejected"]
    keep = [c for c in (documents.columns if keep is None else keep) if c not in new]
    rows = documents.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([rows.schema[c] for c in keep] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scorer(shared, keep), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op1: languages of all documents, learnt outside fold 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~in_fold(F.col("doc_id"), 2, 4)))
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), 2, 4).alias("held_out"), "text")
    return predict(rows, model, keep=["doc_id", "held_out"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go, all others stay unchanged.

    Tasks send Python the texts alone, and only rows that a fixed-size filter of the rejected ids
    lets through are moved to meet them.
    """
    model = fit(docs)
    keyed = docs.select(F.xxhash64("text").alias("__hash"), *columns(docs))
    scored = predict(keyed, model, keep=["doc_id", "__hash"])
    with text_batches(spark):
        rejected = cut_lineage(scored.filter("rejected").select("doc_id", "__hash").distinct())
    rest, some = split(keyed, rejected, ["doc_id", "__hash"])
    gone = rejected.select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h"))
    some = some.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left_anti")
    return rest.unionByName(some).select(*columns(docs))
