"""Toxicity by a factorization machine over hashed terms (operator 2).

Terms of a text are its lower-cased words and their first 4, 5 and 6 bytes, each present
or absent, known by 64-bit hashes. The score is the logistic of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

so that a pair of terms, such as an insult next to a group's name, can weigh what neither
weighs alone. Weights are fitted by AdaGrad in numpy on a bounded number of labelled
documents of each class. A term enters the model if it tells the classes apart, or if one of
its pairs does: two words at most ``window`` words apart that are together in texts of one
class, however little each tells alone. Both are judged by the likelihood ratio (G) of the
classes against their shares in the sample, whose bar means the same at any class balance, so
that the many other terms of a long text add no noise. Terms and pairs are counted on Spark.
The cut of the score is placed on logits of documents by models that have not seen them.
Scoring covers the whole of every text.

Defined results: a null or empty text has no terms and gets the logistic of the intercept;
without labelled rows of both classes every score is the share of toxic labels (0 without
any). Labels other than 0 and 1, and null ones, are left out. Repeated rows score alike; a
score equal to the threshold is predicted 1, and of cuts that part documents equally well the
lowest is taken. Columns with names of the result are left out of ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm import words as W
from graphweft.llm.langid import draw, in_fold
from graphweft.session import cut_lineage, release


@dataclass(frozen=True)
class ToxicityParams:
    """``train_per_class`` bounds the labelled documents of each class that the fit sees."""

    train_per_class: int = 1500
    prefixes: tuple[int, ...] = (4, 5, 6)
    window: int = 8
    min_documents: int = 4
    term_bar: float = 16.0
    pair_bar: float = 40.0
    folds: int = 5
    factors: int = 6
    epochs: int = 20
    rate: float = 0.15
    l2: float = 1e-4
    least_bias: float = -2.0
    seed: int = 5
    threshold: float = 0.3


@dataclass
class ToxicityModel:
    """Selected term hashes (sorted), their weights and factors, and the intercept."""

    params: ToxicityParams
    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float
    filter: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True


def _terms(piece: W.Slice, p: ToxicityParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of words and of word prefixes with the row of each, in order of the text."""
    data = W.LOWER[piece.data]
    starts, ends = W.spans(data, piece.offsets, W.ALNUM)
    rows = np.searchsorted(piece.offsets, starts, side="right") - 1
    yield W.span_hashes(data, starts, ends), rows
    for n in p.prefixes:
        longer = ends - starts > n
        at = starts[longer]
        h = W.span_hashes(data, at, at + n)
        yield h ^ np.uint64(0xA5A5A5A500000000 + n), rows[longer]


def _near_pairs(hashes: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a < b) of different words less than ``window`` words apart, and their row."""
    found = []
    for d in range(1, window):
        same = (rows[:-d] == rows[d:]) & (hashes[:-d] != hashes[d:])
        x, y = hashes[:-d][same], hashes[d:][same]
        found.append((rows[:-d][same], np.minimum(x, y), np.maximum(x, y)))
    row, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((b, a, row))
    row, a, b = row[order], a[order], b[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return row[new], a[new], b[new]


def _document_terms(p: ToxicityParams):
    def lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
        off = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.slices(pc.utf8_lower(batch.column("text"))):
                parts = list(_terms(piece, p))
                key = np.unique(np.stack([np.concatenate([x[1] for x in parts]).astype(np.uint64),
                                          np.concatenate([x[0] for x in parts])]), axis=1)
                row, a, b = _near_pairs(*parts[0], p.window)
                n = piece.n_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(piece.first_row, n), lists(key[1], key[0].astype(np.int64), n),
                     lists(a, row, n), lists(b, row, n)], ["toxic", "terms", "a", "b"])
    return run


def _selected(docs: DataFrame, n: dict[int, int], p: ToxicityParams) -> np.ndarray:
    """Terms that tell the classes apart, alone or in a pair of words near each other."""
    total, share = n[0] + n[1], n[1] / (n[0] + n[1])

    def telling(rows: DataFrame, keys: list[str], bar: float) -> DataFrame:
        c = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= p.min_documents)

        def part(seen, expected):
            return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

        # the classes of texts with it, and of those without
        t, m, k = F.col("t"), F.col("n"), F.lit(float(total))
        rest, rest_t = k - m, F.lit(float(n[1])) - t
        g = (part(t, m * share) + part(m - t, m * (1 - share)) + part(rest_t, rest * share) + part(rest - rest_t, rest * (1 - share)))
        return c.filter(2 * g >= bar).select(*keys)

    one = telling(docs.select("toxic", F.explode("terms").alias("term")), ["term"], p.term_bar)
    near = docs.select("toxic", F.explode(F.arrays_zip("a", "b")).alias("x")).select("toxic", "x.a", "x.b")
    pair = telling(near, ["a", "b"], p.pair_bar)
    both = one.unionByName(pair.select(F.col("a").alias("term"))).unionByName(pair.select(F.col("b").alias("term")))
    return np.sort(np.asarray(both.distinct().toArrow()["term"]).view(np.uint64))  # of a bounded sample


def _reduced(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in batches:
            own = [np.asarray(t.values).view(np.uint64) for t in batch.column("terms")]
            at = [np.searchsorted(terms, t[np.isin(t, terms)]) for t in own]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(at, pa.list_(pa.int64()))], ["toxic", "at"])
    return run


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _descend(docs: list[np.ndarray], toxic: np.ndarray, n_terms: int, p: ToxicityParams):
    """AdaGrad on the logistic loss, one document at a time."""
    rng = np.random.default_rng(p.seed)
    w, v = np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, p.factors))
    gw, gv = np.full(n_terms, 1e-3), np.full((n_terms, p.factors), 1e-3)
    bias = float(np.log(toxic.mean() / (1 - toxic.mean())))
    for _ in range(p.epochs):
        for k in rng.permutation(len(docs)):
            x = docs[k]
            vx = v[x]
            total = vx.sum(axis=0)
            z = bias + w[x].sum() + 0.5 * float(total @ total - (vx * vx).sum())
            err = float(_sigmoid(z)) - toxic[k]
            # a text with few terms is not cleared for that alone: one term can outweigh this
            bias = max(p.least_bias, bias - 0.02 * err)
            g = err + p.l2 * w[x]
            gw[x] += g * g
            w[x] -= p.rate * g / np.sqrt(gw[x])
            g = err * (total - vx) + p.l2 * vx
            gv[x] += g * g
            v[x] = vx - 0.3 * p.rate * g / np.sqrt(gv[x])
    return w, v, bias


def _logits_of(docs: list[np.ndarray], w: np.ndarray, v: np.ndarray) -> np.ndarray:
    def one(x: np.ndarray) -> float:
        total = v[x].sum(axis=0)
        return float(w[x].sum() + 0.5 * (total @ total - (v[x] ** 2).sum()))

    return np.array([one(x) for x in docs])


def _best_cut(z: np.ndarray, toxic: np.ndarray, weight1: float, weight0: float) -> float:
    """Logit that separates the classes with the best F1, midway between its neighbours."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], toxic[order]
    hit = np.cumsum((y * weight1)[::-1])[::-1]  # toxic from here on
    wrong = np.cumsum(((1 - y) * weight0)[::-1])[::-1]
    f1 = 2 * hit / (hit + wrong + (y * weight1).sum())
    f1[1:][z[1:] == z[:-1]] = -1  # no cut between equal logits
    k = int(np.argmax(f1))
    return float((z[k - 1] + z[k]) / 2) if k else float(z[0] - 1)


def fit(documents: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> ToxicityModel:
    """Fit on documents (doc_id, text) that ``labels`` (doc_id, toxic) marks 0 or 1.

    Class counts cover all labelled rows; ``train_per_class`` documents of each class, drawn
    by a hash of their id, reach the driver as their terms of the model. The intercept is then
    moved so that the score ``threshold`` falls on the best cut of these documents' logits by
    models of the other ``folds``, each class weighted by its share of all labelled rows.
    """
    p = params or ToxicityParams()
    marked = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    none = (np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, p.factors)))
    if not (n0 and n1):
        return ToxicityModel(p, *none, 35.0 if n1 else -35.0)
    share = F.when(F.col("toxic") == 1, min(1.0, p.train_per_class / n1)).otherwise(min(1.0, p.train_per_class / n0))
    drawn = marked.filter(draw(F.col("doc_id"), "toxicity") < share).limit(4 * p.train_per_class)
    # at most 4 * train_per_class ids: small enough to send to every task
    rows = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "text")
    sample = cut_lineage(rows.select(F.col("toxic").cast("long"), "text").mapInArrow(
        _document_terms(p), "toxic bigint, terms array<bigint>, a array<bigint>, b array<bigint>"))
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        return ToxicityModel(p, *none, float(np.log(n1 / n0)))
    terms = _selected(sample, seen, p)
    shared = documents.sparkSession.sparkContext.broadcast(terms)
    got = sample.select("toxic", "terms").mapInArrow(_reduced(shared), "toxic bigint, at array<bigint>").toArrow()
    release(sample)
    found = sorted((y, x) for y, x in zip(got["toxic"].to_pylist(), got["at"].to_pylist(), strict=True))
    toxic = np.array([y for y, _ in found], dtype=np.float64)
    docs = [np.array(x, np.int64) for _, x in found]
    w, v, bias = _descend(docs, toxic, len(terms), p)
    # logits of each document by a model of the other folds
    fold = np.random.default_rng(p.seed).permutation(len(docs)) % p.folds
    z = np.zeros(len(docs))
    for k in range(p.folds):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        some = toxic[rest]
        fitted = _descend([docs[i] for i in rest], some, len(terms), p) if 0 < some.sum() < len(some) else (w, v, bias)
        z[own] = _logits_of([docs[i] for i in own], *fitted[:2]) + fitted[2]
    cut = _best_cut(z, toxic, n1 / toxic.sum(), n0 / (len(toxic) - toxic.sum()))
    bias += float(np.log(p.threshold / (1 - p.threshold))) - cut
    return ToxicityModel(p, terms, w, v, bias)


def _logits(text: pa.Array, m: ToxicityModel) -> np.ndarray:
    out = np.full(len(text), m.bias)
    if not len(m.terms):
        return out
    low = np.uint64((1 << 20) - 1)
    for piece in W.slices(pc.utf8_lower(text)):
        keys = []
        for h, rows in _terms(piece, m.params):
            maybe = np.flatnonzero(m.filter[(h & low).astype(np.int64)])
            h, rows = h[maybe], rows[maybe]
            at = np.minimum(np.searchsorted(m.terms, h), len(m.terms) - 1)
            hit = m.terms[at] == h
            keys.append(rows[hit] * len(m.terms) + at[hit])
        key = np.unique(np.concatenate(keys))
        rows, at = key // len(m.terms), key % len(m.terms)
        z = np.bincount(rows, weights=m.w[at], minlength=piece.n_rows).astype(np.float64)
        for f in range(m.v.shape[1]):
            vf = m.v[at, f]
            s = np.bincount(rows, weights=vf, minlength=piece.n_rows)
            z += 0.5 * (s * s - np.bincount(rows, weights=vf * vf, minlength=piece.n_rows))
        out[piece.first_row:piece.first_row + piece.n_rows] += z
    return out


def _scorer(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicityModel = shared.value
        for batch in batches:
            score = _sigmoid(_logits(batch.column("__text"), m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(score), pa.array((score >= m.params.threshold).astype(np.int32))],
                [*columns, "score", "predicted"])
    return run


def score(documents: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default, but for those of the result's names), ``score`` and
    ``predicted`` of every whole text."""
    keep = [c for c in (documents.columns if keep is None else keep) if c not in ("score", "predicted")]
    rows = documents.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([rows.schema[c] for c in keep]
                          + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scorer(shared, keep), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op2: toxicity of all documents, learnt outside fold 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.select("doc_id", "text"), labels.filter(~in_fold(F.col("doc_id"), 2, 4)))
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), 2, 4).alias("held_out"), "text")
    return score(rows, model, keep=["doc_id", "held_out"])
