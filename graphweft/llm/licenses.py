"""Licence scan by a positional rare-token index (operator 8).

Words are lower-cased runs of letters, digits and non-ASCII characters. The inverse document
frequency of every template word is counted over all documents. Each template posts its
rarest words with their positions; a file's occurrences of posted words vote for
(template, place where the template would begin), places that enough rare words agree on
are compared word by word with the template, and a match also needs the template's
mandatory key phrases inside the place.

Phrases that stand for a licence by themselves (base phrases) are counted at every place.

Defined results: a null text is empty; a file without words has no places, empty labels and
score 0. The score is the largest share of a matched template's words that the file has at
the place, 1 for a base phrase. Equal places of two templates give both labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm import words as W

# Phrases that name a licence, and the label of each.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrases: tuple[str, ...]


# Customary licence sentences, and the phrases that each must hold.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("free of charge",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("general public license", "version 3")),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("general public license", "version 2")),
    Template("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3", ("lesser general public license",)),
    Template("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3", ("affero general public license",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4",)),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights", ("waived all copyright",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("source and binary forms",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("public domain",)),
)


@dataclass(frozen=True)
class LicenseParams:
    """A place needs ``min_votes`` agreeing rare words (all posted words of a template with
    fewer) out of the ``rare_words`` rarest, and ``min_cover`` of the template's words, each
    at most ``slack`` words from its place."""

    rare_words: int = 6
    min_votes: int = 2
    min_cover: float = 0.8
    slack: int = 1


def _hashes(text: str) -> np.ndarray:
    return W.words(next(W.slices(pa.array([text]))), W.ALNUM).hashes


class _Index:
    """Postings of the rarest words: sorted hash, template and position in it."""

    def __init__(self, templates, idf: dict[int, float], p: LicenseParams) -> None:
        self.words = [_hashes(t.text) for t in templates]
        self.keys = [[_hashes(k) for k in t.key_phrases] for t in templates]
        self.labels = [t.label for t in templates]
        posts, self.votes = [], []
        for k, hashes in enumerate(self.words):
            distinct = sorted(set(hashes.tolist()), key=lambda h: (-idf.get(h, 0.0), h))
            rare = distinct[:p.rare_words]
            self.votes.append(min(p.min_votes, len(rare)))
            posts += [(h, k, pos) for pos, h in enumerate(hashes.tolist()) if h in set(rare)]
        posts.sort()
        self.hash = np.array([x[0] for x in posts], np.uint64)
        self.template = np.array([x[1] for x in posts], np.int64)
        self.position = np.array([x[2] for x in posts], np.int64)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.hash & np.uint64(0xFFFF)).astype(np.int64)] = True


def _consecutive(h: np.ndarray, row: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Word indices where the phrase's words stand one after the other in one row."""
    n = len(phrase)
    if len(h) < n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[:len(h) - n + 1] == phrase[0])
    for k in range(1, n):
        at = at[h[at + k] == phrase[k]]
    return at[row[at] == row[at + n - 1]]


def _candidates(found: W.Words, row: np.ndarray, index: _Index) -> np.ndarray:
    """(row, template, first word) triples with enough votes of rare words, as rows."""
    h = found.hashes
    at = np.flatnonzero(index.filter[(h & np.uint64(0xFFFF)).astype(np.int64)])
    lo = np.searchsorted(index.hash, h[at], "left")
    n = np.searchsorted(index.hash, h[at], "right") - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    post = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    word = np.repeat(at, n)
    begin = word - index.position[post]
    triple = np.stack([row[word], index.template[post], begin], axis=1)
    triple, votes = np.unique(triple, axis=0, return_counts=True)
    return triple[votes >= np.array(index.votes, np.int64)[triple[:, 1]]] if len(triple) else triple


def _verify(found: W.Words, triple: np.ndarray, index: _Index, p: LicenseParams) -> list[tuple[int, str, int, float]]:
    out = []
    for r, k, begin in triple.tolist():
        lo, hi = int(found.row_first[r]), int(found.row_first[r + 1])
        want = index.words[k]
        hit = np.zeros(len(want), bool)
        for d in range(-p.slack, p.slack + 1):
            pos = begin + d + np.arange(len(want))
            ok = (pos >= lo) & (pos < hi)
            hit[ok] |= found.hashes[pos[ok]] == want[ok]
        cover = float(hit.mean())
        if cover < p.min_cover:
            continue
        a, b = max(lo, begin - p.slack), min(hi, begin + len(want) + p.slack)
        near, one = found.hashes[a:b], np.zeros(b - a, np.int64)
        if all(len(_consecutive(near, one, key)) for key in index.keys[k]):
            out.append((r, index.labels[k], max(begin, lo) - lo, cover))
    return out


_MATCH = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
                                   T.StructField("cover", T.DoubleType())]))
_MATCH_ARROW = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("cover", pa.float64())]))
_NEW = [("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()),
        ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()),
        ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()),
        ("score", T.DoubleType(), pa.float64()), ("matches", _MATCH, _MATCH_ARROW)]


def _scan(piece: W.Slice, index: _Index, phrases, p: LicenseParams) -> list[tuple]:
    found = W.words(piece, W.ALNUM)
    row = found.rows()
    n = piece.n_rows
    base: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    match: list[list[tuple[str, int, float]]] = [[] for _ in range(n)]
    for hashes, label in phrases:
        for at in _consecutive(found.hashes, row, hashes).tolist():
            base[row[at]].append((label, at - int(found.row_first[row[at]])))
    for r, label, first, cover in _verify(found, _candidates(found, row, index), index, p):
        match[r].append((label, first, cover))
    out = []
    for r in range(n):
        places = [x[1] for x in base[r]]
        own = {x[0] for x in base[r]}
        every = own | {x[0] for x in match[r]}
        out.append((int(found.row_first[r + 1] - found.row_first[r]), len(places),
                    min(places, default=None), max(places, default=None), ",".join(sorted(own)),
                    ",".join(sorted(every)), 1.0 if places else max((x[2] for x in match[r]), default=0.0),
                    [{"label": a, "first_word": b, "cover": c} for a, b, c in sorted(match[r])]))
    return out


def _scanner(columns: list[str], templates, idf: dict[int, float], base_phrases, p: LicenseParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(templates, idf, p)
        phrases = [(_hashes(text), label) for text, label in base_phrases]
        for batch in batches:
            rows = [x for piece in W.slices(batch.column("__text")) for x in _scan(piece, index, phrases, p)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NEW)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(v, t) for v, (_, _, t) in zip(cols, _NEW, strict=True)],
                [*columns, *(name for name, _, _ in _NEW)])
    return run


def _frequencies(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, counts = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            docs += batch.num_rows
            for piece in W.slices(batch.column("text")):
                found = W.words(piece, W.ALNUM)
                at = np.minimum(np.searchsorted(vocabulary, found.hashes), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == found.hashes)
                pair = np.unique(found.rows()[hit] * len(vocabulary) + at[hit])
                counts += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(vocabulary))], pa.int32()),
                                          pa.array([docs, *counts.tolist()], pa.int64())], ["word", "n"])
    return run


def inverse_frequencies(documents: DataFrame, templates=TEMPLATES, text: str = "text") -> dict[int, float]:
    """log((documents + 1) / (documents with the word + 1)) of each template word, over all
    rows; the result holds one figure for each word of the templates."""
    vocabulary = np.unique(np.concatenate([_hashes(t.text) for t in templates]))
    rows = (documents.select(F.col(text).alias("text")).mapInArrow(_frequencies(vocabulary), "word int, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    n = {r["word"]: r["n"] for r in rows}
    total = n.get(-1, 0)
    return {int(h): float(np.log((total + 1) / (n.get(k, 0) + 1))) for k, h in enumerate(vocabulary)}


def scan(documents: DataFrame, text: str = "text", keep: list[str] | None = None, templates=TEMPLATES,
         base_phrases=BASE_PHRASES, params: LicenseParams | None = None) -> DataFrame:
    """Licence labels, places and score of every whole text, next to the columns ``keep``
    (all by default, but for those with names of the result)."""
    p = params or LicenseParams()
    new = [name for name, _, _ in _NEW]
    keep = [c for c in (documents.columns if keep is None else keep) if c not in new]
    idf = inverse_frequencies(documents, templates, text)
    rows = documents.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(n, t) for n, t, _ in _NEW])
    return rows.mapInArrow(_scanner(keep, templates, idf, base_phrases, p), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op8: licence scan of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, keep=["doc_id"])
