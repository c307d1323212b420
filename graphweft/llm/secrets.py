"""Secret scan with corpus-wide ownership frequency (operator 6).

Three patterns give the base spans (assignments of passwords and tokens, access key ids, long
hexadecimal runs). Their values, and other random-looking words, are candidates. A
candidate's hash is counted by distinct owners and repositories over the whole corpus: a
value that many owners or repositories hold is an example that people copy, and one that
belongs to few and looks random is taken for live. Live values are spans of their own, next
to the base spans.

Counts are sums of distinct (hash, owner, repository) rows, so that an example found in a
third of all documents is many small rows before it is one. Patterns run on texts that hold a
keyword, a long run of hexadecimal digits or a long mixed word; what texts these are is
found by byte operations on whole slices.

Defined results: a null text is empty; a null owner or repository counts as one of its own.
A value that is seen twice in a text is two spans. Repeated rows get equal results. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import bisect
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm import words as W
from graphweft.llm.bitmaps import columns, split
from graphweft.session import cut_lineage, text_batches

# Kinds in the order of results, the patterns of the base kinds, the least
# length of what counts, and words that only examples hold.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
PLACEHOLDERS = ("example", "changeme", "placeholder", "dummy", "sample", "your", "xxxx")


@dataclass(frozen=True)
class SecretParams:
    """``copied_owners`` distinct owners or ``copied_repos`` distinct repositories make a value
    an example. Live values have ``least_entropy`` bits a character; random-looking words
    besides the base spans have ``word_entropy`` bits, letters and digits, and ``word_length``
    characters or more."""

    copied_owners: int = 3
    copied_repos: int = 5
    least_entropy: float = 2.7
    word_entropy: float = 3.6
    word_length: int = 20


_HEX_BYTES = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x66 for b in range(256)])
_WORD_BYTES = np.array([chr(b).isalnum() and b < 128 or chr(b) in "+/_=-" for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])


def _hits(piece: W.Slice, p: SecretParams) -> np.ndarray:
    """Rows that may hold a base span or a random-looking word."""
    rows = np.zeros(piece.n_rows, bool)
    raw, low = piece.data.tobytes(), W.LOWER[piece.data].tobytes()
    found: list[int] = []
    for where, keys in ((low, KEYWORDS), (raw, (b"AKIA",))):
        for key in keys:
            at = where.find(key)
            while at >= 0:
                found.append(at)
                at = where.find(key, at + 1)
    runs = [np.array(found, np.int64)]
    s, e = W.spans(piece.data, piece.offsets, _HEX_BYTES)
    runs.append(s[e - s >= LEAST_HEX])
    s, e = W.spans(piece.data, piece.offsets, _WORD_BYTES)
    s, e = s[e - s >= p.word_length], e[e - s >= p.word_length]
    if len(s):
        digits = np.concatenate([[0], np.cumsum(_DIGIT[piece.data])])
        n = digits[e] - digits[s]
        runs.append(s[(n > 0) & (n < e - s)])
    at = np.concatenate(runs)
    rows[np.searchsorted(piece.offsets, at, side="right") - 1] = True
    return rows


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * np.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind number, start, end, value start, value end) of a text, by start, then kind."""
    out = [(0, m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(1, m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(2, m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _looks_live(value: str, least: float) -> bool:
    low = value.lower()
    return entropy(value) >= least and not any(x in low for x in PLACEHOLDERS)


def candidates(text: str, base: list[tuple], p: SecretParams) -> list[tuple[int, int]]:
    """Value spans that look live: those of base spans, and random-looking words elsewhere."""
    found = {(a, b) for _, _, _, a, b in base if _looks_live(text[a:b], p.least_entropy)}
    covered = sorted((s, e) for _, s, e, _, _ in base)
    starts = [s for s, _ in covered]
    reach = list(itertools.accumulate((e for _, e in covered), max))  # the furthest end so far
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % p.word_length, text):
        a, b = m.span()
        w = m.group()
        before = bisect.bisect_left(starts, b)  # spans that begin before the word ends
        if before and reach[before - 1] > a:
            continue
        if re.search("[0-9]", w) and re.search("[A-Za-z]", w) and _looks_live(w, p.word_entropy):
            found.add((a, b))
    # of spans that overlap (a run of digits inside an assignment) the first, longest one
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


_SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"
_VALUE = "array<struct<hash:binary,start:bigint,end:bigint>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_VALUE_ARROW = pa.list_(pa.struct([("hash", pa.binary()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanner(columns: list[str], p: SecretParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("__text")
            base: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            value: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for piece in W.slices(text):
                for r in np.flatnonzero(_hits(piece, p)).tolist():
                    own = piece.data[piece.offsets[r]:piece.offsets[r + 1]].tobytes().decode()
                    found = base_spans(own)
                    base[piece.first_row + r] = [{"kind": k, "start": a, "end": b} for k, a, b, _, _ in found]
                    value[piece.first_row + r] = [
                        {"hash": hashlib.blake2b(own[a:b].encode(), digest_size=16).digest(), "start": a, "end": b}
                        for a, b in candidates(own, found, p)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(base, _SPAN_ARROW), pa.array(value, _VALUE_ARROW)],
                [*columns, "base", "values"])
    return run


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each candidate: rows (hash, owner, repo) give
    hash, n_owners, n_repos. A repository is one of its owner's."""
    each = found.select("hash", F.struct("owner").alias("owner"), F.struct("repo").alias("repo")).distinct()
    return each.groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def scan(documents: DataFrame, owner: str, repo: str, text: str = "text", keep: list[str] | None = None,
         params: SecretParams | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text by default), ``base`` spans (kind number, start, end),
    ``live`` spans (start, end) and ``n_copied`` (candidates that are copied examples)."""
    p = params or SecretParams()
    new = ["base", "values", "live", "n_copied"]
    keep = [c for c in ([c for c in documents.columns if c != text] if keep is None else keep) if c not in new]
    rows = documents.select(*keep, F.col(owner).cast("string").alias("__owner"),
                            F.col(repo).cast("string").alias("__repo"), F.col(text).alias("__text"))
    columns = [*keep, "__owner", "__repo"]
    schema = T.StructType([rows.schema[c] for c in columns] + [
        T.StructField("base", T._parse_datatype_string(_SPAN)), T.StructField("values", T._parse_datatype_string(_VALUE))])
    # written once, with a number for each row: spans are put back to rows by it
    with text_batches(documents.sparkSession):
        scanned = cut_lineage(rows.mapInArrow(_scanner(columns, p), schema).withColumn("__row", F.monotonically_increasing_id()))
    each = scanned.select("__row", "__owner", "__repo", F.explode("values").alias("v")).select(
        "__row", F.col("__owner").alias("owner"), F.col("__repo").alias("repo"), F.col("v.hash").alias("hash"),
        F.col("v.start").alias("start"), F.col("v.end").alias("end"))
    counts = cut_lineage(ownership(each.select("hash", "owner", "repo"))).withColumnRenamed("hash", "h")
    copied = (F.col("n_owners") >= p.copied_owners) | (F.col("n_repos") >= p.copied_repos)
    judged = each.join(counts, F.col("hash") == F.col("h")).withColumn("copied", copied)
    span = F.when(~F.col("copied"), F.struct("start", "end"))
    back = judged.groupBy("__row").agg(F.array_sort(F.collect_list(span)).alias("live"),
                                       F.sum(F.col("copied").cast("long")).alias("n_copied"))
    back = cut_lineage(back).withColumnRenamed("__row", "__r")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return (scanned.join(back, F.col("__row") == F.col("__r"), "left")
            .select(*keep, "base", F.coalesce("live", none).alias("live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied")))


def _joined(spans: F.Column) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def _count(kind: int) -> F.Column:
    return F.size(F.filter(F.col("base"), lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op6: secrets of all documents. Owners are sources; a source's documents of
    one language are a repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, owner="source", repo="lang", keep=["doc_id"])
    live = F.transform("live", lambda s: F.struct(F.lit(3).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def place(spans: F.Column) -> F.Column:
        # fields in the order that arrays of them are sorted by
        order = ("start", "kind", "end")
        return F.array_sort(F.transform(spans, lambda s: F.struct(*[s[k].alias(k) for k in order])))

    return found.select(
        "doc_id", _count(0).alias("n_assign"), _count(1).alias("n_access"), _count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(place(F.concat("base", live))).alias("spans"),
        F.size("live").cast("long").alias("n_live"), "n_copied")


def _redactor(columns: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("__live").to_pylist(), strict=True):
                for s in reversed(spans or []):
                    t = t[:s["start"]] + "[secret]" + t[s["end"]:]
                out.append(t)
            cols = [batch.column(c) for c in columns]
            cols[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, columns)
    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: live secrets are replaced by ``[secret]`` (``n_chars`` follows); all
    documents stay.

    Only texts that a fixed-size filter of the concerned ids lets through are moved to meet
    their spans; all others go on as they are.
    """
    keyed = docs.select(F.xxhash64("text").alias("__hash"), *columns(docs))
    found = scan(keyed, owner="source", repo="lang", keep=["doc_id", "__hash"])
    live = cut_lineage(found.filter(F.size("live") > 0).groupBy("doc_id", "__hash").agg(F.first("live").alias("__live")))
    rest, some = split(keyed, live, ["doc_id", "__hash"])
    live = live.select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h"), "__live")
    some = some.join(live, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left")
    fixed = some.select(*columns(docs), "__live").mapInArrow(_redactor(docs.columns, docs.columns.index("text")), docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        fixed = fixed.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rest.select(*columns(docs)).unionByName(fixed)
