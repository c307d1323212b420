"""Near-duplicate documents by MinHash with odd sketches (operator 5).

A document's set is its distinct 5-word shingles. Documents with equal sets are one class
from the start, however many they are. Each class gets ``bands * rows`` MinHash samples; a
band of samples that two classes share makes them candidates. The same samples, folded into
an odd sketch (a bitmap of parities; Mitzenmacher, Pagh and Pham, 2014), give each candidate
pair an estimate of its similarity from the population count of the sketches' exclusive-or,
which is most precise where similarities are high. Pairs whose estimate is far too low go;
all others are confirmed on their whole sets.

No step emits all pairs of a band. First each member meets the band's smallest member, and
the components of the confirmed links are found. Then the members of a band that are still in
different components meet in blocks of sketches, and a block returns only spanning stars of
the components that have close sketches. What these stars join is a cluster: every pair of a
band that could still join two components lies in one. The sets of a cluster meet in blocks
too, are compared exactly, and return spanning stars again. Pairs within a component need no
look: they cannot change it. So components are those of all banded pairs; at the default 32
bands of 6 samples a pair at the threshold misses all bands with a probability of 3 in 10^7.

Defined results: a text without words, or null, has no set, links with nothing and is kept;
rows with the same doc_id are one document. A null doc_id is larger than any other: such a
row belongs to the component of equal texts, and is kept only if none of them has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm import words as W
from graphweft.llm.bitmaps import bitmap, columns, split
from graphweft.llm.components import components, spanning_stars
from graphweft.session import cut_lineage, text_batches


@dataclass(frozen=True)
class MinHashParams:
    """Links need ``100 * intersection >= percent * union``. ``sketch_floor`` is the estimate
    under which a candidate goes unconfirmed: at the defaults, more than eight standard
    deviations below what a pair at the threshold has. ``block`` sketches of a band, and sets
    with ``block_members`` shingles, but ``block`` at most, meet as many others in one share."""

    shingle: int = 5
    percent: int = 85
    bands: int = 32
    rows: int = 6
    sketch_bits: int = 512
    sketch_floor: float = 0.65
    block: int = 1024
    block_members: int = 1 << 20
    filter_bits: int = 24


#: What the pipeline takes for near: 0.8 or more. A pair there misses all bands with a probability
#: of 5 in 10^9; its sketches are as many standard deviations from the floor as at the defaults.
STAGE_PARAMS = MinHashParams(percent=80, bands=48, rows=5, sketch_floor=0.57)


def _codes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(85)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _sets(piece: W.Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted within the row, and where each row begins."""
    h, row = W.shingles(W.words(piece, W.SPACED), size)
    cut = np.searchsorted(row, np.arange(piece.n_rows + 1))
    own = [np.unique(h[cut[r]:cut[r + 1]]) for r in range(piece.n_rows)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    return (np.concatenate(own) if own else h), first


def _signatures(flat: np.ndarray, first: np.ndarray, p: MinHashParams) -> np.ndarray:
    """MinHash samples: a row for each non-empty set, a column for each sample."""
    begin = first[:-1][np.diff(first) > 0]
    mul, add = _codes(p.bands * p.rows)
    out = np.empty((len(begin), len(mul)), np.uint64)
    if len(begin):
        buf = np.empty_like(flat)
        for k in range(len(mul)):
            np.multiply(flat, mul[k], out=buf)
            np.add(buf, add[k], out=buf)
            out[:, k] = np.minimum.reduceat(buf, begin)
    return out


def _band_keys(samples: np.ndarray, p: MinHashParams) -> np.ndarray:
    keys = np.empty((len(samples), p.bands), np.uint64)
    for b in range(p.bands):
        acc = np.full(len(samples), b + 1, np.uint64)
        for k in range(p.rows):
            acc = W.mix(acc * np.uint64(3) + samples[:, b * p.rows + k])
        keys[:, b] = acc
    return keys.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of (sample number, sample) pairs, as rows of 64-bit words."""
    n, k = samples.shape
    salt = W.mix(np.arange(1, k + 1, dtype=np.uint64))
    at = (W.mix(samples ^ salt) % np.uint64(bits)).astype(np.int64) + np.arange(n)[:, None] * bits
    parity = (np.bincount(at.ravel(), minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(parity, axis=1, bitorder="little").view(np.int64)


def sketch_distance_limit(p: MinHashParams) -> int:
    """Largest population count of an exclusive-or whose estimate reaches ``sketch_floor``.

    With k samples and n bits, a similarity J leaves 2 k (1 - J) differing elements, which
    set n / 2 * (1 - (1 - 2 / n) ** (2 k (1 - J))) bits on average.
    """
    k, n = p.bands * p.rows, p.sketch_bits
    return int(n / 2 * (1 - (1 - 2 / n) ** (2 * k * (1 - p.sketch_floor))))


def _sketcher(p: MinHashParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, k1, k2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            bands = np.zeros((n, p.bands), np.int64)
            sketch = np.zeros((n, p.sketch_bits // 64), np.int64)
            for piece in W.slices(batch.column("text")):
                flat, first = _sets(piece, p.shingle)
                count = np.diff(first)
                rows = piece.first_row + np.flatnonzero(count)
                size[piece.first_row:piece.first_row + piece.n_rows] = count
                if not len(rows):
                    continue
                begin = first[:-1][count > 0]
                k1[rows] = np.add.reduceat(flat, begin).view(np.int64)
                k2[rows] = np.bitwise_xor.reduceat(W.mix(flat + np.uint64(77)), begin).view(np.int64)
                samples = _signatures(flat, first, p)
                bands[rows] = _band_keys(samples, p)
                sketch[rows] = odd_sketch(samples, p.sketch_bits)

            def lists(m: np.ndarray) -> pa.Array:
                off = pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1], pa.int32())
                return pa.ListArray.from_arrays(off, pa.array(m.ravel()))

            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(size), pa.array(k1), pa.array(k2), lists(bands), lists(sketch)],
                ["doc_id", "text_hash", "n_shingles", "k1", "k2", "bands", "sketch"])
    return run


def sketches(documents: DataFrame, params: MinHashParams | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles, k1 and k2 (128-bit key of the set), bands and odd sketch of
    each document's whole text."""
    p = params or MinHashParams()
    schema = "doc_id bigint, text_hash bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch array<bigint>"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_sketcher(p), schema)


def _distance(a: str, b: str, p: MinHashParams) -> Column:
    total = F.lit(0)
    for k in range(p.sketch_bits // 64):
        total = total + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return total


def _set_rows(shared, p: MinHashParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            maybe = np.flatnonzero(shared.value.has(ids ^ (ids >> 24)))
            part = batch.take(pa.array(maybe))
            ids, out_id, out_set = ids[maybe], [], []
            for piece in W.slices(part.column("text")):
                flat, first = _sets(piece, p.shingle)
                for r in range(piece.n_rows):
                    own = flat[first[r]:first[r + 1]]
                    key = (int(ids[piece.first_row + r]), int(own.sum()) if len(own) else 0)
                    if len(own) and key not in seen:  # a repeated row is sent once by a task
                        seen.add(key)
                        out_id.append(key[0])
                        out_set.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_set, pa.list_(pa.int64()))],
                                             ["id", "members"])
    return run


def shingle_sets(ids: DataFrame, documents: DataFrame, p: MinHashParams) -> DataFrame:
    """Sets (id, members) of documents whose doc_id is in ``ids`` (id), and of few others: a
    fixed-size filter of the ids tells which texts are worth it."""
    wanted = bitmap(ids, F.col("id").bitwiseXOR(F.shiftright("id", 24)), p.filter_bits)
    shared = documents.sparkSession.sparkContext.broadcast(wanted)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    with text_batches(documents.sparkSession):
        return cut_lineage(texts.mapInArrow(_set_rows(shared, p), "id bigint, members array<bigint>"))


def confirmed(pairs: DataFrame, documents: DataFrame, params: MinHashParams | None = None) -> DataFrame:
    """Of distinct pairs (a, b) of doc_ids, those whose whole sets reach the threshold."""
    p = params or MinHashParams()
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sets = shingle_sets(ids, documents, p)
    one = pairs.join(sets, F.col("a") == F.col("id")).select("a", "b", F.col("members").alias("m"))
    two = one.join(sets, F.col("b") == F.col("id")).select(
        "a", "b", F.size("m").alias("na"), F.size("members").alias("nb"),
        F.size(F.array_intersect("m", "members")).alias("both"))
    link = F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * p.percent
    return two.filter(link).select("a", "b").distinct()


def _close(pairs: DataFrame, classes: DataFrame, p: MinHashParams) -> DataFrame:
    """Pairs (a, b) of classes whose odd sketches are close enough to be looked at."""
    sketch = classes.select(F.col("class_id").alias("id"), "sketch")
    one = pairs.join(sketch, F.col("a") == F.col("id")).select("a", "b", F.col("sketch").alias("s"))
    two = one.join(sketch, F.col("b") == F.col("id")).select("a", "b", "s", "sketch")
    return two.filter(_distance("s", "sketch", p) <= sketch_distance_limit(p)).select("a", "b").distinct()


def _block_pairs(members: DataFrame, key: str, rest: list[str]) -> DataFrame:
    """Deal the members of each key to shares (key, x, y): every block with itself (side 2) and
    with each other block (sides 0 and 1). ``members`` have ``block`` and ``blocks``.

    The rows of a share come together and in order, so that a task reads share after share.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.select(key, "block", other.alias("other"), *rest).select(
        key, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), *rest)
    return dealt.repartition(key, "x", "y").sortWithinPartitions(key, "x", "y", "side")


def _shares(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The shares of a task, one after the other; a share may go on from batch to batch."""
    names, held, held_key = [key, "x", "y"], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(int(c[lo]) for c in cols)
            if held and own != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            held_key = own
    if held:
        yield pa.Table.from_batches(held)


def _sides(share: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = share.column("side").to_numpy()
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())],
                                      ["a", "b"])


def _sketch_stars(p: MinHashParams):
    """Spanning stars (a, b) of components that have members with close sketches in a share."""
    limit = sketch_distance_limit(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for share in _shares(batches, "band"):
            ia, ib = _sides(share)
            component = share.column("component").to_numpy()
            lists = share.column("sketch").combine_chunks()
            sketch = np.asarray(lists.flatten()).reshape(len(lists), -1)
            linked = np.zeros((len(ia), len(ib)), bool)
            for lo in range(0, len(ia), 64):
                far = np.zeros((len(ia[lo:lo + 64]), len(ib)), np.int32)
                for w in range(sketch.shape[1]):
                    far += np.bitwise_count(sketch[ia[lo:lo + 64], w][:, None] ^ sketch[ib, w][None])
                linked[lo:lo + 64] = far <= limit
            linked &= component[ia][:, None] != component[ib][None]
            if linked.any():
                out += spanning_stars(linked, component[ia], component[ib])
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)
    return run


def _set_stars(p: MinHashParams):
    """Spanning stars (a, b) of components that have linked members in a share.

    For each set of one side the shingles of the other side that it shares are looked up in
    one sorted list and counted by owner.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share in _shares(batches, "cluster"):
            ia, ib = _sides(share)
            if not len(ia) or not len(ib):  # a block without members
                continue
            component = share.column("component").to_numpy()
            lists = share.column("members").combine_chunks()
            flat, first = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            size = np.diff(first)
            own = np.concatenate([flat[first[j]:first[j + 1]] for j in ib])
            owner = np.repeat(np.arange(len(ib)), size[ib])
            order = np.argsort(own, kind="stable")
            own, owner = own[order], owner[order]
            linked = np.zeros((len(ia), len(ib)), bool)
            for k, i in enumerate(ia):
                members = flat[first[i]:first[i + 1]]
                lo = np.searchsorted(own, members, "left")
                n = np.searchsorted(own, members, "right") - lo
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                both = np.bincount(owner[at], minlength=len(ib))
                linked[k] = both * 100 >= (size[i] + size[ib] - both) * p.percent
            linked &= component[ia][:, None] != component[ib][None]
            yield _edges(spanning_stars(linked, component[ia], component[ib]))
    return run


def _clusters(banded: DataFrame, classes: DataFrame, label: DataFrame, p: MinHashParams) -> DataFrame:
    """(component, cluster) of the components whose members may still be linked to members of
    others: a band holds both, and their sketches are close."""
    named = (banded.join(label, F.col("class_id") == F.col("id"), "left")
             .select("band", "class_id", F.coalesce("component", "class_id").alias("component")))
    open_bands = (named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                            F.count(F.lit(1)).alias("n"))
                  .filter("lo < hi").select(F.col("band").alias("open"), "n"))
    members = (named.join(cut_lineage(open_bands), F.col("band") == F.col("open"))
               .select("band", "class_id", "component", F.ceil(F.col("n") / p.block).cast("int").alias("blocks")))
    sketch = classes.select(F.col("class_id").alias("id"), "sketch")
    members = (members.join(sketch, F.col("class_id") == F.col("id"))
               .withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")))
    stars = _block_pairs(members, "band", ["component", "sketch"]).mapInArrow(_sketch_stars(p), "a bigint, b bigint")
    return components(stars).select(F.col("id").alias("component"), F.col("component").alias("cluster"))


def _across(clusters: DataFrame, classes: DataFrame, label: DataFrame, documents: DataFrame, p: MinHashParams) -> DataFrame:
    """Links between components of a cluster, as spanning stars (a, b) of components."""
    label = label.select(F.col("id").alias("i"), F.col("component").alias("of"))
    cluster = clusters.select(F.col("component").alias("c"), "cluster")
    members = (classes.join(label, F.col("class_id") == F.col("i"), "left")
               .select("class_id", F.coalesce("of", "class_id").alias("component"))
               .join(cluster, F.col("component") == F.col("c")).select("class_id", "component", "cluster"))
    members = cut_lineage(members.distinct())
    sets = shingle_sets(members.select(F.col("class_id").alias("id")), documents, p)
    whole = members.join(sets, F.col("class_id") == F.col("id")).select("class_id", "component", "cluster", "members")
    whole = cut_lineage(whole)
    totals = whole.groupBy(F.col("cluster").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("members")).alias("m"))
    blocks = F.ceil(F.greatest(F.col("n") / p.block, F.col("m") / p.block_members)).cast("int")
    sized = (whole.join(cut_lineage(totals), F.col("cluster") == F.col("k")).withColumn("blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")))
    dealt = _block_pairs(sized, "cluster", ["component", "members"])
    return dealt.mapInArrow(_set_stars(p), "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, params: MinHashParams | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash of every row of ``documents``
    (doc_id, text)."""
    p = params or MinHashParams()
    with text_batches(documents.sparkSession):
        every = cut_lineage(sketches(documents, p))
    full = every.filter("n_shingles > 0")
    classes = cut_lineage(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id")))
    own = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "class_id")
    # one row for each class (more only if rows repeat)
    first = cut_lineage(full.join(own, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
                        .filter(F.col("doc_id") == F.col("class_id")).select("class_id", "bands", "sketch"))
    banded = first.select("class_id", F.explode("bands").alias("band"))
    leads = cut_lineage(banded.groupBy("band").agg(F.min("class_id").alias("lead"), F.max("class_id").alias("top"))
                        .filter("lead < top").select(F.col("band").alias("key"), "lead"))
    shared = banded.join(leads, F.col("band") == F.col("key")).select("class_id", "band", "lead")
    shared = cut_lineage(shared)
    star = shared.filter("class_id > lead").select(F.col("lead").alias("a"), F.col("class_id").alias("b")).distinct()
    links = cut_lineage(confirmed(cut_lineage(_close(star, first, p)), documents, p))
    label = cut_lineage(components(links))
    clusters = cut_lineage(_clusters(shared.select("class_id", "band"), first, label, p))
    if not clusters.isEmpty():
        # the components so far, as stars, and the links between them
        stars = label.filter("component <> id").select(F.col("component").alias("a"), F.col("id").alias("b"))
        label = cut_lineage(components(stars.unionByName(_across(clusters, first, label, documents, p))))
    named = cut_lineage(classes.join(label, F.col("class_id") == F.col("id"), "left")
                        .select(F.col("k1").alias("c1"), F.col("k2").alias("c2"),
                                F.coalesce("component", "class_id").alias("component")))
    joined = every.select("doc_id", "text_hash", "n_shingles", "k1", "k2").join(
        named, (F.col("n_shingles") > 0) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op5: near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component at ``STAGE_PARAMS`` stays, the one with the
    smallest doc_id.

    Of several rows with its id one with the smallest text hash stays. Rows without an id stay
    if no row with an id has their set; those of one text then count as one.
    """
    marks = cut_lineage(near_duplicates(docs, STAGE_PARAMS).select("doc_id", "text_hash", "kept"))
    one = marks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("least"))
    one = one.select(F.col("doc_id").alias("id"), "n", "least")
    joined = marks.join(cut_lineage(one), F.col("doc_id").eqNullSafe(F.col("id")))
    chosen = F.col("kept") & (F.col("doc_id").isNull() | (F.col("text_hash") == F.col("least")))
    touched = joined.filter(~F.col("kept") | (F.col("n") > 1)).groupBy("doc_id", "text_hash").agg(F.max(chosen).alias("chosen"))
    touched = cut_lineage(touched.withColumnRenamed("text_hash", "__hash"))
    keyed = docs.select(F.xxhash64("text").alias("__hash"), *columns(docs))
    rest, some = split(keyed, touched, ["doc_id", "__hash"])
    mark = touched.select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h"), "chosen")
    met = some.join(mark, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left")
    row = F.struct(*columns(docs))
    alike = (met.filter("chosen").groupBy("doc_id", "__hash")
             .agg(F.min_by(row, F.xxhash64(*columns(docs))).alias("row")).select("row.*"))
    free = met.filter("chosen IS NULL").select(*columns(docs))
    return rest.select(*columns(docs)).unionByName(free).unionByName(alike)


#: The same by counting common shingles of all pairs that have one.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_in AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT i.a, i.b FROM both_in i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b
  WHERE 100 * i.n >= 85 * (x.n + y.n - i.n)),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT near.b, reach.root FROM reach JOIN near ON near.a = reach.id),
c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id
"""
