"""Scores of a gated recurrent language model (operator 7).

A GRU reads a document word by word from its beginning to its end. The output is factored by
classes: the softmax over classes of words of like frequency, times the softmax within the
word's class. Words outside the model's vocabulary share one symbol of it, and get their part
of that symbol's probability from their counts in the training documents, so that the score
is a probability of the very text, whatever its words.

Counts of words cover all training documents and every word, and so does the fit of the
weights. It goes in rounds, each over its share of the training documents: every task reads
its whole documents and descends from the same weights, in numpy, by back-propagation through
time, truncated to windows; then the tasks' weights are averaged by the words they have read.
The state goes on from window to window, in fitting and in scoring.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, and every document
has one end symbol, which counts as a word.

Defined results: a null or empty text is the end symbol alone. Without training documents
every count is 0 and the model is the untrained one. Repeated rows score alike.
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
from graphweft.llm.langid import in_fold
from graphweft.session import cut_lineage, release

#: symbols of the model besides its words, and the key of the end symbol among word hashes
END, RARE = 0, 1
END_HASH = 1


@dataclass(frozen=True)
class LmParams:
    """At most ``head`` words, the most frequent ones, travel with every task, all others meet
    their counts in a join; ``vocabulary`` of them are the model's. Every training document
    belongs to one of ``rounds`` rounds, by a hash of its text, and a task reads its documents
    of a round ``epochs`` times, ``buffer`` words or one document and more at a time."""

    head: int = 1 << 18
    vocabulary: int = 4094
    classes: int = 64
    hidden: int = 16
    rounds: int = 3
    buffer: int = 1 << 17
    lanes: int = 256
    window: int = 24
    epochs: int = 1
    rate: float = 0.08
    clip: float = 5.0
    seed: int = 3


# --- counts -------------------------------------------------------------------------------

#: distinct words that a task holds before it passes them on
_FLUSH = 1 << 20


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, sums, docs = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(at, weights=np.concatenate(sums), minlength=len(k)).astype(np.int64)

    for batch in batches:
        docs += batch.num_rows
        for piece in W.slices(batch.column("text")):
            k, n = np.unique(W.words(piece, W.SPACED).hashes.view(np.int64), return_counts=True)
            keys.append(k)
            sums.append(n)
        if sum(map(len, keys)) > 2 * _FLUSH:
            k, n = merged()
            keys, sums = [k], [n]
            if len(k) > _FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["word", "n"])
                keys, sums = [], []
    k, n = merged()
    if docs:
        k, n = np.append(k, END_HASH), np.append(n, docs)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], ["word", "n"])


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word hash, n) of every word of all texts, and of the end symbol."""
    each = documents.select(F.col(text).alias("text")).mapInArrow(_counter, "word bigint, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words above a count that ``most`` words reach at most, by
    falling count. The count is read off a histogram with sixteen classes an octave, so that no
    task has to sort what all others found; a word is left out only with all of its class."""
    level = F.floor(F.log2("n") * 16)
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()
    reached, least = 0, None
    for r in sizes:
        reached += r["words"]
        if reached > most:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.filter(level >= least).select("word", "n").toArrow()
    word, n = np.asarray(top["word"]).view(np.uint64), np.asarray(top["n"])
    order = np.lexsort((word, -n))
    return word[order], n[order]


class Head:
    """The most frequent words by hash: log10(count + 1/2) and symbol in the model."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, vocabulary: int) -> None:
        order = np.argsort(hashes)
        self.hash = hashes[order]
        self.log = np.log10(counts[order] + 0.5)
        symbol = np.full(len(hashes), RARE, np.int32)
        symbol[:vocabulary] = np.arange(2, 2 + min(vocabulary, len(hashes)))
        self.symbol = symbol[order]
        slot = (self.hash >> np.uint64(44)).astype(np.int64)
        self.first = np.full(1 << 20, -1, np.int32)
        self.first[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        left = np.flatnonzero(self.first[slot] != np.arange(len(slot)))
        self.over, self.over_at = self.hash[left], left

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 if it is not of the head."""
        if not len(self.hash):
            return np.full(len(h), -1, np.int64)
        at = self.first[(h >> np.uint64(44)).astype(np.int64)].astype(np.int64)
        miss = np.flatnonzero((at < 0) | (self.hash[at] != h))
        at[miss] = -1
        if len(self.over):
            k = np.minimum(np.searchsorted(self.over, h[miss]), len(self.over) - 1)
            hit = self.over[k] == h[miss]
            at[miss[hit]] = self.over_at[k[hit]]
        return at


# --- model --------------------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _with_one(states: np.ndarray) -> np.ndarray:
    """States with a last column of ones, which the biases are the weights of."""
    out = np.ones((len(states), states.shape[1] + 1), np.float32)
    out[:, :-1] = states
    return out


#: the logits of a softmax may go so far apart that exp still has them in single precision
_SPREAD = 60


def _logit_table(w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (softmax, input, symbol) with their biases as a last input, less a bound that no
    logit exceeds, as states are within -1 and 1; and whether the largest logit of any state is
    near enough to it, so that exp needs no maximum of each row."""
    reach = np.abs(w).sum(axis=1)
    top = (bias + reach).max(axis=1, keepdims=True)
    safe = top - (bias - reach).max(axis=1, keepdims=True) < _SPREAD
    return np.concatenate([w, (bias - top)[:, None]], axis=1), safe[:, 0]


def _logits(states: np.ndarray, table: np.ndarray, safe: bool) -> np.ndarray:
    x = states @ table
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    return x


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def _log_prob(states: np.ndarray, table: np.ndarray, safe: bool, target: np.ndarray) -> np.ndarray:
    x = _logits(states, table, safe)
    own = x[np.arange(len(target)), target]
    np.exp(x, out=x)
    return own - np.log(_row_sums(x))


class Gru:
    """GRU with one-hot input and class-factored output; symbols are ordered by frequency
    within the vocabulary, and a class is a run of symbols."""

    def __init__(self, counts: np.ndarray, p: LmParams) -> None:
        rng = np.random.default_rng(p.seed)
        n, h = len(counts), p.hidden
        # classes of about equal size over symbols by falling frequency
        order = np.argsort(-counts, kind="stable")
        self.size = max(1, -(-n // p.classes))
        self.n_classes = -(-n // self.size)
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)  # class and rank of a symbol in one number
        mass = np.zeros(self.n_classes * self.size)
        mass[:n] = counts[order] + 0.5
        mass = mass.reshape(self.n_classes, self.size)
        self.inp = rng.normal(0, 0.1, (n, 3 * h)).astype(np.float32)
        self.rec = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.cls = rng.normal(0, 0.05, (h, self.n_classes)).astype(np.float32)
        self.cls_bias = np.log(mass.sum(axis=1)).astype(np.float32)
        self.out = rng.normal(0, 0.05, (self.n_classes, h, self.size)).astype(np.float32)
        self.out_bias = np.log(np.maximum(mass, 1e-30)).astype(np.float32)  # padding has no mass
        self.out_bias[mass == 0] = -1e4

    def step(self, x: np.ndarray, h: np.ndarray):
        """New state from inputs and states; also what back-propagation needs."""
        d = h.shape[1]
        a, g = self.inp[x], h @ self.rec
        zr = _sigmoid(a[:, :2 * d] + g[:, :2 * d])
        z, r = zr[:, :d], zr[:, d:]
        c = np.tanh(a[:, 2 * d:] + r * g[:, 2 * d:])
        return c + z * (h - c), (z, r, c, g[:, 2 * d:])

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target after its state."""
        place = self.place[targets]
        cls, rank = place // self.size, place % self.size
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(self.n_classes + 1))
        mine, rank = _with_one(states[order]), rank[order]
        own = np.empty(len(cls), np.float32)
        table, safe = _logit_table(self.cls[None], self.cls_bias[None])
        for lo in range(0, len(cls), 2048):  # logits of so many rows stay in a core's cache
            own[lo:lo + 2048] = _log_prob(mine[lo:lo + 2048], table[0], safe[0], cls[order[lo:lo + 2048]])
        tables, safe = _logit_table(self.out, self.out_bias)
        for k in np.flatnonzero(np.diff(cut)):
            own[cut[k]:cut[k + 1]] += _log_prob(mine[cut[k]:cut[k + 1]], tables[k], safe[k], rank[cut[k]:cut[k + 1]])
        out = np.empty_like(own)
        out[order] = own
        return out

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each symbol sequence, an end symbol included.

        Documents run side by side, longest first, so that those still unread are the first
        rows of the state; windows hold about as many symbols however few are left.
        """
        total = np.zeros(len(docs))
        if not docs:
            return total
        length = np.array([len(d) + 1 for d in docs])
        order = np.argsort(-length, kind="stable")
        lengths = length[order]
        flat = np.concatenate([np.append(docs[k], END) for k in order]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        h = np.zeros((len(docs), self.rec.shape[0]), np.float32)
        x = np.full(len(docs), END, np.int64)
        t = 0
        while t < lengths[0]:
            alive = int(np.searchsorted(-lengths, -t, side="left"))
            window = int(np.clip(16384 // alive, 8, 2048))
            states, targets, rows = [], [], []
            for _ in range(window):
                alive = int(np.searchsorted(-lengths, -t, side="left"))
                if not alive:
                    break
                h = h[:alive]
                h, _ = self.step(x[:alive], h)
                x = flat[begin[:alive] + t]
                states.append(h)
                targets.append(x)
                rows.append(order[:alive])
                t += 1
            lp = self.log_probs(np.concatenate(states), np.concatenate(targets))
            total += np.bincount(np.concatenate(rows), weights=lp, minlength=len(docs))
        return total / np.log(10)


def _backward(m: Gru, xs, hs, caches, targets, resets) -> dict[str, np.ndarray]:
    """Gradients of the mean loss of one window (states are cut at its beginning)."""
    steps, lanes, d = len(xs), len(xs[0]), m.rec.shape[0]
    states = _with_one(np.concatenate(hs[1:]))
    place = m.place[np.concatenate(targets)]
    cls, rank = place // m.size, place % m.size
    n = len(cls)
    order = np.argsort(cls, kind="stable")
    cut = np.searchsorted(cls[order], np.arange(m.n_classes + 1))
    states, cls, rank = states[order], cls[order], rank[order]

    def softmax(lo: int, hi: int, table: np.ndarray, safe: bool, target: np.ndarray) -> np.ndarray:
        """Gradient of the mean loss by the logits."""
        x = _logits(states[lo:hi], table, safe)
        np.exp(x, out=x)
        x /= (_row_sums(x) * np.float32(n))[:, None]
        x[np.arange(hi - lo), target[lo:hi]] -= np.float32(1 / n)
        return x

    sorted_back = np.empty((n, d), np.float32)
    by_class = np.zeros((d + 1, m.n_classes), np.float32)
    table, safe = _logit_table(m.cls[None], m.cls_bias[None])
    for lo in range(0, n, 2048):  # logits of so many rows stay in a core's cache
        hi = min(n, lo + 2048)
        x = softmax(lo, hi, table[0], safe[0], cls)
        by_class += states[lo:hi].T @ x
        np.matmul(x, m.cls.T, out=sorted_back[lo:hi])
    tables, safe = _logit_table(m.out, m.out_bias)
    within = np.zeros((m.n_classes, d + 1, m.size), np.float32)
    for k in np.flatnonzero(np.diff(cut)):
        lo, hi = cut[k], cut[k + 1]
        x = softmax(lo, hi, tables[k], safe[k], rank)
        np.matmul(states[lo:hi].T, x, out=within[k])
        sorted_back[lo:hi] += x @ m.out[k].T
    g = {"cls": by_class[:d], "cls_bias": by_class[d], "out": within[:, :d], "out_bias": within[:, d]}
    back = np.empty_like(sorted_back)
    back[order] = sorted_back
    back = back.reshape(steps, lanes, d)
    z, r, c, gc = (np.stack(x) for x in zip(*caches, strict=True))
    h0 = np.stack(hs[:-1]) * np.stack(resets)[:, :, None]
    to_c, to_z, to_r = (1 - z) * (1 - c * c), (h0 - c) * z * (1 - z), gc * r * (1 - r)
    gate = np.empty((steps, lanes, 3 * d), np.float32)
    through = np.empty_like(gate)  # what goes on to the previous state by the recurrent weights
    dh = np.zeros((lanes, d), np.float32)
    rec_t = np.ascontiguousarray(m.rec.T)
    for t in range(steps - 1, -1, -1):
        dh += back[t]
        dc = dh * to_c[t]
        gate[t, :, :d] = dh * to_z[t]
        gate[t, :, d:2 * d] = dc * to_r[t]
        gate[t, :, 2 * d:] = dc
        through[t, :, :2 * d] = gate[t, :, :2 * d]
        through[t, :, 2 * d:] = dc * r[t]
        dh = (dh * z[t] + through[t] @ rec_t) * resets[t][:, None]
    g["rec"] = h0.reshape(-1, d).T @ through.reshape(-1, 3 * d)
    g["inp"] = (np.concatenate(xs), gate.reshape(-1, 3 * d))
    return g


_WEIGHTS = ("inp", "rec", "cls", "cls_bias", "out", "out_bias")


class Descent:
    """AdaGrad on the weights of a model, over windows of ``lanes`` streams."""

    def __init__(self, m: Gru, p: LmParams, packed: np.ndarray | None = None):
        self.m, self.p = m, p
        self.square = {k: np.full(getattr(m, k).shape, 1e-6, np.float32) for k in _WEIGHTS}
        if packed is not None:
            at = 0
            for name in _WEIGHTS:
                for store in (getattr(m, name), self.square[name]):
                    store[...] = packed[at:at + store.size].reshape(store.shape)
                    at += store.size

    def packed(self) -> np.ndarray:
        """All weights and sums of squares in one array."""
        return np.concatenate([x.ravel() for k in _WEIGHTS for x in (getattr(self.m, k), self.square[k])])

    def _update(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        norm = float(np.sqrt((grad * grad).sum()))
        if norm > self.p.clip:
            grad = grad * np.float32(self.p.clip / norm)
        s = self.square[name]
        s[at] += grad * grad
        w = getattr(self.m, name)
        w[at] -= np.float32(self.p.rate) * grad / np.sqrt(s[at])

    def _update_each(self, name: str, grad: np.ndarray) -> None:
        """The same for the weights of each class of its own; a gradient of 0 changes nothing."""
        norm = np.sqrt((grad * grad).reshape(len(grad), -1).sum(axis=1, dtype=np.float64))
        much = np.flatnonzero(norm > self.p.clip)
        grad[much] *= (self.p.clip / norm[much]).astype(np.float32).reshape(-1, *[1] * (grad.ndim - 1))
        s = self.square[name]
        s += grad * grad
        w = getattr(self.m, name)
        w -= np.float32(self.p.rate) * grad / np.sqrt(s)

    def run(self, stream: np.ndarray) -> None:
        """One pass over documents that each end with the end symbol."""
        p, m = self.p, self.m
        lanes = max(1, min(p.lanes, len(stream) // (2 * p.window)))
        steps = -(-len(stream) // lanes)
        data = np.full(lanes * steps, END, np.int64)  # filled up with empty documents
        data[:len(stream)] = stream
        data = data.reshape(lanes, steps)
        h = np.zeros((lanes, p.hidden), np.float32)
        prev = np.full(lanes, END, np.int64)
        for lo in range(0, steps, p.window):
            xs, hs, caches, targets, resets = [], [h], [], [], []
            for t in range(lo, min(steps, lo + p.window)):
                keep = (prev != END).astype(np.float32)  # a new document begins with no state
                h, cache = m.step(prev, hs[-1] * keep[:, None])
                xs.append(prev)
                hs.append(h)
                caches.append(cache)
                resets.append(keep)
                prev = data[:, t]
                targets.append(prev)
            g = _backward(m, xs, hs, caches, targets, resets)
            self._update("cls", g["cls"])
            self._update("cls_bias", g["cls_bias"])
            self._update("rec", g["rec"])
            self._update_each("out", g["out"])
            self._update_each("out_bias", g["out_bias"])
            order = np.argsort(g["inp"][0], kind="stable")
            symbols, first = np.unique(g["inp"][0][order], return_index=True)
            self._update("inp", np.add.reduceat(g["inp"][1][order], first, axis=0), symbols)


def train(docs: list[np.ndarray], counts: np.ndarray, p: LmParams) -> Gru:
    """Fit the weights on symbol sequences in one place."""
    m = Gru(counts, p)
    descent = Descent(m, p)
    for _ in range(p.epochs if docs else 0):
        descent.run(np.concatenate([np.append(d, END) for d in docs]))
    return m


def _round(shared_head, shared_state, counts: np.ndarray, p: LmParams):
    """A task's descent over its documents: the number of words and the packed weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        descent, held, words, size = None, [], 0, 0

        def read() -> None:
            for _ in range(p.epochs):
                descent.run(np.concatenate(held))

        for batch in batches:
            if descent is None:
                descent = Descent(Gru(counts, p), p, shared_state.value)
            for piece in W.slices(batch.column("text")):
                found, _, symbol = _symbols(shared_head.value, piece)
                # an end symbol behind each document
                held.append(np.insert(symbol.astype(np.int64), found.row_first[1:], END))
                size += len(held[-1])
                if size >= p.buffer:
                    read()
                    held, words, size = [], words + size, 0
        if size:
            read()
        if words + size:
            yield pa.RecordBatch.from_arrays(
                [pa.array([words + size], pa.int64()), pa.array([descent.packed().tobytes()], pa.binary())], ["words", "weights"])
    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean of weights by words, one task's weights in memory at a time."""
    words, mean = 0, None
    for batch in batches:
        for n, raw in zip(batch.column("words").to_pylist(), batch.column("weights"), strict=True):
            own = np.frombuffer(raw.as_buffer(), np.float32)
            words += n
            mean = own.astype(np.float64) if mean is None else mean + (own - mean) * (n / words)
    if mean is not None:
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())],
                                         ["words", "weights"])


#: parts of an average that reach the driver
_PARTS = 8


def fit(training: DataFrame, shared_head, counts: np.ndarray, text: str, p: LmParams) -> Gru:
    """Weights from all training documents, in rounds. What a task has learnt is written, and
    averaged in two steps, so that a few arrays reach the driver, however many tasks there are."""
    spark = training.sparkSession
    schema = "words bigint, weights binary"
    rows = training.select(F.col(text).alias("text"))
    turn = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(p.rounds))
    state = Descent(Gru(counts, p), p).packed()
    for k in range(p.rounds):
        shared = spark.sparkContext.broadcast(state)
        made = cut_lineage(rows.filter(turn == k).mapInArrow(_round(shared_head, shared, counts, p), schema))
        some = made.mapInArrow(_average, schema).repartition(_PARTS).mapInArrow(_average, schema).toArrow()
        release(made)
        for batch in _average(iter(some.to_batches())):
            state = np.frombuffer(batch.column("weights")[0].as_buffer(), np.float32)
        shared.unpersist()
    m = Gru(counts, p)
    Descent(m, p, state)  # unpacks the weights into the model
    return m


# --- scoring ------------------------------------------------------------------------------

def _symbols(head: Head, piece: W.Slice) -> tuple[W.Words, np.ndarray, np.ndarray]:
    found = W.words(piece, W.SPACED)
    at = head.find(found.hashes)
    return found, at, np.where(at >= 0, head.symbol[at], RARE) if len(head.hash) else np.full(len(at), RARE)


_PART = [("n_tokens", "bigint"), ("known", "bigint"), ("head_log", "double"), ("model_log", "double"),
         ("n_rare", "bigint"), ("rare_log", "double"), ("tail", "array<struct<word:bigint,n:bigint>>")]
#: documents whose states are in memory side by side
_SIDE_BY_SIDE = 4096


def _scorer(shared_head, shared_model, end_log: float, end_known: int, columns: list[str]):
    tail_type = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))

    def score_part(part: pa.RecordBatch) -> pa.RecordBatch:
        head: Head = shared_head.value
        n = part.num_rows
        tokens, known = np.ones(n, np.int64), np.full(n, end_known, np.int64)
        head_log, n_rare, rare_log = np.full(n, end_log), np.zeros(n, np.int64), np.zeros(n)
        sequences, words_out, n_out, tail_first = [], [], [], [np.zeros(1, np.int64)]
        for piece in W.slices(part.column("__text")):
            found, at, symbol = _symbols(head, piece)
            row, rows = found.rows(), slice(piece.first_row, piece.first_row + piece.n_rows)
            in_head, rare = at >= 0, symbol == RARE

            def total(mask, weight=None, row=row, m=piece.n_rows):
                return np.bincount(row[mask], weights=None if weight is None else weight[mask], minlength=m)

            logs = np.where(in_head, head.log[at], 0.0) if len(head.hash) else np.zeros(len(at))
            tokens[rows] += np.diff(found.row_first)
            known[rows] += total(in_head)
            head_log[rows] += total(in_head, logs)
            n_rare[rows] = total(rare)
            rare_log[rows] = total(in_head & rare, logs)
            cut = found.row_first
            sequences += [symbol[cut[r]:cut[r + 1]] for r in range(piece.n_rows)]
            out = np.flatnonzero(~in_head)
            order = np.lexsort((found.hashes[out], row[out]))
            h, r = found.hashes[out][order].view(np.int64), row[out][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            first = np.flatnonzero(new)
            words_out.append(h[first])
            n_out.append(np.diff(np.append(first, len(h))))
            tail_first.append(np.bincount(r[first], minlength=piece.n_rows))
        off = pa.array(np.cumsum(np.concatenate(tail_first)).astype(np.int32), pa.int32())
        both = pa.StructArray.from_arrays([pa.array(np.concatenate(words_out)), pa.array(np.concatenate(n_out).astype(np.int64))],
                                          fields=list(tail_type.value_type))
        tail = pa.ListArray.from_arrays(off, both)
        model_log = shared_model.value.score(sequences)
        return pa.RecordBatch.from_arrays(
            [part.column(c) for c in columns]
            + [pa.array(tokens), pa.array(known), pa.array(head_log), pa.array(model_log), pa.array(n_rare), pa.array(rare_log), tail],
            [*columns, *(name for name, _ in _PART)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _SIDE_BY_SIDE):
                yield score_part(batch.slice(lo, _SIDE_BY_SIDE))
    return run


def score(documents: DataFrame, training: DataFrame, text: str = "text",
          keep: list[str] | None = None, params: LmParams | None = None) -> DataFrame:
    """Score every whole text of ``documents`` by a model of ``training`` (same columns).

    Returns ``keep`` (all columns but the text by default), n_tokens, n_known, train_tokens,
    base_score (log10 of smoothed unigram probabilities) and score (log10 probability by the
    model).
    """
    p = params or LmParams()
    spark = documents.sparkSession
    counts = cut_lineage(word_counts(training, text))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = counts.filter(F.col("word") == END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top_hash, top_n = most_frequent(counts.filter(F.col("word") != END_HASH), p.head)
    head = Head(top_hash, top_n, p.vocabulary)
    n_own = min(p.vocabulary, len(top_hash))
    rare_total = int(total - n_docs - top_n[:n_own].sum())
    rare_distinct = int(distinct - bool(n_docs) - n_own)
    shared_head = spark.sparkContext.broadcast(head)
    model = fit(training, shared_head, np.concatenate([[n_docs, rare_total], top_n[:n_own]]).astype(np.float64), text, p)
    shared_model = spark.sparkContext.broadcast(model)

    new = [name for name, _ in _PART]
    keep = [c for c in ([c for c in documents.columns if c != text] if keep is None else keep) if c not in new]
    rows = documents.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([rows.schema[c] for c in keep]
                          + [T.StructField(n, T._parse_datatype_string(t)) for n, t in _PART])
    part = rows.mapInArrow(_scorer(shared_head, shared_model, float(np.log10(n_docs + 0.5)), int(n_docs > 0), keep), schema)
    part = cut_lineage(part.withColumn("__row", F.monotonically_increasing_id()))
    each = part.select("__row", F.explode("tail").alias("t")).select("__row", "t.word", F.col("t.n").alias("times"))
    seen = counts.select(F.col("word").alias("w"), "n")
    met = each.join(seen, F.col("word") == F.col("w"), "left")
    tails = met.groupBy("__row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("tail_log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(F.lit(0))).alias("tail_known"))
    joined = part.drop("tail").join(tails, "__row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("head_log") + tail_log - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))
    by_model = (F.col("model_log") + F.col("rare_log") + tail_log
                - F.col("n_rare") * float(np.log10(rare_total + 0.5 * (rare_distinct + 1))))
    return joined.select(*keep, "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
                         F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), by_model.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op7: scores of all documents by a model of those outside fold 1 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = in_fold(F.col("doc_id"), 1, 5)
    return score(docs.withColumn("held_out", held), docs.filter(~held), keep=["doc_id", "held_out"])
