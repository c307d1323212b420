"""Word spans and word hashes of whole text columns, vectorised over Arrow buffers.

The text operators run inside ``mapInArrow`` tasks. They read the UTF-8 bytes of an Arrow
string column as one numpy array and work on all rows of a slice at once; no text is copied
into Python strings, and no text is cut: a slice holds whole texts only, and a text that is
longer than a slice is hashed in segments that end between words.

Words are identified by a 64-bit hash (polynomial over a random byte table, finalised by
the splitmix64 mixer). Two different words of a corpus with 10^7 distinct words share a
hash with probability below 10^-5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: bytes of text that one numpy pass takes (a longer text is a slice of its own)
SLICE_BYTES = 1 << 19

#: A-Z to a-z, all other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(word_byte) -> np.ndarray:
    return np.array([word_byte(b) for b in range(256)], dtype=bool)


#: bytes of words ``[^\x20\x09-\x0D]+``
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (on lower-cased text: digits, a-z, non-ASCII)
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_BYTE_CODE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the polynomial base and of its inverse modulo 2^64."""
    if len(_powers["up"]) <= n:
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (uint64 in, uint64 out)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Slice:
    """Some consecutive rows of a batch: bytes of all their texts, and where each begins."""

    first_row: int
    n_rows: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, n_rows + 1


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut an Arrow string column into slices of whole texts (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), n)
        lo, hi = offsets[row], offsets[end]
        yield Slice(row, end - row, raw[lo:hi], offsets[row:end + 1] - lo)
        row = end


@dataclass
class Words:
    """Words of a slice in order: byte spans, 64-bit hashes, and each row's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    row_first: np.ndarray  # int64, n_rows + 1: word index where each row begins

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.row_first) - 1), np.diff(self.row_first))


def spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans (start, end) of maximal runs of ``word_bytes`` that stay within a row."""
    inside = word_bytes[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; spans must be in order (they may share bytes)."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, base + SLICE_BYTES)))
        top = int(ends[lo:hi].max())
        up, down = _power_tables(top - base)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data[base:top]] * up[:top - base], out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        h = (sums[e] - sums[s]) * down[s]
        out[lo:hi] = mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def words(piece: Slice, word_bytes: np.ndarray, lower: bool = True) -> Words:
    """All words of a slice with their hashes (A-Z lower-cased first unless told not to)."""
    data = LOWER[piece.data] if lower else piece.data
    starts, ends = spans(data, piece.offsets, word_bytes)
    return Words(starts, ends, span_hashes(data, starts, ends),
                 np.searchsorted(starts, piece.offsets, side="left"))


def word_hash(word: str) -> int:
    """Hash of one word, as ``words`` gives it (lower-case it first)."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words, and the row of each.

    A row with fewer words, but at least one, gives its whole word sequence as one shingle;
    a row without words gives none. Hashes of whole short sequences and of shingles differ
    by their length, so they never meet by accident.
    """
    n_words = np.diff(found.row_first)
    h = found.hashes
    whole = np.flatnonzero((n_words > 0) & (n_words < size))
    parts, rows = [], []
    if len(h) >= size:
        acc = h[:len(h) - size + 1].copy()
        for k in range(1, size):
            acc = mix(acc * np.uint64(3) + h[k:len(h) - size + 1 + k])
        row = found.rows()
        keep = row[:len(acc)] == row[size - 1:]
        parts.append(acc[keep])
        rows.append(row[:len(acc)][keep])
    for r in whole:
        acc = np.array([n_words[r]], np.uint64)
        for x in h[found.row_first[r]:found.row_first[r + 1]]:
            acc = mix(acc * np.uint64(5) + x)
        parts.append(acc)
        rows.append(np.array([r]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts, rows = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return parts[order], rows[order]
