"""Token counts of whole texts with a byte-level BPE vocabulary (operator 13).

Before a text is seen, it is proved for every string of the vocabulary whether it encodes
alone as one token: merges can build it, and it is a whole number of characters (others are
never a pre-token). A pre-token is encoded by itself, so one that equals such a string is one
token and needs no merging. A task cuts a slice of texts into pre-tokens with numpy, hashes
them and looks them up; only the others are merged, each different one once for some time.

Pre-tokens are runs of letters, of numbers or of other marks, each with one blank before it
if there is one, the endings 's 't 're 've 'm 'll 'd, and white space. What counts as a
letter, number or white space depends on the library's version of Unicode, so a task asks
the library itself about each character it meets for the first time.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of added tokens
inside a text are one token each, as the library has it by default. No text is cut, every
row of ``documents`` is a row of the result, repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm import vocab as V
from graphweft.llm import words as W

OTHER, LETTER, NUMBER, WHITE, BLANK = range(5)
UNKNOWN = 255


@dataclass(frozen=True)
class TokenParams:
    """``tokenizer`` is a path, or the name of a public tokenizer. ``limit`` tokens are still
    within the limit. ``remembered`` merge results at most are kept by a task at a time."""

    tokenizer: str = "byte_bpe_50k.json"
    limit: int = 1024
    remembered: int = 1 << 18


@dataclass(frozen=True)
class Shortcut:
    """Strings that encode alone as one token, by their hash (sorted), and their lengths."""

    hashes: np.ndarray
    lengths: np.ndarray

    def has(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return (self.hashes[at] == hashes) & (self.lengths[at] == lengths)


def _checked(raw: bytes) -> dict:
    """The file's contents, if it is a plain byte-level BPE vocabulary."""
    spec = json.loads(raw)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
             and not spec["normalizer"] and model["type"] == "BPE" and not model["dropout"]
             and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
    if not plain:
        raise ValueError("only byte-level BPE vocabularies with their usual pre-tokenizer are counted")
    return spec


def prove(raw: bytes) -> Shortcut:
    """Merge every vocabulary string alone; those that end as one token are the shortcut."""
    _checked(raw)
    model = V.byte_level_tokenizer(raw, special=False).model
    symbol = V.byte_symbols()
    whole = []
    for token in V.byte_level_tokens(raw):
        try:
            token.decode()
        except (UnicodeDecodeError, AttributeError):  # part of a character, or no string
            continue
        if len(model.tokenize("".join(symbol[b] for b in token))) == 1:
            whole.append(token)
    ends = np.cumsum([len(t) for t in whole])
    starts = np.concatenate([[0], ends[:-1]])
    hashes = W.span_hashes(np.frombuffer(b"".join(whole), np.uint8), starts, ends)
    order = np.argsort(hashes)
    return Shortcut(hashes[order], (ends - starts)[order])


class PreTokens:
    """Cuts texts into pre-tokens."""

    def __init__(self, tokenizer):
        self._ask = tokenizer.pre_tokenizer.pre_tokenize_str
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[0x20] = BLANK

    def _begins(self, code: np.ndarray, after: str) -> np.ndarray:
        """For each character c, whether a pre-token begins at c and behind c in ``a c after``."""
        text = "\n".join("a" + chr(c) + after for c in code.tolist())
        begin = np.zeros(len(text) + 1, bool)
        begin[[span[0] for _, span in self._ask(text)]] = True
        at = np.arange(len(code)) * 4 + 1
        return np.stack([begin[at], begin[at + 1]])

    def kinds(self, code: np.ndarray) -> np.ndarray:
        found = self.kind[code]
        if (found == UNKNOWN).any():
            new = np.unique(code[found == UNKNOWN])
            (at, behind), (_, behind_mark) = self._begins(new, "1"), self._begins(new, "!")
            self.kind[new] = np.where(~at, LETTER, np.where(~behind, NUMBER, np.where(behind_mark, WHITE, OTHER)))
            found = self.kind[code]
        return found

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans (starts, ends) of the pre-tokens of UTF-8 texts that begin at
        ``offsets`` (the last offset ends the last text)."""
        place = np.flatnonzero((data & 0xC0) != 0x80)  # byte where each character begins
        if not len(place):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(code)
        kind = self.kinds(code)
        white = kind >= WHITE
        edge = np.zeros(n + 2, bool)  # a text begins here
        edge[np.searchsorted(place, offsets)] = True
        group = np.where(white, WHITE, kind)
        start = edge[:n].copy()
        start[1:] |= group[1:] != group[:-1]
        run = start.copy()
        # the last of some white space before a mark stands alone, or joins the mark if it is a blank
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:n])
        start[last] = True
        start[last[kind[last] == BLANK] + 1] = False
        # endings: a lone apostrophe that no blank precedes, and one or two letters
        mark = np.flatnonzero((code == ord("'")) & start)
        mark = mark[mark + 1 < n]
        mark = mark[(kind[mark + 1] == LETTER) & ~edge[mark + 1] & run[mark + 1]]
        one = code[mark + 1]
        two = code[np.minimum(mark + 2, n - 1)]
        two = np.where((mark + 2 < n) & ~edge[mark + 2], two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[mark[short | long] + 1] = False
        behind = np.concatenate([mark[short] + 2, mark[long] + 3])
        start[behind[behind < n]] = True
        starts = place[start]
        return starts, np.append(starts[1:], len(data))


def _segments(piece: W.Slice, special: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slice cut at the strings of added tokens: offsets, row and whether it is one."""
    rows = np.arange(piece.n_rows)
    if special is None:
        return piece.offsets, rows, np.zeros(piece.n_rows, bool)
    raw, offsets = piece.data.tobytes(), piece.offsets
    hits = [m.span() for m in special.finditer(raw)]
    if not hits:
        return offsets, rows, np.zeros(piece.n_rows, bool)
    # an occurrence may not reach over the border of two texts: look again row by row
    hits = [m.span() for r in range(piece.n_rows) for m in special.finditer(raw, int(offsets[r]), int(offsets[r + 1]))]
    inner = np.array(hits, np.int64).reshape(-1)
    bounds = np.unique(np.concatenate([offsets, inner]))
    is_special = np.isin(bounds[:-1], inner[::2])
    return bounds, np.searchsorted(offsets, bounds[:-1], "right") - 1, is_special


def _counter(raw: bytes, shortcut: Shortcut, columns: list[str], p: TokenParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = V.byte_level_tokenizer(raw, special=True)
        cutter, model, symbol = PreTokens(tokenizer), tokenizer.model, V.byte_symbols()
        added = sorted((t["content"].encode() for t in _checked(raw)["added_tokens"]), key=len, reverse=True)
        special = re.compile(b"|".join(map(re.escape, added))) if added else None
        merged: dict[int, int] = {}

        def merge(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            if len(merged) > p.remembered:
                merged.clear()
            each, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            n = np.empty(len(each), np.int64)
            for k, (h, at) in enumerate(zip(each.tolist(), first.tolist(), strict=True)):
                known = merged.get(h)
                if known is None:
                    known = merged[h] = len(model.tokenize("".join([symbol[b] for b in data[starts[at]:ends[at]].tobytes()])))
                n[k] = known
            return n[back]

        for batch in batches:
            tokens, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for piece in W.slices(batch.column("__text")):
                own = slice(piece.first_row, piece.first_row + piece.n_rows)
                size[own] = np.diff(piece.offsets)
                bounds, row, is_special = _segments(piece, special)
                starts, ends = cutter.cut(piece.data, bounds)
                segment = np.searchsorted(bounds, starts, "right") - 1
                plain = ~is_special[segment]
                starts, ends, of = starts[plain], ends[plain], row[segment[plain]]
                hashes = W.span_hashes(piece.data, starts, ends)
                n = np.ones(len(starts), np.int64)
                rest = np.flatnonzero(~shortcut.has(hashes, ends - starts))
                if len(rest):
                    n[rest] = merge(piece.data, starts[rest], ends[rest], hashes[rest])
                tokens[own] = np.bincount(of, n, piece.n_rows).astype(np.int64)
                tokens[own] += np.bincount(row[is_special], minlength=piece.n_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(size), pa.array(tokens), pa.array(tokens > p.limit)],
                [*columns, "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(documents: DataFrame, text: str = "text", keep: list[str] | None = None,
                 params: TokenParams | None = None) -> DataFrame:
    """n_bytes, n_tokens and over_limit of every whole text, next to the columns ``keep`` (all
    but the text by default, and but those with names of the result)."""
    p = params or TokenParams()
    new = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in (documents.columns if keep is None else keep) if c not in (*new, *([] if keep else [text]))]
    raw = V.read(p.tokenizer)
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([rows.schema[c] for c in keep] + [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType())])
    return rows.mapInArrow(_counter(raw, prove(raw), keep, p), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op13: token counts of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
