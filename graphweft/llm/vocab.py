"""Vocabularies of trained tokenizers, as bytes of each token (helper of operators 12 and 13).

The files are read once on the driver and travel with the tasks; their size is fixed.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: the byte's own
    where Latin-1 prints it, else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def read(name_or_path: str) -> bytes:
    """A tokenizer file by its path, or by its name among the public ones."""
    path = Path(name_or_path)
    return (path if path.is_absolute() else Path(public_tokenizers.path(name_or_path))).read_bytes()


def byte_level_tokens(raw: bytes) -> list[bytes | None]:
    """Bytes of each id of a byte-level vocabulary (None where an id is free or special)."""
    spec = json.loads(raw)
    code = {s: b for b, s in enumerate(byte_symbols())}
    vocab = spec["model"]["vocab"]
    out: list[bytes | None] = [None] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
    special = {t["id"] for t in spec["added_tokens"]}
    for piece, k in vocab.items():
        if k not in special:
            out[k] = bytes(code[c] for c in piece)
    return out


def piece_tokens(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of each id of a piece vocabulary: U+2581 is a space, byte pieces are their byte."""
    def one(k: int) -> bytes:
        piece = model.id_to_piece(k)
        return bytes([int(piece[3:-1], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()
    return [one(k) for k in range(model.vocab_size())]


def byte_level_tokenizer(raw: bytes, special: bool) -> Tokenizer:
    """The library's tokenizer; ``special`` says whether strings of special tokens inside a
    text become these tokens."""
    made = Tokenizer.from_str(raw.decode())
    made.no_truncation()
    made.no_padding()
    made.encode_special_tokens = not special
    return made


def piece_tokenizer(raw: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=raw)


def lengths(tokens: list[bytes | None]) -> np.ndarray:
    return np.array([len(t) if t else 0 for t in tokens], np.int64)
