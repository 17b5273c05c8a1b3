"""Byte-level BPE token ids with a cache of pieces.

Texts are cut before each run of white space; no token of the vocabulary's pattern reaches over such a cut, so each piece is
tokenised once and remembered. The vocabulary is a tiktoken rank file whose path is a parameter.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import cache

import numpy as np

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern's engine sees it; Python's own class has four controls more.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Pieces remembered by each of the two caches before it starts anew.
CACHED = 400_000


_ENDINGS = ".,;:!?"


class _Remembered(dict):
    """What ``make`` gives for a piece, remembered; word and closing punctuation are looked up apart, as the pattern cuts between them."""

    def __init__(self, whole, word):
        super().__init__()
        self.whole, self.word = whole, word

    def __missing__(self, piece: str):
        if len(self) >= CACHED:
            self.clear()
        letters = piece[1:] if piece[0] == " " else piece
        if letters.isalpha():
            value = self.word(piece.encode())
        else:
            body = piece.rstrip(_ENDINGS)
            if body and body != piece and (body[1:] if body[0] == " " else body).isalpha():
                value = self[body] + self[piece[len(body) :]]
            else:
                value = self.whole(piece)
        if len(piece) <= 64:
            self[piece] = value
        return value


class Tokenizer:
    """ids(text) and count(text) by one vocabulary."""

    def __init__(self, path: str):
        import tiktoken  # here, so that only what tokenises needs it

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        plain, one = self.encoding.encode_ordinary, self.encoding._encode_single_piece
        self._ids = _Remembered(lambda piece: array("I", plain(piece)).tobytes(), lambda piece: array("I", one(piece)).tobytes())
        self._counts = _Remembered(lambda piece: len(plain(piece)), lambda piece: len(one(piece)))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._ids.__getitem__, _PIECE.findall(text or ""))), np.uint32)

    def count(self, text: str | None) -> int:
        return sum(map(self._counts.__getitem__, _PIECE.findall(text or "")))


@cache
def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    """One tokenizer per process and path."""
    return Tokenizer(path)
