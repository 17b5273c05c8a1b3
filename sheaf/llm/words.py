"""Words of many texts at once: byte positions, 64-bit hashes and k-gram hashes, computed on whole Arrow buffers.

A word is a longest run of ASCII letters, digits or bytes above 127, after lower-casing; everything else
separates, so punctuation and case don't count. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_KBASE = np.uint64(0xC2B2AE3D27D4EB4F)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_LETTER = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text worked on at once; a longer single text is its own slice.
SLICE_BYTES = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 8 * SLICE_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """hashes of all words; those of text i are hashes[first[i]:first[i + 1]]; start and end are bytes in the slice."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    base: np.ndarray  # byte at which each text starts

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def words(texts: pa.Array) -> Words:
    """Words of an Arrow array of strings."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    offsets = offsets - lo
    if hi == lo:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), none, none, offsets[:-1])
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
    inside = _IS_WORD[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    n = len(raw)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LETTER[raw] * _powers(_BASE, n), out=total[1:])
    hashes = mix((total[end] - total[start]) * _powers(_INVERSE, n + 1)[start])
    return Words(hashes, np.searchsorted(start, offsets), start, end, offsets[:-1])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of one text, or of a whole slice."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 6:
        out = hashes[:n].copy()
        for j in range(1, k):
            out = out * _KBASE + hashes[j : j + n]
        return mix(out)
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * _powers(_BASE, len(hashes)), out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(_INVERSE, n))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about SLICE_BYTES of text, so that work arrays stay small."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to
