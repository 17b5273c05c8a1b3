"""Token ids as directly addressable codes (Brisaboa, Ladra, Navarro 2009).

Level 0 holds the lowest ``bits`` bits of every id; a bitmap beside it tells which ids go on to level 1, which holds the next
bits of those, and so on. Each bitmap has a directory of ranks, so that any token is found by one rank per level and no
other token is decoded.

Layout (little endian): 'D', version 1, bits, levels, u32 ids; then for each level u32 count, the chunks packed to whole bytes,
and, but for the last level, the bitmap (bytes, first id in the lowest bit) and a u32 rank before each BLOCK bits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import map_batches, table
from sheaf.llm.tokens import VOCABULARY, tokenizer
from sheaf.llm.words import slices

BITS = 8
BLOCK = 512


def _pack(chunks: np.ndarray, bits: int) -> bytes:
    if bits == 8:
        return chunks.astype(np.uint8).tobytes()
    planes = (chunks[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(ids: np.ndarray, bits: int = BITS) -> bytes:
    """The code of a sequence of ids below 2**32."""
    if not 1 <= bits <= 32:
        raise ValueError("bits must be from 1 to 32")
    rest = np.asarray(ids, np.uint64)
    out, levels = [], 0
    n = len(rest)
    while levels == 0 or len(rest):
        levels += 1
        chunk, rest = (rest & np.uint64((1 << bits) - 1)).astype(np.uint32), rest >> np.uint64(bits)
        more = rest > 0
        out.append(struct.pack("<I", len(chunk)) + _pack(chunk, bits))
        if more.any():
            bitmap = np.packbits(more, bitorder="little")
            sums = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.uint32)
            out.append(bitmap.tobytes() + (np.cumsum(sums, dtype=np.uint32) - sums).astype("<u4").tobytes())
        rest = rest[more]
    return struct.pack("<cBBBI", b"D", 1, bits, levels, n) + b"".join(out)


class Codes:
    """Random access to a code: ``codes[i]`` and ``len(codes)``; ``all()`` decodes everything."""

    def __init__(self, blob: bytes):
        mark, version, self.bits, levels, self.n = struct.unpack_from("<cBBBI", blob)
        if mark != b"D" or version != 1:
            raise ValueError("not a directly addressable code")
        self.blob, self.levels, at = blob, [], 8
        for k in range(levels):
            (count,) = struct.unpack_from("<I", blob, at)
            chunks = at + 4
            bitmap = chunks + (count * self.bits + 7) // 8
            ranks = bitmap + (count + 7) // 8
            self.levels.append((count, chunks, bitmap, ranks))
            at = bitmap if k == levels - 1 else ranks + 4 * ((count + BLOCK - 1) // BLOCK)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if i < 0:
            i += self.n
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, bitmap, ranks) in enumerate(self.levels):
            first = i * self.bits
            raw = int.from_bytes(self.blob[chunks + first // 8 : chunks + (first + self.bits + 7) // 8], "little")
            value |= (raw >> first % 8 & (1 << self.bits) - 1) << (self.bits * k)
            if k == len(self.levels) - 1 or not self.blob[bitmap + i // 8] >> i % 8 & 1:
                break
            block = i // BLOCK
            (rank,) = struct.unpack_from("<I", self.blob, ranks + 4 * block)
            lo = block * BLOCK // 8
            part = int.from_bytes(self.blob[bitmap + lo : bitmap + i // 8 + 1], "little")
            i = rank + (part & (1 << i - block * BLOCK) - 1).bit_count()
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint64)
        where = np.arange(self.n)
        for k, (count, chunks, bitmap, _) in enumerate(self.levels):
            bits = np.unpackbits(np.frombuffer(self.blob, np.uint8, (count * self.bits + 7) // 8, chunks), bitorder="little", count=count * self.bits)
            values = (bits.reshape(count, self.bits).astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
            out[where] |= values << np.uint64(self.bits * k)
            if k < len(self.levels) - 1:
                where = where[np.unpackbits(np.frombuffer(self.blob, np.uint8, (count + 7) // 8, bitmap), bitorder="little", count=count).astype(bool)]
        return out.astype(np.uint32)


def token_codes(docs: DataFrame, vocabulary: str = VOCABULARY, bits: int = BITS) -> DataFrame:
    """(doc_id, n_tokens, codes), one row for each row of ``docs``.

    A null or empty text has 0 tokens and the code of none; very long texts are coded whole; a null doc_id stays null; repeated rows are coded each;
    other columns don't matter; an empty table gives none.
    """

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        own = tokenizer(vocabulary)
        for part in slices(batch):
            ids = [own.ids(t) for t in part.column("text").to_pylist()]
            yield {"doc_id": part.column("doc_id"), "n_tokens": np.fromiter(map(len, ids), np.int64, len(ids)), "codes": [encode(x, bits) for x in ids]}

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, work, "doc_id bigint, n_tokens bigint, codes binary")


def op6_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes(table(spark, sf_dir, "documents"))
