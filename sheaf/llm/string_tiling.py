"""Benchmark decontamination by greedy string tiling.

Runs of ``LEAST`` words of the benchmark items, hashed by Karp-Rabin, are looked up in each document's rolling hashes; where an
item shares a seed with a document the two are tiled: the longest common run of unmarked words is marked, again and again,
down to ``LEAST`` words. An item whose words are tiled to at least ``COVERAGE`` is a leak, in whatever order its passages come.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import filter_rows, map_batches, table, texts
from sheaf.llm.words import grams, slices, words
from sheaf.session import materialize

LEAST = 4
COVERAGE = 0.5
#: Words of benchmark text that one broadcast may hold; a larger benchmark is taken in as many passes as that needs.
BROADCAST_WORDS = 4_000_000


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST, seeds: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of the tiles, longest first; equal lengths by item, then document position.

    seeds: positions (i, j) of equal ``least``-grams, if known.
    """
    if seeds is None:
        seeds = _matches(grams(item, least), grams(doc, least))
    i, j = seeds
    if not len(i):
        return []
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(i))) + least - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(size, i[head], j[head], strict=True)]
    heapq.heapify(heap)
    free_item, free_doc = bytearray(b"\1" * len(item)), bytearray(b"\1" * len(doc))
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        if 0 not in free_item[a : a + n] and 0 not in free_doc[b : b + n]:
            free_item[a : a + n] = free_doc[b : b + n] = bytes(n)
            out.append((a, b, n))
            continue
        run = 0
        for k in range(n + 1):  # what is left of it, cut where words are marked
            if k < n and free_item[a + k] and free_doc[b + k]:
                run += 1
            else:
                if run >= least:
                    heapq.heappush(heap, (-run, a + k - run, b + k - run))
                run = 0
    return out


def _matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with a[i] == b[j]."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(a)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return i, order[at]


@dataclass
class Seeds:
    """Sorted seed hashes of some items, the items that have each, and a bit table that rules most other hashes out."""

    least: int
    ids: np.ndarray
    hashes: list[np.ndarray]
    keys: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    bits: np.ndarray
    shift: np.uint64

    @classmethod
    def build(cls, rows: list[tuple[int, str]], least: int) -> Seeds:
        found = words(pa.array([t for _, t in rows], pa.large_string()))
        hashes = [found.of(i) for i in range(len(rows))]
        seeds = [np.unique(grams(h, least)) for h in hashes]
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in seeds])
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        size = max(16, math.ceil(math.log2(len(keys) * 32 + 1)))
        shift = np.uint64(64 - size)
        bits = np.zeros(1 << size, bool)
        bits[keys >> shift] = True
        return cls(least, np.array([i for i, _ in rows], np.int64), hashes, keys, np.append(first, len(flat)), owner[order], bits, shift)

    def leaks(self, column: pa.Array, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text number, item_id, coverage, tiles, longest tile) for each leaked item of each text."""
        found = words(column)
        if not len(self.keys):
            return
        rolling = grams(found.hashes, self.least)
        maybe = np.flatnonzero(self.bits[rolling >> self.shift])
        at = np.searchsorted(self.keys, rolling[maybe])
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == rolling[maybe][hit]
        maybe, at = maybe[hit], at[hit]
        text = np.searchsorted(found.first, maybe, side="right") - 1
        inside = maybe + self.least <= found.first[text + 1]
        maybe, at, text = maybe[inside], at[inside], text[inside]
        for t in np.unique(text):
            mine = text == t
            j, key = maybe[mine] - found.first[t], at[mine]
            n = self.first[key + 1] - self.first[key]
            items = self.owners[np.repeat(self.first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            where = np.repeat(j, n)
            doc = found.of(t)
            rolled = grams(doc, self.least)
            order = np.argsort(items, kind="stable")
            items, where = items[order], where[order]
            cut = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1], [True]]))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                k = int(items[lo])
                item, spots = self.hashes[k], np.sort(where[lo:hi])
                # seeds that occur in the document cover at most this much of the item
                i, p = _matches(grams(item, self.least), rolled[spots])
                covered = np.zeros(len(item) + 1, np.int64)
                starts = np.unique(i)
                np.add.at(covered, starts, 1)
                np.add.at(covered, starts + self.least, -1)
                if (np.cumsum(covered) > 0).sum() < coverage * len(item):
                    continue
                tiled = tiles(item, doc, self.least, (i, spots[p]))
                share = sum(x[2] for x in tiled) / len(item)
                if share >= coverage:
                    yield int(t), int(self.ids[k]), share, len(tiled), tiled[0][2]


def _passes(benchmark: DataFrame, least: int, limit: int) -> Iterator[tuple[int, Seeds]]:
    """(number of passes, seeds) of the whole benchmark, in parts of at most about ``limit`` words each, built when they are asked for."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / (6 * limit)))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield parts, Seeds.build([(r["item_id"], r["text"]) for r in rows], least)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, limit: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile) of every leaked item of every document.

    Items of fewer than ``least`` words and null texts leak nowhere; very long texts are tiled whole; rows with a null doc_id or item_id
    are left out; rows that repeat an id count once, with their highest coverage; other columns don't matter; empty tables give none.
    """
    result = None
    for parts, part in _passes(benchmark, least, limit):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def work(batch: pa.RecordBatch, shared=shared) -> Iterator[dict]:
            for piece in slices(batch):
                ids = piece.column("doc_id").to_pylist()
                rows = [(ids[t], item, round(share, 6), n, longest) for t, item, share, n, longest in shared.value.leaks(piece.column("text"), coverage)]
                if rows:
                    yield dict(zip(("doc_id", "item_id", "coverage", "n_tiles", "longest_tile"), map(list, zip(*rows, strict=True)), strict=True))

        one = map_batches(texts(docs), work, "doc_id bigint, item_id bigint, coverage double, n_tiles int, longest_tile int")
        if parts > 1:  # one part's seeds at a time
            one = materialize(one, "leaks")
            shared.destroy()
        result = one if result is None else result.unionByName(one)
    best = F.max(F.struct("coverage", "longest_tile", (-F.col("n_tiles")).alias("n"))).alias("best")
    return result.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.coverage", (-F.col("best.n")).alias("n_tiles"), "best.longest_tile")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, limit: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, columns unchanged; nothing is shuffled.

    Null and empty texts stay, rows without doc_id are judged by their text, repeated rows stay or go together; very long texts are
    tiled whole; an empty benchmark keeps all, an empty table gives none.
    """
    for parts, part in _passes(benchmark, least, limit):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def keep(batch: pa.RecordBatch, shared=shared) -> np.ndarray:
            masks = []
            for piece in slices(batch):
                mask = np.ones(piece.num_rows, bool)
                mask[[t for t, *_ in shared.value.leaks(piece.column("text"), coverage)]] = False
                masks.append(mask)
            return np.concatenate(masks)

        docs = filter_rows(docs, keep)
        if parts > 1:
            docs = materialize(docs, "clean")
            shared.destroy()
    return docs


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
