"""Bounded-space online best-fit packing of documents into training windows.

Documents come in the order of doc_id. The sequence is cut into shards of about ``SHARD`` tokens by the tokens that lie before each
document, so neither the ids' density nor Spark's partitions matter. Each shard keeps at most ``OPEN`` open bins, whose free spaces are the bits of one integer: the best fit is
its lowest bit at or above the size. Where none fits and no bin may be added, the fullest closes first.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.common import map_batches, table, texts
from sheaf.llm.tokens import VOCABULARY, tokenizer
from sheaf.llm.words import slices
from sheaf.session import discard, materialize

CAPACITY = 2048
OPEN = 64
#: Tokens of a shard, which one task packs: 8192 full windows, so the at most 64 that a shard leaves open are under 1 %.
SHARD = 1 << 24


class Packer:
    """Online packing of one sequence of sizes; ``place`` gives (bin, offset) and never moves what it placed."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.by_free: dict[int, deque[int]] = {}
        self.open, self.bins = 0, 0

    def _take(self, free: int) -> int:
        line = self.by_free[free]
        bin_ = line.popleft()  # of equally full bins the one that got there first
        if not line:
            self.free &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, size: int) -> tuple[int, int]:
        if not 0 < size <= self.capacity:
            raise ValueError("size must be from 1 to the capacity")
        fits = self.free >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if size < self.capacity and self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # closes the fullest
            free, bin_ = self.capacity, self.bins
            self.bins += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, deque()).append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.capacity - free


def pack_sizes(rows: Iterable[tuple[int, int]], capacity: int = CAPACITY, open_bins: int = OPEN) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(doc_id, piece, start, tokens, bin, offset) for (doc_id, tokens) in order; a document longer than a bin comes in pieces, full ones first."""
    packer = Packer(capacity, open_bins)
    for doc, n in rows:
        for piece, start in enumerate(range(0, n, capacity)):
            size = min(capacity, n - start)
            yield doc, piece, start, size, *packer.place(size)


def sizes(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document with a doc_id."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        own = tokenizer(vocabulary)
        for part in slices(batch):
            yield {"doc_id": part.column("doc_id"), "n_tokens": np.fromiter(map(own.count, part.column("text").to_pylist()), np.int64, part.num_rows)}

    return map_batches(texts(docs), work, "doc_id bigint, n_tokens bigint")


def before(sized: DataFrame) -> DataFrame:
    """``sized`` (doc_id, n_tokens) with ``before``: the tokens of all rows before each, by doc_id and n_tokens.

    As many ranges of doc_id as the session has shuffle partitions are cut; their totals go through the driver, and inside a range a
    window sums. Rows that are equal in both columns are told apart by where they were written and may change places, which no result shows.
    """
    spark = sized.sparkSession
    written = materialize(sized.withColumn("nth", F.monotonically_increasing_id()), "sizes")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(written.repartitionByRange(ranges, "doc_id", "n_tokens", "nth").withColumn("part", F.spark_partition_id()), "size-ranges")
    discard(written)
    totals = sorted((r["part"], r["n"]) for r in cut.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    offsets = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(totals, starts, strict=False)], "part int, start bigint")
    line = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "nth").rowsBetween(Window.unboundedPreceding, -1)
    within = cut.withColumn("within", F.coalesce(F.sum("n_tokens").over(line), F.lit(0)))
    return within.join(F.broadcast(offsets), "part").select("doc_id", "n_tokens", (F.col("start") + F.col("within")).alias("before"))


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN, shard: int = SHARD, vocabulary: str = VOCABULARY) -> DataFrame:
    """(shard, bin, offset, doc_id, piece, start, n_tokens): where each piece of each document goes.

    A shard holds the documents before which as many whole ``shard`` tokens lie. Documents without tokens (null and empty texts) and
    rows without doc_id take no place; a very long text comes in as many pieces as it fills bins; rows that repeat a doc_id are placed
    each, the shorter first; other columns don't matter; an empty table gives none.
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, packer_rows = None, None
        packer: Packer | None = None
        for pdf in parts:
            packer_rows = []
            for key, doc, n in zip(pdf["shard"].tolist(), pdf["doc_id"].tolist(), pdf["n_tokens"].tolist(), strict=True):
                if packer is None or key != current:
                    current, packer = key, Packer(capacity, open_bins)
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    packer_rows.append((key, *packer.place(size), doc, piece, start, size))
            yield pd.DataFrame(packer_rows, columns=["shard", "bin", "offset", "doc_id", "piece", "start", "n_tokens"])

    schema = "shard bigint, bin bigint, offset bigint, doc_id bigint, piece bigint, start bigint, n_tokens bigint"
    placed = before(sizes(docs, vocabulary).where("n_tokens > 0")).withColumn("shard", F.expr(f"before div {int(shard)}"))
    return placed.repartition("shard").sortWithinPartitions("shard", "doc_id", "n_tokens").mapInPandas(work, schema)


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
