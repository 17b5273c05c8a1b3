"""Candidates for mentions: exact, by words, BM25, nearest vectors; pair scoring and ranking.

Tables: mentions and entities (id, label); candidates (src, dst, score).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import label_tokens, regular_spaces
from sheaf.session import materialize

K1, B = 1.5, 0.75


def exact_key(label: Column) -> Column:
    return regular_spaces(F.lower(label))


def word_key(label: Column) -> Column:
    return F.array_join(label_tokens(label), " ")


def match_on_key(left: DataFrame, right: DataFrame | None, key) -> DataFrame:
    """(src, dst, score 1.0) of equal keys; pairs a < b within one table if there is no right one. Keys are joined as distinct labels first."""
    a = left.select(F.col("id").alias("src"), key(F.col("label")).alias("k")).where("k <> ''")
    if right is None:
        b = a.select(F.col("src").alias("dst"), "k")
        return a.join(b, "k").where("src < dst").select("src", "dst", F.lit(1.0).alias("score"))
    return a.join(right.select(F.col("id").alias("dst"), key(F.col("label")).alias("k")), "k").select("src", "dst", F.lit(1.0).alias("score"))


def bm25(mentions: DataFrame, entities: DataFrame, k: int = 4, k1: float = K1, b: float = B) -> DataFrame:
    """(src, dst, score): for each mention the k entities with the highest BM25 score, lower ids first of equals, by an inverted index.

    Distinct labels are scored, so repeated mentions cost a join at the end.
    """
    docs = entities.select(F.col("id").alias("dst"), F.explode(label_tokens(F.col("label"))).alias("term"))
    sizes = docs.groupBy("dst").agg(F.count(F.lit(1)).alias("len"))
    stats = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))
    df = docs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len")  # stats is one row
    index = docs.join(idf, "term").join(sizes, "dst").select("dst", "term", (F.col("idf") * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).alias("w"))
    queries = mentions.select("label").distinct()
    terms = queries.select("label", F.explode(label_tokens(F.col("label"))).alias("term"))
    scores = terms.join(index, "term").groupBy("label", "dst").agg(F.sum("w").alias("score"))
    order = Window.partitionBy("label").orderBy(F.desc(F.round("score", 9)), "dst")
    best = scores.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return mentions.select(F.col("id").alias("src"), "label").join(best, "label").select("src", "dst", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


#: Vectors of a slab (a tile of the product has one of each side), slabs of a block at most, and blocks at least where there are slabs enough.
SLAB, BLOCK, BLOCKS = 4096, 16, 16


def _slabs(vectors: DataFrame, parts: int) -> DataFrame:
    """(slab, ids, vectors): rows by a hash of their id, each slab's numbers as bytes in order of id."""
    kind = "f8" if dict(vectors.dtypes)["vector"] == "array<double>" else "f4"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["vector"]).astype(kind)
        return pd.DataFrame({"slab": [pdf["slab"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "width": [x.shape[1]], "kind": [kind]})

    rows = vectors.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("slab"), "id", "vector")
    return rows.groupBy("slab").applyInPandas(pack, "slab bigint, ids binary, vectors binary, width int, kind string")


class _Best:
    """The k best so far of each row of one slab, and the score that another must reach."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max()))
        self.norm, self.fast = norm, x.astype(np.float32 if norm < 1e15 else np.float64)
        self.row, self.dst, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.limit = np.full(len(ids), -np.inf)

    def offer(self, other: _Best, tile: np.ndarray, axis: int, same: bool) -> None:
        """Take in the rows of ``other``; tile has the rounded-off products, this slab's rows along ``axis``."""
        margin = 1e-9 + (self.x.shape[1] + 8) * 2.0**-23 * self.norm * other.norm
        limit, groups = self.limit, min(64, len(other.ids))
        if groups > self.k and np.isneginf(limit).any():  # k groups reach what the k-th best group does
            n = len(other.ids) // groups
            tops = tile[:, : n * groups].reshape(len(tile), n, groups).max(1).T if axis == 0 else tile[: n * groups].reshape(n, groups, -1).max(0)
            limit = np.maximum(limit, np.partition(tops, groups - self.k, axis=0)[groups - self.k])
        low = (limit - margin).astype(tile.dtype)
        at = np.nonzero(tile >= (low[:, None] if axis == 0 else low[None, :]))
        i, j = at[axis], at[1 - axis]
        if len(i) > tile.size // 16 and tile.size > 65_536:  # many ties: the whole tile is worked out, some rows at a time
            found = [self._dense(lo, other, same) for lo in range(0, len(self.ids), 512)]
            i, dst, score = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            dst = other.ids[j]
            if same:
                keep = self.ids[i] != dst
                i, j, dst = i[keep], j[keep], dst[keep]
            score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.x[i[lo : lo + 65_536]].astype(np.float64), other.x[j[lo : lo + 65_536]].astype(np.float64)) for lo in range(0, len(i), 65_536))])
        ok = np.isfinite(score)
        row, dst, score = np.concatenate([self.row, i[ok]]), np.concatenate([self.dst, dst[ok]]), np.concatenate([self.score, score[ok]])
        order = np.lexsort((dst, -np.round(score, 9), row))
        row, dst, score = row[order], dst[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == self.k - 1
        self.limit[row[last]] = np.round(score[last], 9)
        self.row, self.dst, self.score = row[rank < self.k], dst[rank < self.k], score[rank < self.k]

    def _dense(self, lo: int, other: _Best, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = self.x[lo : lo + 512].astype(np.float64) @ other.x.astype(np.float64).T
        if same:
            scores[self.ids[lo : lo + 512, None] == other.ids[None, :]] = -np.inf
        rank = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, : self.k]
        return np.repeat(np.arange(lo, lo + len(scores)), rank.shape[1]), other.ids[rank].ravel(), np.take_along_axis(scores, rank, 1).ravel()


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 4, same: bool = True, block: int | None = None) -> DataFrame:
    """(src, dst, score): the k vectors of the corpus with the largest inner product, lower ids first of equals; not itself, if ``same``.

    Rows are put into slabs, and slabs into blocks; each pair of blocks is a task, where tiles of single-precision products rule out what can't be among the best
    by more than their error, and the rest is worked out in double precision. Within one table a tile serves both of its sides. Up to BLOCKS * BLOCK slabs a vector is sent BLOCKS times,
    beyond that once for each block; k rows a vector and task go on. Vectors: (id, vector); ``block`` of them are a slab, SLAB if not given.
    """
    queries, corpus = queries.select("id", "vector"), corpus.select("id", "vector")
    one = same and queries.sameSemantics(corpus)
    most = block or SLAB

    def blocks(df: DataFrame) -> tuple[DataFrame, int]:
        parts = max(1, -(-df.count() // most))
        n = max(min(parts, BLOCKS), -(-parts // BLOCK))
        return _slabs(df, parts).withColumn("block", F.pmod("slab", F.lit(n)).cast("int")), n

    left, m = blocks(queries)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["task", "side", "ids", "vectors", "width", "kind"]
    if one:
        lo, hi = F.least("block", "other"), F.greatest("block", "other")
        sent, tasks = left.withColumn("other", every(m)).withColumn("task", (hi * (hi + 1) / 2 + lo).cast("int")).withColumn("side", (F.col("block") > F.col("other")).cast("int")).select(columns), m * (m + 1) // 2
    else:
        right, n = blocks(corpus)
        a = left.withColumn("other", every(n)).withColumn("task", F.col("block") * n + F.col("other")).withColumn("side", F.lit(0))
        b = right.withColumn("other", every(m)).withColumn("task", F.col("other") * n + F.col("block")).withColumn("side", F.lit(1))
        sent, tasks = a.select(columns).unionByName(b.select(columns)), m * n

    def product(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list[_Best], list[_Best]] = ([], [])
        for batch in parts:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], r["kind"]).reshape(-1, r["width"])
                fine = np.isfinite(x).all(1)
                ids, x = ids[fine], x[fine]
                sides[r["side"]].extend(_Best(ids[lo : lo + most], x[lo : lo + most], k) for lo in range(0, len(ids), most))
        a, b = sides
        for i, q in enumerate(a):
            for j, c in enumerate(a if one and not b else b):
                if one and not b and j < i:
                    continue
                tile = q.fast @ c.fast.T
                if same and len(np.intersect1d(q.ids, c.ids)):
                    tile[q.ids[:, None] == c.ids[None, :]] = -np.inf
                q.offer(c, tile, 0, same)
                if one and q is not c:
                    c.offer(q, tile, 1, same)
        for q in [*a, *b] if one else a:
            yield pa.RecordBatch.from_arrays([q.ids[q.row], q.dst, q.score], ["src", "dst", "score"])

    partial = sent.repartitionById(tasks, F.col("task")).mapInArrow(product, "src bigint, dst bigint, score double")
    order = Window.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "dst")
    return partial.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("src", "dst", "score")


#: Least recall of the buckets on a sample of SAMPLE queries; a little above the 0.9 that is asked for.
SAMPLE, RECALL = 256, 0.92


def _keys(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """A row's bucket in each table."""
    planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs << np.arange(bits)).sum(2) + (np.arange(tables) << bits)


def bucket_recall(vectors: DataFrame, k: int = 4, tables: int = 24, bits: int = 8, seed: int = 5) -> float:
    """Share of the exact k nearest of a hashed sample of rows that share a bucket with them; 1 if there are none."""
    slim = vectors.select("id", "vector")
    sample = slim.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    pairs = nearest(sample, slim, k).join(sample.select(F.col("id").alias("src"), F.col("vector").alias("a")), "src").join(slim.select(F.col("id").alias("dst"), F.col("vector").alias("b")), "dst")
    rows = pairs.select("a", "b").collect()  # SAMPLE * k at most
    if not rows:
        return 1.0
    a, b = (_keys(np.array([r[side] for r in rows], np.float64), tables, bits, seed) for side in ("a", "b"))
    return float((a == b).any(1).mean())


def nearest_lsh(vectors: DataFrame, k: int = 4, tables: int = 24, bits: int = 8, seed: int = 5) -> DataFrame:
    """:func:`nearest` within one table: candidates share the signs of ``bits`` random projections in one of ``tables`` tables.

    Where these buckets hold fewer than RECALL of a sample's exact neighbours (neighbours at wide angles), the search is the exact one.
    """
    if bucket_recall(vectors, k, tables, bits, seed) < RECALL:
        slim = vectors.select("id", "vector")
        return nearest(slim, slim, k)

    def hashes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            keys = _keys(np.stack(pdf["vector"]).astype(np.float64), tables, bits, seed)
            yield pd.DataFrame({"key": keys.ravel(), "id": np.repeat(pdf["id"].to_numpy(), tables), "vector": [v for v in pdf["vector"] for _ in range(tables)]})

    spread = vectors.select("id", "vector").mapInPandas(hashes, "key bigint, id bigint, vector array<float>")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, x = pdf["id"].to_numpy(), np.stack(pdf["vector"]).astype(np.float64)
        out = []
        for lo in range(0, len(ids), 2048):
            scores = x[lo : lo + 2048] @ x.T
            scores[np.arange(len(scores)), np.arange(lo, lo + len(scores))] = -np.inf
            rank = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(scores, rank, 1).ravel()
            ok = np.isfinite(value)
            out.append(pd.DataFrame({"src": np.repeat(ids[lo : lo + 2048], rank.shape[1])[ok], "dst": ids[rank].ravel()[ok], "score": value[ok]}))
        return pd.concat(out)

    found = spread.groupBy("key").applyInPandas(within, "src bigint, dst bigint, score double").groupBy("src", "dst").agg(F.max("score").alias("score"))
    order = Window.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "dst")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("src", "dst", "score")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two labels' words; the default pair scorer."""
    x, y = label_tokens(a), label_tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def rerank(candidates: DataFrame, left: DataFrame, right: DataFrame, scorer=jaccard, best_only: bool = True) -> DataFrame:
    """Candidates with the scorer's score in place of theirs; the best of each source alone (lower ids first of equals), if so asked."""
    pairs = candidates.select("src", "dst").join(left.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(right.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    scored = pairs.select("src", "dst", scorer(F.col("a"), F.col("b")).alias("score"))
    return best(scored) if best_only else scored


def rerank_on_key(mentions: DataFrame, entities: DataFrame, key: Callable[[Column], Column], scorer: Callable[[Column, Column], Column] = jaccard) -> DataFrame:
    """:func:`rerank` where a mention's candidates are the entities whose label has the same key; mentions, entities (id, label).

    A score depends on the two labels alone: distinct labels are scored, the best entity of each is found once, and mentions look it up by label.
    An id with several labels takes the best over them all.
    """
    labels = mentions.select("label").distinct().select("label", key(F.col("label")).alias("k"))
    named = entities.groupBy("label").agg(F.min("id").alias("dst")).select("dst", F.col("label").alias("other"), key(F.col("label")).alias("k"))
    scored = labels.join(named, "k").select("label", "dst", scorer(F.col("label"), F.col("other")).alias("score"))
    top = materialize(scored.groupBy("label").agg(F.min(F.struct((-F.col("score")).alias("s"), "dst")).alias("x")), "best")
    found = mentions.select(F.col("id").alias("src"), "label").join(top, "label").groupBy("src").agg(F.min("x.s").alias("s"), F.min_by("x.dst", "x").alias("dst"))
    return found.select("src", "dst", (-F.col("s")).alias("score"))


def best(candidates: DataFrame, weight: str = "score") -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.desc(weight), "dst")
    return candidates.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def by_popularity(candidates: DataFrame, popularity: DataFrame) -> DataFrame:
    """The most popular candidate of each source, with score 1; popularity (dst, popularity)."""
    return best(candidates.join(popularity, "dst", "left").na.fill(0, ["popularity"]), "popularity").select("src", "dst", F.lit(1.0).alias("score"))


def popular_on_key(left: DataFrame, right: DataFrame, keys: list[str], popularity: DataFrame) -> DataFrame:
    """:func:`by_popularity` where a source's candidates are the rows of equal keys; left (src, keys), right (dst, keys).

    Sources of one key have the same candidates, so the best is found once for each key, and no pairs are made.
    """
    order = F.struct((-F.coalesce("popularity", F.lit(0))).alias("n"), "dst")
    top = right.join(popularity, "dst", "left").groupBy(*keys).agg(F.min(order).alias("x"))
    return left.join(top, keys).groupBy("src").agg(F.min("x").alias("x")).select("src", "x.dst", F.lit(1.0).alias("score"))


def ordered_pairs(pairs: DataFrame, order: str) -> DataFrame:
    """(a, b, score) with a < b, no pair of one with itself, the last score by ``order`` kept (the highest of equals)."""
    rows = pairs.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.struct(F.col(order).alias("at"), "score").alias("x"))
    return rows.groupBy("a", "b").agg(F.max("x").alias("x")).select("a", "b", "x.score")


def nil_consistent(pairs: DataFrame, known: DataFrame, nil: bool | None) -> DataFrame:
    """Pairs whose mentions all are (nil) or none is (not nil) without known entity; all pairs for None. known (id)."""
    if nil is None:
        return pairs
    flags = known.select("id").distinct()
    how = "left_anti" if nil else "left_semi"
    return pairs.join(flags.withColumnRenamed("id", "src"), "src", how).join(flags.withColumnRenamed("id", "dst"), "dst", how)


#: Mentions of an entity whose pairs with all its others are one group of the join.
SHARE = 1000


def matching_pairs(alignment: DataFrame) -> DataFrame:
    """(src, dst), src < dst: all pairs of mentions of one entity; alignment (mention, entity).

    An entity's mentions are dealt into shares of about SHARE, each of which meets all of the entity's mentions by itself, so a common entity is many tasks' work.
    """
    shares = alignment.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    rows = alignment.join(shares, "entity")
    a = rows.select(F.col("mention").alias("src"), "entity", F.pmod(F.xxhash64("mention"), "shares").cast("int").alias("share"))
    b = rows.select(F.col("mention").alias("dst"), "entity", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    n = int(alignment.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given outright, so that small partitions of many pairs aren't put together
    keys = ["entity", "share"]
    return a.repartition(n, *keys).join(b.repartition(n, *keys).hint("shuffle_hash"), keys).where("src < dst").select("src", "dst")


def training_pairs(alignment: DataFrame, candidates: DataFrame, negatives: int = 1, share: float = 1.0, seed: int = 310) -> DataFrame:
    """(src, dst, label): the matching pairs of mentions, a hashed share of them, and up to ``negatives`` wrong candidates of each source.

    alignment (mention, entity); candidates (src, dst, score) between mentions.
    """
    a = alignment.select(F.col("mention").alias("src"), "entity")
    b = alignment.select(F.col("mention").alias("dst"), "entity")
    positive = matching_pairs(alignment.select("mention", "entity"))
    if share < 1:
        positive = positive.where(F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    wrong = candidates.join(a, "src").join(b.withColumnRenamed("entity", "other"), "dst").where("entity <> other")
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    negative = wrong.withColumn("r", F.row_number().over(order)).where(F.col("r") <= negatives).select("src", "dst")
    return positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)))


def corpus_split(pages: DataFrame, seed: int = 310, shares: tuple[int, int] = (60, 20)) -> DataFrame:
    """Pages with split 'train', 'eval' or 'test' by a hash of the id: the same page always goes the same way."""
    h = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100))
    return pages.withColumn("split", F.when(h < shares[0], "train").when(h < sum(shares), "eval").otherwise("test"))


def mention_input(mentions: DataFrame) -> DataFrame:
    """(id, text): label, page and sections, then the other items of the listing as context."""
    items = Window.partitionBy("page", "listing").orderBy("item")
    near = F.collect_list("label").over(items.rowsBetween(-2, 2))
    return mentions.select("id", F.concat_ws(" [SEP] ", "label", "page", "section", F.array_join(F.array_except(near, F.array("label")), " [ROW] ")).alias("text"))


def entity_input(entities: DataFrame, abstracts: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, text): label, abstract and facts in words, sorted; facts (id, pred, value)."""
    said = facts.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "pred", "value"))), ", ").alias("said"))
    return entities.join(abstracts, "id", "left").join(said, "id", "left").select("id", F.concat_ws(" [SEP] ", "label", "abstract", "said").alias("text"))
