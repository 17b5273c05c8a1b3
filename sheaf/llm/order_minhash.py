"""Near-duplicate documents by Order MinHash (Marcais et al. 2019), verified by banded alignment.

A document's word k-mers are labelled with their occurrence number; for each of ``SKETCHES`` hash functions the
``KEEP`` least labelled k-mers are taken and joined in text order. Documents that share such a vector are candidates:
within a bucket each is compared with the bucket's leaders by a small one-byte-per-bin sketch of its k-mers, and linked
to those it resembles or becomes a leader itself. Texts of few words are compared by counts of their words, which rule out no near duplicate. Texts of equal words are one before that, so groups of exact copies cost nothing;
vectors that very many texts share are split into parts whose leaders meet afterwards. Linked pairs whose counted words don't rule them out are verified by a bit-parallel banded edit distance over
words; texts are sent for these alone. Members, and leaders that earlier members resemble, that verified pairs didn't bring into one group are then compared with each other, and all verified pairs form groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.common import drop_ids, map_batches, only_ids, table, texts
from sheaf.llm.words import grams, mix, slices, words
from sheaf.operators.components import connected_components
from sheaf.session import materialize, settle

KMER = 2
KEEP = 2
#: Of two texts at SIMILARITY whose edits are scattered, 0.32 of the 2-grams agree, so 0.95 of the pairs share one of 28 vectors.
SKETCHES = 28
#: Most words of a text that has vectors of single words too, and their number: in texts of few words an edit breaks too many 2-grams.
SHORT = 44
SHORT_SKETCHES = 16
#: Least edit similarity, 1 - distance / words of the longer text, of a verified pair.
SIMILARITY = 0.7
#: Least share of agreeing bins at which two texts of a bucket may be near duplicates, and bins a document has. Texts that share a vector by chance agree in
#: 2 or 3 bins of 64; at SIMILARITY a quarter or more of the 2-grams agree, so 4 bins are missed once in 10,000 times or less.
RESEMBLANCE = 0.05
BINS = 64
_SEEDS = np.random.default_rng(11).integers(1, 2**63, SKETCHES, dtype=np.uint64)
_SHORT_SEEDS = np.random.default_rng(12).integers(1, 2**63, SHORT_SKETCHES, dtype=np.uint64)
_BLOCK = 1 << 15
#: Texts that share a vector above which they are split into parts of about as many, the most such vectors looked for, and the counters that find them.
SPLIT = 50_000
HOT_VECTORS = 1000
COUNTERS = 16_384
#: Rows of one bucket held at once; of a longer one the leaders stay.
HELD = 50_000
#: Least and most bits of the classes by which a text's words are counted; between, there are as many classes as words or up to twice that.
FEWEST_BITS, MOST_BITS = 6, 12
#: Members of one bucket that are compared with each other in one task; those of a larger one meet block by block.
TOGETHER = 8192


def _labelled(kmers: np.ndarray) -> np.ndarray:
    """Hash of each k-mer with its occurrence number within the text."""
    order = np.argsort(kmers, kind="stable")
    run = kmers[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return mix(kmers)
    head = np.concatenate([[0], np.where(same, 0, np.arange(1, len(run)))])
    number = np.empty(len(run), np.uint64)
    number[order] = np.arange(len(run)) - np.maximum.accumulate(head)
    return mix(kmers + number * np.uint64(0xA0761D6478BD642F))


def sketch(hashes: np.ndarray, k: int = KMER, keep: int = KEEP, seeds: np.ndarray = _SEEDS) -> tuple[np.ndarray, bytes]:
    """The order-MinHash vectors of a text's word hashes, each as one number, and its bin sketch."""
    kmers = grams(hashes, min(k, len(hashes)))
    labels = _labelled(kmers)
    n = len(labels)
    rows = np.arange(len(seeds))[:, None]
    least = place = None
    for at in range(0, n, _BLOCK):  # very long texts pass through in blocks
        block = mix(labels[None, at : at + _BLOCK] ^ seeds[:, None])
        pos = np.empty((len(seeds), min(keep, block.shape[1])), np.int64)
        val = np.empty(pos.shape, np.uint64)
        for j in range(pos.shape[1]):
            pos[:, j] = block.argmin(1)
            val[:, j] = block[rows[:, 0], pos[:, j]]
            block[rows[:, 0], pos[:, j]] = np.uint64(2**64 - 1)
        pos += at
        if least is not None:
            val, pos = np.concatenate([least, val], 1), np.concatenate([place, pos], 1)
            by = np.argsort(val, 1, kind="stable")[:, :keep]
            val, pos = np.take_along_axis(val, by, 1), np.take_along_axis(pos, by, 1)
        least, place = val, pos
    chosen = labels[np.sort(place, 1)]
    keys = np.zeros(len(seeds), np.uint64)
    for j in range(chosen.shape[1]):
        keys = mix(keys * np.uint64(0x2127599BF4325C37) + chosen[:, j] + np.uint64(j + 1))
    keys = mix(keys + np.arange(len(seeds), dtype=np.uint64))
    ordered = np.sort(labels)
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(58)
    at = np.searchsorted(ordered, edges)
    first = ordered[np.minimum(at, n - 1)]
    value = np.where((at < n) & (first >> np.uint64(58) == np.arange(BINS, dtype=np.uint64)), (first >> np.uint64(20)) % np.uint64(255) + np.uint64(1), 0)
    return keys, value.astype(np.uint8).tobytes()


def folded(hashes: np.ndarray) -> bytes:
    """Words of a text of at most 255 counted by BINS classes: no edit changes more than two counts, one up and one down, so these bound the distance from below."""
    return np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=BINS).astype(np.uint8).tobytes()


def counted(hashes: np.ndarray) -> bytes:
    """Words of a text of any length counted by classes, 255 at most of each; :func:`least_distance` compares them."""
    bits = min(max((len(hashes) - 1).bit_length(), FEWEST_BITS), MOST_BITS)
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def least_distance(one: bytes, other: bytes) -> int:
    """Least edits between two texts by their counted words: an edit changes no more than two counts, one up and one down. Of finer classes several make one of the coarser."""
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (one, other))
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):
        y = np.minimum(y.reshape(len(x), -1).sum(1), 255)
    more = x - y
    up = int(np.maximum(more, 0).sum())
    return max(up, up - int(more.sum()))


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two word sequences if it is at most ``limit``, else None.

    Bit-parallel (Hyyro 2003) over a band of 2 * limit + 1 diagonals, one Python integer wide.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return None
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    front = int(differ[0]) if len(differ) else m
    a, b = a[front:], b[front:]
    m = min(len(a), len(b))
    if m:
        differ = np.flatnonzero(a[::-1][:m] != b[::-1][:m])
        back = int(differ[0]) if len(differ) else m
        a, b = a[: len(a) - back], b[: len(b) - back]
    if not len(b):
        return len(a) if len(a) <= limit else None
    # a gives the rows of the band, b the columns; in column j bit i stands for row j + i - limit
    limit = min(limit, len(a))
    width = 2 * limit + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << (i + limit)
    n, m = len(a), len(b)
    # D[row] - D[row - 1] is +1 for rows >= 1; rows above the matrix count as a flat start
    vp = (full >> (limit + 1)) << (limit + 1)
    vn = 0
    score = limit  # value at the band's lowest cell, row j + limit of column j, starting at column 0
    for j, w in enumerate(b.tolist(), 1):
        # rows covered: j - limit .. j + limit; shift vertical differences by one row to the new column
        vp >>= 1
        vn >>= 1
        vp |= top  # a new lowest row: one more than the row above at most
        match = masks.get(w, 0) >> (j - 1) & full
        x = match | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        # diagonal step along the lowest cell
        if not d0 & top:
            score += 1
        hp1, hn1 = (hp << 1) & full, (hn << 1) & full
        if j - limit <= 1:  # row 0 lies in the band or just above it: its horizontal difference is +1
            edge = max(limit - j, -1) + 1  # bit of row 1
            if edge >= 0:
                hp1 |= 1 << edge
        vp = hn1 | (full & ~(d0 | hp1))
        vn = d0 & hp1
    # walk from the lowest cell up to row n of the last column
    low = m + limit
    for row in range(low, n, -1):
        bit = 1 << (row - m + limit)
        score -= (vp & bit != 0) - (vn & bit != 0)
    return score if score <= limit else None


def distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """:func:`banded_distance` by bands of growing width, as most copies differ little; two texts have no less distance than the words of the longer that the other lacks."""
    one, two = np.sort(a), np.sort(b)
    at = np.searchsorted(two, one) + np.arange(len(one)) - np.searchsorted(one, one)
    inside = at < len(two)
    if max(len(a), len(b)) - (two[at[inside]] == one[inside]).sum() > limit:
        return None
    for width in (64, 1024):
        if width < limit and (d := banded_distance(a, b, width)) is not None:
            return d
    return banded_distance(a, b, limit)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, n_words, bins, keys, counts) for each document with a word: a hash of all its words, their number, its vectors and its counted words.

    bins are folded counts for texts of up to SHORT words, a bin sketch for others, and both for those that may be near duplicates of either.
    """

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch):
            found = words(part.column("text"))
            rows = np.flatnonzero(np.diff(found.first))
            keys, bins, whole, classes = [], [], [], []
            for i in rows:
                own = found.of(i)
                vector, small = sketch(own)
                if len(own) <= SHORT:
                    vector = np.concatenate([vector, sketch(own, k=1, seeds=_SHORT_SEEDS)[0]])
                keys.append(vector)
                counts = folded(own) if len(own) <= SHORT / SIMILARITY else b""
                bins.append(counts if len(own) <= SHORT else small + counts)
                whole.append(grams(own, len(own))[0])
                classes.append(counted(own))
            if keys:
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield {
                    "doc_id": part.column("doc_id").take(pa.array(rows)),
                    "whole": np.array(whole, np.uint64).view(np.int64),
                    "n_words": np.diff(found.first)[rows].astype(np.int32),
                    "bins": pa.array(bins, pa.binary()),
                    "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64))),
                    "counts": pa.array(classes, pa.binary()),
                }

    return map_batches(texts(docs), work, "doc_id bigint, whole bigint, n_words int, bins binary, keys array<bigint>, counts binary")


def _unpacked(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin sketches, folded counts, which rows have counts) of a bucket's bins as :func:`sketches` gives them."""
    few = sizes <= SHORT
    counted = few | np.array([len(r) > BINS for r in rows], bool)
    bins, counts = np.zeros((2, len(rows), BINS), np.uint8)
    if not few.all():
        bins[~few] = np.frombuffer(b"".join(r[:BINS] for r in rows[~few]), np.uint8).reshape(-1, BINS)
    if counted.any():
        counts[counted] = np.frombuffer(b"".join(r[-BINS:] for r in rows[counted]), np.uint8).reshape(-1, BINS)
    return bins, counts, counted


def _resembling(i: int, others: np.ndarray, sizes: np.ndarray, own: tuple[np.ndarray, np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Which of the others a bucket's row i may be a near duplicate of: by length, and by counts where one of the two is short, else by bins."""
    bins, counts, counted = own
    out = np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i])
    few = (sizes[others] <= SHORT) | (sizes[i] <= SHORT)
    if counted[i] and (at := np.flatnonzero(out & few & counted[others])).size:
        more = counts[others[at]].astype(np.int16) - counts[i]
        up, all_ = np.maximum(more, 0).sum(1), more.sum(1)
        out[at] = np.maximum(up, up - all_) <= (1 - similarity) * np.maximum(sizes[others[at]], sizes[i]) + 1e-9
    if (at := np.flatnonzero(out & ~few)).size:
        ours, theirs = bins[i], bins[others[at]]
        agree = ((theirs == ours) & (ours > 0)).sum(1)
        out[at] = agree >= RESEMBLANCE * ((theirs > 0) | (ours > 0)).sum(1)
    return out


def _links(ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray, similarity: float) -> tuple[list[tuple[int, int]], list[int], np.ndarray]:
    """Pairs (leader, member) of one bucket, ids in ascending order, the rows of its members and of leaders that earlier members resemble, and those of all its leaders.

    A document that comes with several texts is a row for each, and none of them is linked with another.
    """
    out, members, late = [], [], []
    own = _unpacked(rows, sizes)
    leaders = np.zeros(0, np.int64)
    for i in range(len(ids)):
        if len(leaders):
            near = leaders[_resembling(i, leaders, sizes, own, similarity)]
            near = near[ids[near] != ids[i]]
            if len(near):
                out += [(min(ids[j], ids[i]), max(ids[j], ids[i])) for j in near]
                members.append(i)
                continue
            if members and _resembling(i, np.array(members), sizes, own, similarity).any():
                late.append(i)
        leaders = np.append(leaders, i)
    return out, members + late, leaders


def _by_key(parts: Iterator[pd.DataFrame], work, by: list[str], thin=None, most: int | None = None) -> Iterator[pd.DataFrame]:
    """``work`` on rows of whole keys; a partition comes sorted by the columns ``by``, a bucket may run over batches.

    Of a bucket of more than ``most`` rows (HELD if None) ``thin``, if given, gives a frame to pass on and the rows to hold.
    """
    rest = None
    for pdf in parts:
        if not len(pdf):
            continue
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        last = len(pdf) - int(_same(pdf, by)[::-1].argmin() if not _same(pdf, by).all() else len(pdf))
        if last:
            yield work(pdf.iloc[:last])
        rest = pdf.iloc[last:]
        if thin is not None and len(rest) > (most or HELD):
            done, rest = thin(rest.reset_index(drop=True))
            yield done
    if rest is not None and len(rest):
        yield work(rest)


def _same(pdf: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Which rows have the last row's key."""
    return np.logical_and.reduce([pdf[c].to_numpy() == pdf[c].iloc[-1] for c in by])


def _buckets(pdf: pd.DataFrame, by: list[str]) -> Iterator[tuple[int, int]]:
    """First row and end of each bucket of two rows or more."""
    new = np.logical_or.reduce([(k := pdf[c].to_numpy())[1:] != k[:-1] for c in by])
    edges = np.flatnonzero(np.concatenate([[True], new, [True]]))
    return ((lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if hi - lo > 1)


_FOUND = "kind int, key bigint, a bigint, b bigint, n_words int, bins binary"
_PAIR, _MEMBER, _LEADER = 0, 1, 2


def _linked(rows: DataFrame, similarity: float, held: int | None = None) -> DataFrame:
    """Pairs, members and leaders of each bucket (key, part) of rows (key, part, parts, doc_id, n_words, bins); members of buckets that have two, leaders of buckets that are one of several parts.

    The leaders of a bucket that was thinned count as members too: what earlier rows they resemble is no longer held.
    """
    by = ["key", "part"]

    def link(pdf: pd.DataFrame, every: bool = False) -> tuple[pd.DataFrame, list[int]]:
        key, ids, sizes, rows, parts = (pdf[c].to_numpy() for c in ("key", "doc_id", "n_words", "bins", "parts"))
        thinned = pdf["held"].eq(True).to_numpy() if "held" in pdf else np.zeros(len(pdf), bool)
        pairs, more, first = set(), [], []
        seen = np.zeros(len(pdf), bool)
        for lo, hi in _buckets(pdf, by):
            seen[lo:hi] = True
            linked, members, leaders = _links(ids[lo:hi], sizes[lo:hi], rows[lo:hi], similarity)
            if thinned[lo:hi].any() and not every:
                members = sorted({*members, *leaders.tolist()})
            pairs.update(linked)
            if len(members) > 1 or every or parts[lo] > 1:
                more += (lo + np.array(members, np.int64)).tolist()
            if parts[lo] > 1 or every:
                first += (lo + leaders).tolist()
        if not every:
            first += np.flatnonzero(~seen & (parts > 1)).tolist()
        both = sorted(pairs)
        told = [] if every else first
        at = np.array(more + told, np.int64)
        frame = pd.DataFrame({
            "kind": np.concatenate([np.full(len(both), _PAIR), np.full(len(more), _MEMBER), np.full(len(told), _LEADER)]).astype(np.int32),
            "key": np.concatenate([np.zeros(len(both), np.int64), key[at]]),
            "a": np.concatenate([np.array([a for a, _ in both], np.int64), ids[at]]),
            "b": pd.array([b for _, b in both] + [None] * len(at), "Int64"),
            "n_words": np.concatenate([np.zeros(len(both), np.int32), sizes[at]]).astype(np.int32),
            "bins": [b""] * len(both) + rows[at].tolist(),
        })
        return frame, first

    def thin(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        frame, leaders = link(pdf, every=True)
        return frame, pdf.iloc[leaders].assign(held=True)

    spread = rows.repartition("key", "part").sortWithinPartitions("key", "part", "doc_id", "n_words")
    return spread.mapInPandas(lambda it: _by_key(it, lambda pdf: link(pdf)[0], by, thin, held), _FOUND)


def _shared(each: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``each`` whose key comes more than once, and all of a key in several parts; most keys come once, and what their texts are compared by needn't be sent."""
    many = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where("n > 1 OR parts > 1" if "parts" in by else "n > 1")
    return many.drop("n")


def candidates(rows: DataFrame, similarity: float = SIMILARITY, split: int = SPLIT, held: int | None = None) -> DataFrame:
    """(kind, key, a, b, n_words, bins) from distinct texts' sketches: pairs a < b of a leader and a member that a shared order-MinHash vector
    and the bins suggest, linear in a bucket of copies; and the members a of each bucket that has two or more (of one in parts all rows, members or leaders)."""
    named = rows.withColumn("row", F.xxhash64("doc_id", "n_words", "bins", "keys"))
    each = named.select(F.explode("keys").alias("key"), "row")
    own = named.select("row", "doc_id", "n_words", "bins")
    hot: list[tuple[int, int]] = []
    if rows.count() > split:  # frequent-item counters of each partition, merged in two steps
        some = each.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(key, {COUNTERS})").alias("state"))
        top = some.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(state, {COUNTERS}), {HOT_VECTORS})").alias("top")).first()["top"]
        hot = [(r["item"], -(-r["count"] // split)) for r in top or () if r["count"] > split]
    if not hot:
        return _linked(_shared(each, ["key"]).withColumn("parts", F.lit(1)).withColumn("part", F.lit(0)).join(own, "row"), similarity, held)
    parts = rows.sparkSession.createDataFrame(hot, "key bigint, parts int")
    cut = each.join(F.broadcast(parts), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    found = materialize(_linked(_shared(cut, ["key", "part", "parts"]).join(own, "row"), similarity, held), "omh-parts")
    leaders = found.where(f"kind = {_LEADER}").select("key", F.lit(0).alias("part"), F.lit(1).alias("parts"), F.col("a").alias("doc_id"), "n_words", "bins")
    return found.unionByName(_linked(leaders, similarity, held).where(f"kind = {_PAIR}"))


def unproven(members: DataFrame, groups: DataFrame, similarity: float = SIMILARITY, together: int = TOGETHER, rows: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of resembling members of one bucket that are in different groups (node, component) so far; those of more than ``together`` meet in tasks of about as many.

    ``rows``, the :func:`sketches` of the members, if given: pairs that their counts rule out go before they are written.
    """
    by = ["key"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, group, block, rows, counts = (pdf[c].to_numpy() for c in ("a", "n_words", "component", "block", "bins", "counts"))
        out = set()
        for lo, hi in _buckets(pdf, by):
            if (group[lo:hi] == group[lo]).all():
                continue
            own = _unpacked(rows[lo:hi], sizes[lo:hi])
            across = (block[lo:hi] != block[lo]).any()  # two blocks: those of one block meet in a task of its own
            for i in range(hi - lo - 1):
                apart = group[lo + i + 1 : hi] != group[lo + i]
                if across:
                    apart &= block[lo + i + 1 : hi] != block[lo + i]
                others = i + 1 + np.flatnonzero(apart)
                near = others[_resembling(i, others, sizes[lo:hi], own, similarity)]
                for j in near:
                    one, other = lo + i, lo + j
                    if counts[one] is None or counts[other] is None or least_distance(counts[one], counts[other]) <= _limit(similarity, sizes[one], sizes[other]):
                        out.add((min(ids[one], ids[other]), max(ids[one], ids[other])))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    own = F.broadcast(groups) if groups.count() <= 1_000_000 else groups
    known = members.join(own.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    # buckets whose members are of one group go before anything is sent
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    blocks = mixed.select("key", F.ceil(F.when(F.col("n") > together, F.col("n") * 2 / together).otherwise(1)).cast("int").alias("blocks"))
    cut = known.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("a", "n_words", "bins"), F.col("blocks")).cast("int"))
    if rows is None:
        cut = cut.withColumn("counts", F.lit(None).cast("binary"))
    else:
        own = only_ids(rows, members.select(F.col("a").alias("doc_id"))).select(F.col("doc_id").alias("a"), "n_words", "bins", "counts").repartition("a", "n_words", "bins").distinct()
        cut = cut.join(own, ["a", "n_words", "bins"], "left")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least("block", o), F.greatest("block", o)))
    to = F.explode(F.when(F.col("blocks") > 1, tiles).otherwise(F.array("key"))).alias("key")
    spread = cut.select(to, "a", "component", "block", "n_words", "bins", "counts").repartition("key").sortWithinPartitions("key", "a", "n_words")
    return spread.mapInPandas(lambda parts: _by_key(parts, compare, by), "a bigint, b bigint").distinct()


def _limit(similarity: float, one: int, other: int) -> int:
    """Most edits between near duplicates of so many words."""
    return int((1 - similarity) * max(one, other) + 1e-9)


def possible(rows: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs (a, b) of ``pairs`` (materialised) that the counts of ``rows``, their :func:`sketches`, don't rule out; of a document with several texts, those of any."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        column = lambda name: batch.column(name).to_pylist()
        both = zip(column("left"), column("right"), column("left_words"), column("right_words"), strict=True)
        stay = pa.array([least_distance(left, right) <= _limit(similarity, one, other) for left, right, one, other in both], pa.bool_())
        yield {c: batch.column(c).filter(stay) for c in ("a", "b")}

    own = only_ids(rows, pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))).select("doc_id", "n_words", "counts").repartition("doc_id").distinct()
    right = own.select(F.col("doc_id").alias("b"), F.col("n_words").alias("right_words"), F.col("counts").alias("right"))
    left = own.select(F.col("doc_id").alias("a"), F.col("n_words").alias("left_words"), F.col("counts").alias("left"))
    return map_batches(pairs.join(right, "b").join(left, "a"), work, "a bigint, b bigint").distinct()


def verified(docs: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of the pairs (materialised) whose banded alignment over words is at least ``similarity``."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in (p for half in slices(batch, "left") for p in slices(half, "right")):
            left, right = words(part.column("left")), words(part.column("right"))
            out = {"a": [], "b": [], "similarity": []}
            for i, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                longer = max(len(left.of(i)), len(right.of(i)))
                d = distance_within(left.of(i), right.of(i), _limit(similarity, longer, longer)) if longer else None
                if d is not None:
                    out["a"].append(a)
                    out["b"].append(b)
                    out["similarity"].append(round(1 - d / longer, 6))
            yield out

    own = only_ids(texts(docs), pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    right = own.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    left = own.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return map_batches(both, work, "a bigint, b bigint, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _copies(rows: DataFrame) -> DataFrame:
    """(a, b, similarity 1) of documents b of equal words with the least such document a; a count that combines on the map side finds them."""
    classes = rows.groupBy("whole", "n_words").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a <> last")
    return rows.join(classes, ["whole", "n_words"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, split: int = SPLIT, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, kept_id, similarity) of every document that is not the first of its group of near duplicates.

    kept_id is the least doc_id of the group; similarity the best verified one to another member. Documents without words
    (null, empty, punctuation only) have no duplicates; very long texts are sketched and aligned whole; rows without doc_id are left out; rows
    that repeat a doc_id are one document, alike if any of its texts is; ties go to lower ids; other columns don't matter; an empty table gives none.
    ``rows``: :func:`sketches` of ``docs``, if written already.
    """
    rows = materialize(sketches(docs), "omh-sketches") if rows is None else rows
    different = materialize(rows.groupBy("whole", "n_words", "bins", "keys").agg(F.min("doc_id").alias("doc_id")), "omh-texts")
    found = materialize(candidates(different, similarity, split), "omh-found")
    pairs = materialize(found.where(f"kind = {_PAIR}").select("a", "b").distinct(), "omh-pairs")
    near = materialize(verified(docs, materialize(possible(rows, pairs, similarity), "omh-possible"), similarity).unionByName(_copies(rows)), "omh-edges")
    groups = connected_components(near, "a", "b")
    rest = materialize(unproven(found.where(f"kind <> {_PAIR}"), groups, similarity, rows=rows).join(pairs, ["a", "b"], "left_anti"), "omh-rest")
    if not rest.isEmpty():  # members whose links to leaders proved nothing
        near = materialize(near.unionByName(verified(docs, rest, similarity)), "omh-all-edges")
        groups = connected_components(near, "a", "b")
    best = near.select(F.explode(F.array("a", "b")).alias("node"), "similarity").groupBy("node").agg(F.max("similarity").alias("similarity"))
    return groups.join(best, "node").where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("kept_id"), "similarity")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that :func:`near_duplicates` lists, columns unchanged; one of each group stays.

    Of rows that repeat doc_id and text one stays (that of the least hash over all columns); rows that repeat a doc_id with other texts stay
    or go together. Rows without doc_id and texts without words stay; very long texts are compared whole; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = materialize(sketches(docs), "omh-sketches")
    again = materialize(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "omh-again")
    kept = drop_ids(docs, settle(spark, lambda: near_duplicates(docs, similarity, rows=rows).select("doc_id"), "omh-drop"))
    if again.isEmpty():
        return kept
    nth = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*docs.columns)))
    own = "__nth"
    while own in docs.columns:
        own += "_"
    kept = materialize(kept, "omh-kept")
    few = only_ids(kept, again)
    repeated = few.join(again, few["doc_id"] == again["doc_id"], "left_semi").withColumn(own, nth)
    return drop_ids(kept, again).unionByName(repeated.where(F.col(own) == 1).drop(own))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
