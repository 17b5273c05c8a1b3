"""Repeated passages by suffix arrays that are built bucket by bucket with a difference cover.

A passage repeats if the same ``LEAST`` or more words occur at two places of the corpus. To find all such places without
sorting every suffix of the corpus in one place:

1. each text is winnowed: of every window of ``LEAST - GRAM + 1`` consecutive ``GRAM``-word hashes the least is kept, so two equal
   runs of ``LEAST`` words keep the same anchor at the same place;
2. anchors that occur once lead nowhere and go; around the others lies a window of words that holds every repeat through the
   anchor. Windows that are equal word for word prove each other; one of each kind, where an anchor has several kinds, is fetched;
3. the windows of an anchor meet in one task, which sorts their suffixes one bucket at a time. Suffixes that agree on the first
   ``COVER_PERIOD`` words are ordered by the ranks of a difference-cover sample, sorted beforehand; memory is bounded by the bucket
   and the sample. Neighbours in the suffix array that share ``LEAST`` words are repeats;
4. an anchor of more than ``HOT`` places (a licence line, say) never meets in one task: a repeat through it goes on for half of
   ``LEAST - GRAM`` words to its left or to its right, so its windows meet where they agree on these words too. Should that be more
   than ``HOT`` windows again, the hashes of all their runs of ``LEAST`` words are counted, which combines on the map side;
5. repeated runs of a text that touch or overlap are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.common import map_batches, table, texts
from sheaf.llm.words import grams, mix, slices, words
from sheaf.session import discard, materialize

#: Words of the shortest passage reported, and of the anchors' grams.
LEAST = 50
GRAM = 25
#: Difference covers: every difference modulo the period is one of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (0, 1, 3, 8, 12, 18)}
COVER_PERIOD = 31
#: Suffixes sorted at once, and windows that one suffix array is built over (more only for a single anchor's).
BUCKET = 1 << 16
WINDOWS = 4096
#: Places of an anchor above which its windows are told apart by what stands beside them.
HOT = WINDOWS
#: Places above which an anchor doesn't even pass through one window of the sort, the most such anchors looked for, and the counters that find them.
SKEWED = 2_000_000
SKEWED_ANCHORS = 1000
COUNTERS = 16_384


def _offsets(period: int) -> np.ndarray:
    """offset[a, b]: least d with a + d and b + d both in the cover, modulo the period."""
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    out = np.full((period, period), -1)
    for d in range(period - 1, -1, -1):
        at = np.roll(cover, -d)
        out[np.ix_(at, at)] = d
    return out


def _packed(tokens: np.ndarray, at: np.ndarray, width: int, bits: int) -> list[np.ndarray]:
    """The ``width`` tokens from each position as few 63-bit columns, most significant first. ``tokens`` is padded."""
    per = max(1, 63 // bits)
    columns = []
    for k in range(0, width, per):
        column = np.zeros(len(at), np.int64)
        for j in range(k, min(k + per, width)):
            column = column << bits | tokens[at + j]
        columns.append(column)
    return columns


def _refine(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each in that order differs from the one before) by the columns, ties kept in place."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    if len(new):
        new[0] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def cover_ranks(tokens: np.ndarray, period: int, depth: int, bits: int) -> np.ndarray:
    """Rank of the suffix at each cover position (0 elsewhere), by at least its first ``depth`` tokens; ``tokens`` is padded."""
    n = len(tokens) - 2 * period
    member = np.zeros(period, bool)
    member[list(COVERS[period])] = True
    at = np.flatnonzero(np.tile(member, n // period + 2)[: n + period])
    order, new = _refine(_packed(np.append(tokens, np.zeros(period, np.int64)), at, period, bits))
    rank = np.zeros(len(tokens) + period, np.int64)
    rank[at[order]] = np.cumsum(new)
    known = period
    while known < depth and not new.all():  # doubling: a cover position plus a period is one again
        ahead = np.where(at + known < len(rank), rank[np.minimum(at + known, len(rank) - 1)], 0)
        order, new = _refine([rank[at], ahead])
        following = rank.copy()
        following[at[order]] = np.cumsum(new)
        rank, known = following, known * 2
    return rank


def suffix_array(tokens: np.ndarray, wanted: np.ndarray | None = None, depth: int | None = None, period: int = COVER_PERIOD, bucket: int = BUCKET) -> np.ndarray:
    """Positions of the wanted suffixes (all, if None) in ascending order; a suffix that ends is less than one that goes on.

    Suffixes are told apart by ``depth`` tokens at least (their whole length, if None); those still equal keep their order of position.
    """
    n = len(tokens)
    wanted = np.arange(n) if wanted is None else np.asarray(wanted)
    if not len(wanted):
        return wanted
    values, dense = np.unique(tokens, return_inverse=True)
    bits = max(1, int(len(values) + 1).bit_length())
    padded = np.zeros(n + 2 * period, np.int64)
    padded[:n] = dense + 1
    rank = cover_ranks(padded, period, max(depth or n, period), bits)
    offsets = _offsets(period)
    # buckets: ranges of the first two tokens, of about ``bucket`` suffixes each
    _, first, counts = np.unique(padded[wanted] << bits | padded[wanted + 1], return_inverse=True, return_counts=True)
    whole = ((np.cumsum(counts) - counts) // bucket)[first]
    by = np.argsort(whole, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(whole[by]) != 0, [True]]))
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = wanted[by[lo:hi]]
        order, new = _refine(_packed(padded, at, period, bits))
        at = at[order]
        out.append(_resolve(at, new, rank, offsets, period))
    return np.concatenate(out)


def _resolve(at: np.ndarray, new: np.ndarray, rank: np.ndarray, offsets: np.ndarray, period: int) -> np.ndarray:
    """Order runs of suffixes that agree on a period's tokens by cover ranks."""
    group = np.cumsum(new)
    residue = at % period
    own = rank[at + offsets[residue, residue]]
    order = np.lexsort((at, own, residue, group))  # right wherever a run has one residue
    out, res, grp = at[order], residue[order], group[order]
    mixed = np.unique(grp[1:][(grp[1:] == grp[:-1]) & (res[1:] != res[:-1])])
    for g in mixed:
        lo, hi = np.searchsorted(grp, g), np.searchsorted(grp, g, side="right")

        def less(i: int, j: int) -> int:
            d = offsets[i % period, j % period]
            return int(rank[i + d]) - int(rank[j + d]) or i - j

        out[lo:hi] = sorted(out[lo:hi].tolist(), key=cmp_to_key(less))
    return out


def winnow(hashes: np.ndarray, k: int = GRAM, least: int = LEAST) -> np.ndarray:
    """Positions of the anchors of a text: the least k-gram (the last of equals) of each window that ``least`` words hold."""
    rolling = grams(hashes, k)
    w, n = least - k + 1, len(rolling)
    if n < w:
        return np.zeros(0, np.int64)
    lows = _running(rolling, w, np.minimum, np.uint64(2**64 - 1))
    # the highest low of the windows that hold a position equals its hash just where it is the least of one of them
    around = np.zeros(len(lows) + 2 * (w - 1), np.uint64)
    around[w - 1 : w - 1 + len(lows)] = lows
    return np.flatnonzero(rolling == _running(around, w, np.maximum, np.uint64(0))[:n])


def _running(values: np.ndarray, w: int, best: np.ufunc, filler: np.uint64) -> np.ndarray:
    """The best of each w consecutive values, by running bests from both ends of blocks of w (van Herk)."""
    n = len(values)
    full = np.full(-(-n // w) * w, filler)
    full[:n] = values
    blocks = full.reshape(-1, w)
    left = best.accumulate(blocks, 1).ravel()
    right = best.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return best(right[: n - w + 1], left[w - 1 : n])


SPOTS = "anchor bigint, doc_id bigint, at int, lead int, size int, kind bigint, left int, right int"


def anchors(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """See SPOTS: anchors of each text with the place, length and hash of the words around them, and hashes of half as many words left and right of them (0 where there are fewer)."""
    side = least - gram
    half = max(1, -(-side // 2))

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch):
            found = words(part.column("text"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            out: dict[str, list] = {k.split(" ")[0]: [] for k in SPOTS.split(", ")}
            for i in np.flatnonzero(np.diff(found.first) >= least):
                own = found.of(i)
                at = winnow(own, gram, least)
                if not len(at):
                    continue
                lead = np.minimum(at, side)
                size = np.minimum(at + least, len(own)) - at + lead
                whole = grams(own, 2 * side + gram)
                kind = np.empty(len(at), np.uint64)
                full = size == 2 * side + gram
                kind[full] = whole[at[full] - side]
                for j in np.flatnonzero(~full):
                    kind[j] = grams(own[at[j] - lead[j] : at[j] - lead[j] + size[j]], int(size[j]))[0]
                beside = (grams(own, half) >> np.uint64(33)).astype(np.int32) + 1
                out["anchor"].append(grams(own, gram)[at])
                out["doc_id"].append(np.full(len(at), ids[i], np.int64))
                out["at"].append(at.astype(np.int32))
                out["lead"].append(lead.astype(np.int32))
                out["size"].append(size.astype(np.int32))
                out["kind"].append(mix(kind + mix(lead.astype(np.uint64) << np.uint64(32) | size.astype(np.uint64))))
                out["left"].append(np.where(at >= half, beside[np.maximum(at - half, 0)], 0))
                out["right"].append(np.where(at + gram + half <= len(own), beside[np.minimum(at + gram, len(beside) - 1)], 0))
            if out["at"]:
                columns = {k: np.concatenate(v) for k, v in out.items()}
                yield columns | {k: columns[k].view(np.int64) for k in ("anchor", "kind")}

    return map_batches(texts(docs), work, SPOTS)


def _compare(windows: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Repeats between the windows of each key; rows come sorted by key."""
    empty = pd.DataFrame({"doc_id": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "stop": np.zeros(0, np.int64)})
    rest = None
    for pdf in windows:
        if not len(pdf):
            continue
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if len(rest) < WINDOWS:
            continue
        anchor = rest["key"].to_numpy()
        last = int(np.searchsorted(anchor, anchor[-1]))
        if last:
            yield _repeats(rest.iloc[:last], least)
            rest = rest.iloc[last:]
    yield _repeats(rest, least) if rest is not None and len(rest) else empty


def _repeats(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """(doc_id, start, stop) of the repeats of ``least`` words within each key's windows, by one suffix array."""
    lead = pdf["lead"].to_numpy().astype(np.int64)
    sizes = pdf["size"].to_numpy().astype(np.int64)
    side = int(lead.max())
    stride = -(-int((side - lead + sizes).max() + 1) // COVER_PERIOD) * COVER_PERIOD
    count = len(pdf)
    begin = np.arange(count) * stride + side - lead  # an anchor lies at the same place of its stride in every window
    flat = np.frombuffer(b"".join(pdf["words"]), np.uint64)
    spot = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(flat))
    tokens = np.zeros(count * stride, np.uint64)
    tokens[spot] = np.maximum(flat, np.uint64(1))
    starts = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes - least + 1)[:-1]]), sizes - least + 1) + np.arange(int((sizes - least + 1).sum()))
    order = suffix_array(tokens, starts, depth=least)
    same = grams(tokens, least)[order]
    window = order // stride
    anchor = pdf["key"].to_numpy()[window]
    doc = pdf["doc_id"].to_numpy()[window]
    place = (pdf["at"].to_numpy().astype(np.int64) - lead)[window] + order - begin[window]
    # equal runs of the array, split by key (stable, so the suffix order stays inside)
    run = np.cumsum(np.concatenate([[0], (same[1:] != same[:-1]).astype(np.int64)]))
    by = np.lexsort((place, doc, anchor, run))
    run, anchor, doc, place = run[by], anchor[by], doc[by], place[by]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (anchor[1:] != anchor[:-1])])
    other = np.concatenate([[False], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]) & ~new
    group = np.cumsum(new) - 1
    several = np.bincount(group, other)[group] > 0  # at two places at least
    doc, place = doc[several], place[several]
    by = np.lexsort((place, doc))
    doc, place = doc[by], place[by]
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)])[: len(doc)]
    at = np.flatnonzero(head)
    ends = np.append(at[1:], len(doc)) - 1 if len(at) else at
    return pd.DataFrame({"doc_id": doc[at], "start": place[at], "stop": place[ends] + least})


def repeats(docs: DataFrame, least: int = LEAST, gram: int | None = None, hot: int = HOT, skewed: int = SKEWED) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): each text's words that lie in a run of ``least`` words that occurs elsewhere too.

    Runs that touch or overlap are joined. Words are those of sheaf.llm.words, numbered from 0; end_word is exclusive. Texts of fewer words (null and empty ones too)
    have none; very long texts are taken whole; a repeat within a text counts; rows without doc_id are left out; rows that repeat a doc_id count as one document,
    and passages they share at the same place don't repeat by that alone; other columns don't matter; an empty table gives none. How many places make an anchor
    ``hot`` or ``skewed`` changes the way, not the result.
    """
    if least < 2:
        raise ValueError("least must be 2 at least")
    gram = (least + 1) // 2 if gram is None else gram
    own = texts(docs)
    spots = materialize(anchors(own, least, gram), "suffix-spots")
    busy = _skewed(spots, skewed)
    shared = materialize(_counted(spots.where(~F.col("anchor").isin(busy)) if busy else spots), "suffix-anchors")
    met = _place(shared.where("proven"), least)
    # (key, doc_id, at, lead, size): one window of each kind of an anchor that has several
    single = shared.where("first AND several").where(F.col("size") >= least)
    few = single.where(F.col("n") <= hot)
    many = single.where(F.col("n") > hot).select("anchor", "doc_id", "at", "lead", "size", "left", "right")
    if busy:
        kinds, proven = _kinds(spots.where(F.col("anchor").isin(busy)), least)
        met, many = met.unionByName(proven), many.unionByName(kinds)
    else:
        discard(spots)
    beside = materialize(_beside(many), "suffix-beside")
    crowds = materialize(beside.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-crowds")
    close = beside.join(crowds.where(F.col("n") <= hot), "key", "left_semi")
    meeting = few.select(F.col("anchor").alias("key"), "doc_id", "at", "lead", "size").unionByName(close)
    compared = _windows(own, meeting, gram).repartition("key").sortWithinPartitions("key").mapInPandas(lambda it: _compare(it, least), "doc_id bigint, start bigint, stop bigint")
    met = met.unionByName(compared)
    if not crowds.where(F.col("n") > hot).isEmpty():
        met = met.unionByName(_by_runs(own, beside.join(crowds.where(F.col("n") > hot), "key", "left_semi").drop("key").distinct().withColumn("key", F.lit(0).cast("bigint")), least, gram))
    line = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = met.withColumn("reach", reach).withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(line))
    return (
        islands.groupBy("doc_id", "island")
        .agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
    )


def _skewed(spots: DataFrame, most: int) -> list[int]:
    """Anchors of more than ``most`` places, by frequent-item counters of each partition, merged in two steps."""
    if spots.count() <= most:
        return []
    some = spots.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(anchor, {COUNTERS})").alias("state"))
    found = some.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(state, {COUNTERS}), {SKEWED_ANCHORS})").alias("top")).first()["top"]
    return [r["item"] for r in found or () if r["count"] > most]


def _counted(spots: DataFrame) -> DataFrame:
    """Spots of anchors that occur more than once: ``proven`` by an equal window elsewhere, ``first`` of their kind, ``several`` kinds, ``n`` places."""
    # one order serves all windows
    everything = (Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = Window.partitionBy("anchor", "kind").orderBy("doc_id", "at")
    all_kinds = kinds.rowsBetween(*everything)
    return (
        spots.withColumn("alike", F.count(F.lit(1)).over(all_kinds))
        .withColumn("lo", F.min(F.struct("doc_id", "at")).over(all_kinds))
        .withColumn("hi", F.max(F.struct("doc_id", "at")).over(all_kinds))
        .withColumn("nth", F.row_number().over(kinds))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor").orderBy("kind", "doc_id", "at").rowsBetween(*everything)))
        .where("n > 1")
        .select("anchor", "doc_id", "at", "lead", "size", "left", "right", "n", (F.col("lo") != F.col("hi")).alias("proven"), (F.col("nth") == 1).alias("first"), (F.col("n") > F.col("alike")).alias("several"))
    )


def _kinds(spots: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Of skewed anchors: one window of each kind, and (doc_id, start, stop) of windows that have an equal one elsewhere; all counting combines on the map side."""
    whole = spots.where(F.col("size") >= least)
    kinds = materialize(whole.groupBy("anchor", "kind").agg(F.min(F.struct("doc_id", "at", "lead", "size", "left", "right")).alias("lo"), F.max(F.struct("doc_id", "at")).alias("hi")), "suffix-kinds")
    repeated = kinds.where("lo.doc_id <> hi.doc_id OR lo.at <> hi.at").select("anchor", "kind")
    return kinds.select("anchor", "lo.*"), _place(whole.join(repeated, ["anchor", "kind"], "left_semi"), least)


def _beside(spots: DataFrame) -> DataFrame:
    """(key, doc_id, at, lead, size): each window under its anchor with the words left of it, and with those right of it."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("words")), F.struct(F.lit(1).alias("side"), F.col("right").alias("words")))
    each = spots.select("anchor", "doc_id", "at", "lead", "size", F.explode(sides).alias("beside")).where("beside.words <> 0")
    return each.select(F.xxhash64("anchor", "beside.side", "beside.words").alias("key"), "doc_id", "at", "lead", "size")


def _place(spots: DataFrame, least: int) -> DataFrame:
    """(doc_id, start, stop) of the whole windows of spots that hold ``least`` words."""
    start = F.col("at") - F.col("lead")
    return spots.where(F.col("size") >= least).select("doc_id", start.cast("bigint").alias("start"), (start + F.col("size")).cast("bigint").alias("stop"))


def _windows(own: DataFrame, spots: DataFrame, gram: int) -> DataFrame:
    """(key, doc_id, at, lead, size, words): the word hashes of the windows of spots (key, doc_id, at, lead, size)."""
    wanted = spots.groupBy("doc_id").agg(F.collect_list(F.struct("key", "at", "lead", "size")).alias("spots"))

    def fetch(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch):
            found = words(part.column("text"))
            out: dict[str, list] = {k: [] for k in ("key", "doc_id", "at", "lead", "size", "words")}
            for i, (doc, spots) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("spots").to_pylist(), strict=True)):
                hashes = found.of(i)
                for s in spots:
                    a = s["at"] - s["lead"]
                    if a + s["size"] <= len(hashes) and s["at"] + gram <= len(hashes):
                        for k in ("key", "at", "lead", "size"):
                            out[k].append(s[k])
                        out["doc_id"].append(doc)
                        out["words"].append(hashes[a : a + s["size"]].tobytes())
            yield out

    return map_batches(own.join(wanted, "doc_id").select("doc_id", "text", "spots"), fetch, "key bigint, doc_id bigint, at int, lead int, size int, words binary")


def _by_runs(own: DataFrame, spots: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, start, stop) of repeats between windows, by counting the hashes of all their runs."""

    def runs(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"run": [], "doc_id": [], "start": []}
        for doc, at, lead, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "lead", "words")), strict=True):
            run = grams(np.frombuffer(raw, np.uint64), least)
            out["run"].append(run)
            out["doc_id"].append(np.full(len(run), doc, np.int64))
            out["start"].append(at - lead + np.arange(len(run)))
        if out["run"]:
            columns = {k: np.concatenate(v) for k, v in out.items()}
            yield columns | {"run": columns["run"].view(np.int64)}

    each = materialize(map_batches(_windows(own, spots, gram), runs, "run bigint, doc_id bigint, start bigint"), "suffix-runs")
    counted = each.groupBy("run").agg(F.min(F.struct("doc_id", "start")).alias("lo"), F.max(F.struct("doc_id", "start")).alias("hi")).where("lo <> hi").select("run")
    return each.join(counted, "run", "left_semi").select("doc_id", "start", (F.col("start") + least).alias("stop"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
