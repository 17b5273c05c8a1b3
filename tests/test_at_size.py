"""Work that follows the input: rows that no step may make more of, groups that no task may hold whole."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheaf.functions import wikitext as W
from sheaf.operators import linkage as L
from sheaf.operators.components import connected_components
from sheaf.operators import lookups as K
from sheaf.operators import metrics as M
from sheaf.operators import ontology as O
from sheaf.operators import triples as T
from sheaf.sources import sinks as S


def most_rows(df) -> int:
    """The most rows that any step of the plan gave; runs the query."""
    df.collect()

    def walk(node) -> int:
        metric = node.metrics().get("numOutputRows")
        own = int(metric.get().value()) if metric.isDefined() else 0
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ResultQueryStageExec": "plan"}.get(node.getClass().getSimpleName())
        below = [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
        return max([own, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_popular_on_key_makes_no_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), "a" if i < 1500 else None if i % 7 == 0 else "b", int(i % 2) if i < 1990 else None) for i in range(2000)] + [(3, "b", 0)]
    part = spark.createDataFrame(rows, "id long, k string, m int")
    pop = spark.createDataFrame([(int(i), int(rng.integers(1, 4))) for i in rng.choice(2000, 1200, False)], "dst long, popularity long")
    left, right = part.select(F.col("id").alias("src"), "k", "m"), part.select(F.col("id").alias("dst"), "k", "m")
    found = L.popular_on_key(left, right, ["k", "m"], pop)
    assert most_rows(found) < 10_000
    want = L.by_popularity(left.join(right, ["k", "m"]).select("src", "dst"), pop)
    assert most_rows(want) > 500_000 and sorted(found.collect()) == sorted(want.collect()) and found.columns == want.columns


def test_rerank_on_key_scores_labels_once(spark):
    words = "red green blue".split()
    labels = [f"{a} {b} {i % 3}" for i, (a, b) in enumerate((a, b) for a in words for b in "bolt ring nut".split())]
    mentions = spark.createDataFrame([(i, labels[i % 9]) for i in range(900)] + [(5, labels[3]), (6, "unseen word"), (7, None), (8, "red cap 7")], "id long, label string")
    entities = spark.createDataFrame([(100 + i, x) for i, x in enumerate(reversed(labels))] + [(50, labels[4]), (60, "green nut 9")], "id long, label string")
    first = lambda c: F.split(c, " ")[0]
    found = L.rerank_on_key(mentions, entities, first)
    assert most_rows(found) < 2000
    both = mentions.distinct().select(F.col("id").alias("src"), F.col("label").alias("a"), first("label").alias("k")).join(entities.select(F.col("id").alias("dst"), F.col("label").alias("b"), first("label").alias("k")), "k")
    want = L.best(both.select("src", "dst", L.jaccard(F.col("a"), F.col("b")).alias("score")))
    assert most_rows(want) > 2500 and sorted(found.collect()) == sorted(want.collect())


def test_parsed_pages_leave_a_few_at_a_time(spark, monkeypatch):
    held = spark.sparkContext.accumulator(0)

    def parse(title, markup):
        import gc

        held.add(max(0, sum(isinstance(x, dict) and "mentions" in x for x in gc.get_objects()) - 2 * W.BATCH_ROWS))
        return [{"listing": 0, "kind": "enum", "top_section": "", "section": "", "item": i, "cell": 0, "depth": 1, "tokens": [markup], "mentions": [{"start": 0, "stop": 1, "target": "T"}]} for i in range(500)]

    monkeypatch.setattr(W, "parse_page", parse)
    pages = spark.range(40, numPartitions=1).select(F.col("id").cast("string").alias("title"), F.lit("x").alias("text"))
    assert W.parse_pages(pages).count() == 40 * 500 and held.value == 0


def test_plain_text_without_markup_is_as_before():
    assert W.plain("  a b\x1c \t c 'd' ") == "a b c 'd'" and W.plain("''x'' & y") == "x & y"


def test_neighbours_by_tiles_are_those_of_all_products(spark, monkeypatch):
    """Several slabs and blocks, copies by the hundred (ties), tiny, huge and broken vectors, repeated ids; within one table and between two."""
    monkeypatch.setattr(L, "SLAB", 300)
    monkeypatch.setattr(L, "BLOCKS", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1700, 12)).astype(np.float32)
    x[:420] = x[0]
    x[500:520] *= 1e-12
    x[530:540] *= 1e16
    x[541, 3], x[542, 5] = np.nan, np.inf
    ids = np.arange(1700) * 3
    ids[-2:] = ids[700]
    v = spark.createDataFrame(pd.DataFrame({"id": ids, "vector": list(x)}), "id long, vector array<float>")
    few = v.where("id % 7 = 0")

    def want(q, c):
        with np.errstate(all="ignore"):
            s = np.round(x[q].astype(np.float64) @ x[c].astype(np.float64).T, 9)
        s[(ids[q][:, None] == ids[c][None, :]) | ~np.isfinite(s)] = -np.inf
        best = {}
        for i, row in zip(ids[q], s, strict=True):
            best.setdefault(int(i), []).extend((-a, int(b)) for a, b in zip(row, ids[c], strict=True) if np.isfinite(a))
        return sorted((i, d) for i, found in best.items() for _, d in sorted(found)[:4])

    every = np.arange(1700)
    got = lambda df: sorted((r["src"], r["dst"]) for r in df.collect())
    once = lambda pairs, odd: [p for p in pairs if p[0] not in odd]
    odd = {int(i) for i in ids[530:540]}  # products of 1e16 differ by more than 9 digits hold
    assert once(got(L.nearest(v, v, 4)), odd) == once(want(every, every), odd)
    assert once(got(L.nearest(few, v, 4)), odd) == once(want(every[ids % 7 == 0], every), odd)


def test_tiles_leave_few_to_work_out(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = (L._Best(np.arange(2000) + lo, rng.normal(size=(2000, 16)).astype(np.float32), 4) for lo in (0, 5000))
    worked = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *x: worked.append(len(x[1])) or einsum(*x))
    for _ in range(2):
        a.offer(b, a.fast @ b.fast.T, 0, True)
    assert sum(worked) < 2000 * 2000 / 100


def test_precision_recall_of_labels_lists_no_pairs(spark):
    rng = np.random.default_rng(5)
    labels = spark.createDataFrame([(int(i), None if i % 50 == 0 else int(i % 3)) for i in range(1200)], "id long, label int")
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 1220, (900, 2))] + [(7, 10)] * 2, "src long, dst long")
    found = M.precision_recall_of_labels(pairs, labels)
    assert most_rows(found) < 5000
    gold = labels.withColumnRenamed("id", "src").join(labels.withColumnRenamed("id", "dst"), "label").where("src <> dst")
    want = M.precision_recall(pairs, gold, ["src", "dst"])
    assert most_rows(want) > 100_000 and found.collect() == want.collect() and found.columns == want.columns
    none = M.precision_recall_of_labels(pairs.where("false"), labels.where("false")).first()
    assert tuple(none) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_matching_pairs_of_a_common_entity_are_spread(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARE", 10)
    alignment = spark.createDataFrame([(i, 1 if i < 400 else 2) for i in range(420)] + [(500, None)], "mention long, entity int")
    found = L.training_pairs(alignment, spark.createDataFrame([(1, 410, 0.5), (1, 411, 0.5), (2, 3, 0.9)], "src long, dst long, score double"))
    rows = found.withColumn("p", F.spark_partition_id()).collect()
    want = [(a, b, 1) for lo, hi in ((0, 400), (400, 420)) for a in range(lo, hi) for b in range(a + 1, hi)] + [(1, 410, 0)]
    assert sorted(tuple(r)[:3] for r in rows) == sorted(want)
    assert pd.Series([r["p"] for r in rows]).value_counts().max() < 0.6 * len(want)


def test_type_distribution_carries_counts_up(spark):
    types = spark.createDataFrame([(f"e{i}", "leaf" if i % 2 else "other") for i in range(3000)], "ent string, type string")
    paths = spark.createDataFrame([("mid", "leaf", 1), ("top", "leaf", 2), ("top", "leaf", 3), ("top", "mid", 1), ("leaf", "leaf", 2)], "ancestor string, descendant string, depth int")
    found = S.type_distribution(types, paths)
    assert {tuple(r) for r in found.collect()} == {("leaf", 1500), ("mid", 1500), ("top", 1500), ("other", 1500)}
    assert most_rows(found) <= 3000


def test_category_frequencies_count_as_they_join(spark):
    members = spark.createDataFrame([(c, f"e{i}") for i in range(300) for c in "ab"] * 2 + [("a", None)], "cat string, ent string")
    props = spark.createDataFrame([(f"e{i}", "p", str(i % 2)) for i in range(300)] * 2, "ent string, pred string, value string")
    found = T.category_property_frequency(members, props)
    assert {(r["cat"], r["value"], round(r["freq"], 4)) for r in found.collect()} == {(c, v, round(150 / n, 4)) for c, n in (("a", 601), ("b", 600)) for v in "01"}
    assert found._jdf.queryExecution().executedPlan().toString().count("count(distinct") == 0 and most_rows(found) < 1300


def test_listing_types_merge_in_batches(spark):
    found = [(f"e{i}", o, t, n) for i in range(2500) for o, t, n in (("p", "A", 3), ("p", "B", 1), ("q", "C", 2), (None, "D", 5))]
    known = [(f"e{i}", "K") for i in range(0, 2500, 2)] + [("x", "K")]
    disjoint = spark.createDataFrame([("A", "B"), ("B", "A"), ("K", "C"), ("C", "K")], "a string, b string")
    got = O.merge_listing_types(spark.createDataFrame(found, "ent string, origin string, type string, n int"), spark.createDataFrame(known, "ent string, type string"), disjoint)
    assert sorted(map(tuple, got.collect())) == sorted((f"e{i}", t) for i in range(2500) for t in (["D"] if i % 2 == 0 else ["C", "D"]))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_gold_subjects_keep_a_mention_one_row(spark):
    mentions = spark.createDataFrame([(i % 4, 0, i, i % 50) for i in range(400)] * 2 + [(0, None, 7, 0), (9, 0, 1, 1), (1, 0, 2, None)], "page int, listing int, item int, ent int")
    types = spark.createDataFrame([(e, f"t{(e + j) % 30}") for e in range(45) for j in range(10)] + [(3, None)], "ent int, type string")
    pages = spark.createDataFrame([(p, f"t{p * 5 + j}") for p in range(4) for j in range(8)] + [(2, None)], "page int, type string")
    found = K.gold_subjects(mentions, types, pages)
    assert most_rows(found) < 1500
    own, asked = ({} for _ in range(2))
    for d, rows in ((own, types.collect()), (asked, pages.collect())):
        for k, t in rows:
            d.setdefault(k, set()).add(t)
    want = {(p, n, i, e): int(bool((own.get(e, set()) & asked[p]) - {None})) for p, n, i, e in map(tuple, mentions.collect()) if p in asked}
    assert {tuple(r)[:4]: r["label"] for r in found.collect()} == want and found.count() == len(want)


def test_components_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def edges(parts):
        for pdf in parts:
            made.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (7, 6), (None, 1)], "src long, dst long").mapInPandas(edges, "src long, dst long")
    found = connected_components(rows)
    for _ in range(2):
        assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 6), (7, 6)}
    assert made.value == 5
    none = connected_components(rows.where("src > 100"))
    assert none.count() == 0
