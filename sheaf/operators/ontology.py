"""Building the output ontology: category and list graphs, their merge, the mapping to seed types, and entities with their facts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import lexical_head, same_words
from sheaf.operators import hierarchy as H
from sheaf.session import materialize

LEX_DEFAULT, MAPPING_LEAST, NODE_ENTITIES = 0.2, 0.17, 5


def conceptual(edges: DataFrame, labels: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the categories whose head words are plural, and the root; labels (node, label)."""
    good = labels.withColumn("h", lexical_head("label")).where(F.col("h.plural") | (F.col("node") == root)).select("node")
    kept = edges.join(good.withColumnRenamed("node", "parent"), "parent", "left_semi").join(good.withColumnRenamed("node", "child"), "child", "left_semi")
    return good, kept.select("parent", "child")


def without_leaf_lists(edges: DataFrame, is_list_category: DataFrame) -> DataFrame:
    """Edges without list categories that have no children; (node) names the list categories."""
    leaves = is_list_category.join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    return edges.join(leaves.select(F.col("node").alias("child")), "child", "left_anti").select("parent", "child")


def list_categories(lists: DataFrame, candidates: DataFrame, categories: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(list, cat, how): equal labels ('-' as space, case aside) first; else a candidate with the same words; else the only synonymous candidate.

    lists, categories (id, label); candidates (list, cat); synonyms (a, b) of words.
    """
    plain = lambda c: F.lower(F.translate(c, "-", " "))
    equal = lists.select(F.col("id").alias("list"), plain("label").alias("k")).join(categories.select(F.col("id").alias("cat"), plain("label").alias("k")), "k").select("list", "cat", F.lit("equal").alias("how"))
    rest = candidates.join(equal.select("list").distinct(), "list", "left_anti").join(lists.select(F.col("id").alias("list"), plain("label").alias("a")), "list").join(categories.select(F.col("id").alias("cat"), plain("label").alias("b")), "cat")
    words = rest.where(same_words(F.col("a"), F.col("b"))).select("list", "cat", F.lit("words").alias("how"))
    left = rest.join(words.select("list").distinct(), "list", "left_anti")
    w = left.select("list", "cat", F.explode(F.array_distinct(F.split("a", " "))).alias("w"), F.array_distinct(F.split("b", " ")).alias("b"))
    both = synonyms.unionByName(synonyms.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("w")).agg(F.collect_set("b").alias("alike"))
    checked = w.join(both, "w", "left").withColumn("ok", F.array_contains("b", F.col("w")) | F.coalesce(F.arrays_overlap("b", "alike"), F.lit(False)))
    alike = checked.groupBy("list", "cat").agg(F.min("ok").alias("ok")).where("ok")
    one = alike.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("list"))).where("n = 1").select("list", "cat", F.lit("synonym").alias("how"))
    return equal.unionByName(words).unionByName(one)


def merge_graphs(base: DataFrame, base_labels: DataFrame, other: DataFrame, other_labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, (node, part)) of two graphs as one: nodes of equal normalised label (lower case, '-' and '_' as spaces) are one, named by the base's."""
    key = lambda c: F.lower(F.translate(c, "-_", "  "))
    names = base_labels.select(key("label").alias("k"), F.col("node").alias("name")).groupBy("k").agg(F.min("name").alias("name"))
    mapped = other_labels.select("node", key("label").alias("k")).join(names, "k", "left").select("node", F.coalesce("name", "node").alias("name"))
    for end in ("parent", "child"):
        other = other.join(mapped.select(F.col("node").alias(end), "name"), end).drop(end).withColumnRenamed("name", end)
    edges = base.select("parent", "child").unionByName(other.select("parent", "child")).where("parent <> child").distinct()
    parts = base_labels.select("node", F.col("node").alias("part")).unionByName(mapped.select(F.col("name").alias("node"), F.col("node").alias("part"))).distinct()
    return edges, parts


def type_resource_scores(members: DataFrame, types: DataFrame, least: int = NODE_ENTITIES) -> DataFrame:
    """(node, type, score): share of a node's entities with a transitive type, for nodes with ``least`` typed entities at least."""
    typed = members.join(types.select("ent").distinct(), "ent", "left_semi")
    size = typed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return typed.join(types, "ent").groupBy("node", "type").agg(F.count(F.lit(1)).alias("c")).join(size, "node").select("node", "type", (F.col("c") / F.col("n")).alias("score"))


def node_types(resource: DataFrame, lexical: DataFrame, paths: DataFrame, disjoint: DataFrame, least: float = MAPPING_LEAST) -> DataFrame:
    """(node, type, score): types tied at the largest lexical * resource score, if that is ``least`` at least, with their ancestors; those disjoint with a kept one go.

    lexical (node, type, score), 0.2 where it has none; disjoint (a, b) in both directions.
    """
    scored = resource.join(lexical.withColumnRenamed("score", "lex"), ["node", "type"], "left").select("node", "type", (F.col("score") * F.coalesce("lex", F.lit(LEX_DEFAULT))).alias("score"))
    best = scored.withColumn("top", F.max("score").over(Window.partitionBy("node"))).where((F.col("score") == F.col("top")) & (F.col("top") >= least)).select("node", "type", "score")
    above = best.join(paths, F.col("type") == F.col("descendant")).select("node", F.col("ancestor").alias("type"), "score")
    every = best.unionByName(above).groupBy("node", "type").agg(F.max("score").alias("score"))
    against = every.select("node", F.col("type").alias("a")).join(disjoint, "a").select("node", F.col("b").alias("type")).distinct()
    return every.join(against, ["node", "type"], "left_anti")


def propagate_types(mapped: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, type, score): each node also has its parents' types, with the largest score that reaches it."""
    current = materialize(mapped.groupBy("node", "type").agg(F.max("score").alias("score")), "mapping")
    for _ in range(max_rounds):
        down = current.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), "type", "score")
        following = materialize(current.unionByName(down).groupBy("node", "type").agg(F.max("score").alias("score")), "mapping")
        if not following.join(current, ["node", "type", "score"], "left_anti").limit(1).count():
            return following
        current = following
    raise RuntimeError("types did not settle")


def coherent_types(mapped: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(node, type, score): of a node's types, grouped greedily (falling score, then name) into sets without disjoint pairs, the one uniquely best set; else no type that conflicts."""
    pairs = mapped.select("node", F.col("type").alias("a")).join(disjoint, "a").join(mapped.select("node", F.col("type").alias("b")), ["node", "b"]).select("node", "a", "b")
    rows = mapped.join(pairs.groupBy("node", F.col("a").alias("type")).agg(F.collect_set("b").alias("against")), ["node", "type"], "left")
    calm = rows.groupBy("node").agg(F.count("against").alias("conflicts")).where("conflicts = 0").select("node")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "type"], ascending=[False, True])
        against = {t: set(a) if a is not None else set() for t, a in zip(pdf["type"], pdf["against"], strict=True)}
        score = dict(zip(pdf["type"], pdf["score"], strict=True))
        sets: list[list[str]] = []
        for t in pdf["type"]:
            fitting = [s for s in sets if not any(x in against[t] for x in s)]
            for s in fitting:
                s.append(t)
            if not fitting:
                sets.append([t] + [x for x in sets[0] if x not in against[t]] if sets else [t])
        totals = [sum(score[t] for t in s) for s in sets]
        best = max(totals)
        keep = set(sets[totals.index(best)]) if sum(abs(t - best) < 1e-12 for t in totals) == 1 else {t for t in score if not against[t]}
        out = pdf[pdf["type"].isin(keep)].sort_values("type")
        return out[["node", "type", "score"]]

    torn = rows.join(calm, "node", "left_anti").groupBy("node").applyInPandas(pick, "node string, type string, score double")
    return rows.join(calm, "node", "left_semi").select("node", "type", "score").unionByName(torn)


def conflicting_edges(edges: DataFrame, mapped: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Edges whose ends have types disjoint with each other."""
    up = edges.join(mapped.select(F.col("node").alias("parent"), F.col("type").alias("a")), "parent").join(mapped.select(F.col("node").alias("child"), F.col("type").alias("b")), "child")
    return up.join(disjoint, ["a", "b"], "left_semi").select("parent", "child").distinct()


def resolve_disjoint(edges: DataFrame, mapped: DataFrame, disjoint: DataFrame, root: str) -> DataFrame:
    """Edges without conflicts: conflicting ones go, top-down order aside, and a node that loses all parents hangs under the root."""
    kept = edges.join(conflicting_edges(edges, mapped, disjoint), ["parent", "child"], "left_anti").select("parent", "child")
    lost = edges.select("child").distinct().join(kept.select("child").distinct(), "child", "left_anti").where(F.col("child") != root)
    return kept.unionByName(lost.select(F.lit(root).alias("parent"), "child"))


def inherited_only(disjoint: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b) pairs that no parent of either end already has; disjoint in both directions."""
    for end, other in (("a", "b"), ("b", "a")):
        up = disjoint.join(edges.select(F.col("child").alias(end), "parent"), end).select(F.col("parent").alias(end), other, F.col(end).alias("own"))
        known = up.join(disjoint, ["a", "b"], "left_semi").select(F.col("own").alias(end), other).distinct()
        disjoint = disjoint.join(known, ["a", "b"], "left_anti")
    return disjoint


def clean_types(types: DataFrame, paths: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(ent, type) without types implied by others and without both ends of disjoint pairs of one entity."""
    own = H.independent(types, paths)
    against = own.select("ent", F.col("type").alias("a")).join(disjoint, "a").select("ent", F.col("b").alias("type")).distinct()
    return own.join(against, ["ent", "type"], "left_anti")


def merge_listing_types(found: DataFrame, known: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(ent, type): new types by falling occurrence (name of equals), each accepted one blocking what is disjoint with it and with known ones; an origin with a blocked type is dropped whole.

    found (ent, origin, type, n). Order matters only within an entity.
    """
    conflict = disjoint.groupBy("a").agg(F.array_join(F.collect_set("b"), "\n").alias("against"))
    rows = found.join(conflict, F.col("type") == F.col("a"), "left").drop("a").withColumn("is_known", F.lit(0))
    old = known.join(conflict, F.col("type") == F.col("a"), "left").select("ent", F.lit(None).cast("string").alias("origin"), "type", F.lit(0).cast("bigint").alias("n"), "against", F.lit(1).alias("is_known"))

    def merge(rows: list[dict]) -> list[str]:
        blocked: set[str] = set()
        sums: dict[str, int] = {}
        against: dict[str, str | None] = {}
        for r in rows:
            if r["is_known"]:
                blocked.update(r["against"].split("\n") if r["against"] is not None else ())
            elif r["type"] is not None:
                sums[r["type"]] = sums.get(r["type"], 0) + (r["n"] or 0)
                against[r["type"]] = r["against"]
        for t in sorted(sums, key=lambda t: (-sums[t], t)):
            if t not in blocked:
                blocked.update(against[t].split("\n") if against[t] is not None else ())
        fresh = [r for r in rows if not r["is_known"]]
        bad = {r["origin"] for r in fresh if r["type"] in blocked}
        return sorted({r["type"] for r in fresh if r["origin"] not in bad and r["type"] is not None})

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000).to_pylist()
                found = [(r["ent"], t) for r in part for t in merge(r["rows"])]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["ent", "type"])

    columns = ["ent", "origin", "type", "n", "against", "is_known"]
    fresh = rows.select("ent", F.col("origin").cast("string").alias("origin"), "type", F.col("n").cast("bigint").alias("n"), "against", "is_known")
    every = fresh.select(columns).unionByName(old.join(found.select("ent").distinct(), "ent", "left_semi").select(columns))
    # thousands of entities go to Python at once: most have a few rows
    return every.groupBy("ent").agg(F.collect_list(F.struct(*columns[1:])).alias("rows")).mapInArrow(work, "ent string, type string")
