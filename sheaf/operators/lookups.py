"""Keyed lookups as joins: parts of nodes, output and seed resources, synonyms and hypernyms, sub-word labels, equivalent types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.components import connected_components
from sheaf.operators.hierarchy import closure, disjoint_closure
from sheaf.operators.triples import resolve_redirects


def node_parts(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, part): the resources that a node stands for, itself and all that were merged into it; nodes (node), merged (node, target)."""
    gone = merged.select("node").distinct()
    return nodes.select("node").distinct().join(gone, "node", "left_anti").select("node", F.col("node").alias("part")).unionByName(merged.select(F.col("target").alias("node"), F.col("node").alias("part"))).distinct()


def types_of_seed(parts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, type): output types of seed types, categories or lists, by the parts (node, part) that name them; a seed without any has a null type."""
    return seeds.select("seed").distinct().join(parts.select(F.col("part").alias("seed"), F.col("node").alias("type")), "seed", "left").distinct()


def entity_of_seed(seeds: DataFrame, redirects: DataFrame, entities: DataFrame, distance: int = 2) -> DataFrame:
    """(seed, ent): the output entity of a seed resource: of its own name, after a redirect that corrects its spelling; null where there is none."""
    folded = resolve_redirects(seeds.select("seed", F.col("seed").alias("name")), "name", redirects, spelling_only=True, distance=distance)
    return folded.join(entities.select(F.col("ent").alias("name"), "ent"), "name", "left").select("seed", "ent").distinct()


def synonymous(pairs: DataFrame, synonyms: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with ``synonym``: equal words, title-case words of which one begins with the other, and words within a synonym of the other.

    synonyms: (word, synonym), in any one direction. Empty and null words are no synonyms of anything.
    """
    of = synonyms.groupBy("word").agg(F.collect_set("synonym").alias("all"))
    x, y = F.col(a), F.col(b)
    rows = pairs.join(of.select(F.col("word").alias(a), F.col("all").alias("__a")), a, "left").join(of.select(F.col("word").alias(b), F.col("all").alias("__b")), b, "left")
    title = lambda c: c == F.initcap(c)
    begins = (title(x) | title(y)) & (F.lower(x).startswith(F.lower(y)) | F.lower(y).startswith(F.lower(x)))
    listed = F.exists("__b", lambda s: s.contains(x)) | F.exists("__a", lambda s: s.contains(y))
    full = (F.coalesce(F.length(x), F.lit(0)) > 0) & (F.coalesce(F.length(y), F.lit(0)) > 0)
    return rows.withColumn("synonym", full & F.coalesce((x == y) | begins | F.coalesce(listed, F.exists("__b", lambda s: s.contains(x)), F.exists("__a", lambda s: s.contains(y)), F.lit(False)), F.lit(False))).drop("__a", "__b")


def hypernymous(pairs: DataFrame, synonyms: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """pairs (hyper, hypo) with ``hypernym``: synonyms, and pairs that hypernyms (hyper, hypo), lower-case, list."""
    known = hypernyms.select(F.col("hyper").alias("__hyper"), F.col("hypo").alias("__hypo"), F.lit(True).alias("__listed")).distinct()
    rows = synonymous(pairs, synonyms, "hyper", "hypo")
    joined = rows.join(known, (F.lower("hyper") == F.col("__hyper")) & (F.lower("hypo") == F.col("__hypo")), "left")
    return joined.select("hyper", "hypo", (F.col("synonym") | F.coalesce("__listed", F.lit(False))).alias("hypernym"))


def variations(texts: DataFrame, synonyms: DataFrame, distance: int = 2) -> DataFrame:
    """(text, variation): synonyms of a text that differ from it by at most ``distance`` edits; spaces count as underscores in the synonym table."""
    named = texts.select("text", F.translate("text", " ", "_").alias("word")).distinct().join(synonyms, "word")
    return named.where(F.levenshtein(F.col("synonym"), F.col("word"), distance) >= 0).select("text", F.translate("synonym", "_", " ").alias("variation")).distinct()


def equivalence_classes(equivalents: DataFrame, types: DataFrame) -> DataFrame:
    """(type, main): the least type of each type's class under equivalents (a, b); a type without equivalents is its own."""
    groups = connected_components(equivalents, "a", "b").select(F.col("node").alias("type"), F.col("component").alias("main"))
    return types.select("type").distinct().join(groups, "type", "left").select("type", F.coalesce("main", "type").alias("main"))


def equivalent_closure(edges: DataFrame, equivalents: DataFrame) -> DataFrame:
    """(ancestor, descendant) over subclasses (parent, child) where equivalent types share their ancestors and descendants; equivalents aren't each other's ancestors."""
    types = edges.select(F.explode(F.array("parent", "child")).alias("type")).unionByName(equivalents.select(F.explode(F.array("a", "b")).alias("type"))).where("type IS NOT NULL")
    classes = equivalence_classes(equivalents, types)
    own = lambda end: classes.select(F.col("type").alias(end), F.col("main").alias(f"m_{end}"))
    mains = edges.join(own("parent"), "parent").join(own("child"), "child").where("m_parent <> m_child").select(F.col("m_parent").alias("parent"), F.col("m_child").alias("child")).distinct()
    paths = closure(mains).select("ancestor", "descendant").where("ancestor <> descendant")
    back = lambda end: classes.select(F.col("main").alias(end), F.col("type").alias(f"t_{end}"))
    return paths.join(back("ancestor"), "ancestor").join(back("descendant"), "descendant").select(F.col("t_ancestor").alias("ancestor"), F.col("t_descendant").alias("descendant")).distinct()


def corrected_disjoint(disjoint: DataFrame, added: DataFrame, removed: DataFrame, paths: DataFrame) -> DataFrame:
    """(a, b) in both directions, spread to subtypes: official disjoint types (a, b) without the ``removed`` pairs and with the ``added`` ones, whichever way round they are given."""
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    kept = ordered(disjoint).join(ordered(removed), ["a", "b"], "left_anti").unionByName(ordered(added)).distinct()
    return disjoint_closure(kept, paths)


def subword_labels(labels: Column, words: Column, ignored: int = -100) -> Column:
    """Label of each sub-word: the word's at its first one, ``ignored`` at its others and where the word index (from 0) is null."""
    before = lambda i: F.when(i > 0, F.get(words, i - 1))
    return F.transform(words, lambda w, i: F.when(w.isNull() | F.coalesce(w == before(i), F.lit(False)), F.lit(ignored)).otherwise(F.get(labels, w)))


def gold_subjects(mentions: DataFrame, types: DataFrame, page_types: DataFrame) -> DataFrame:
    """(page, listing, item, ent, label): 1 for a mention (page, listing, item, ent) of an entity with a type that the page's listings are of, 0 for one without."""
    wanted = page_types.groupBy("page").agg(F.collect_set("type").alias("wanted"))
    own = types.groupBy("ent").agg(F.collect_set("type").alias("own"))
    rows = mentions.select("page", "listing", "item", "ent").join(wanted, "page").join(own, "ent", "left")
    hit = F.coalesce(F.arrays_overlap("wanted", "own"), F.lit(False)).cast("int")  # a page's types and an entity's are few: a mention stays one row
    return rows.groupBy("page", "listing", "item", "ent").agg(F.max(hit).alias("label"))
