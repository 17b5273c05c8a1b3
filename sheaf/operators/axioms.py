"""Category sets, their textual patterns, and the type and relation axioms that patterns give to categories."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_SCORE = 0.05


def category_sets(children: DataFrame) -> DataFrame:
    """(set_id, parent, child, front, back) of candidate sets; children (parent, child, label).

    Under each parent the labels are split again and again by the most frequent word at the next place from the front or back, the
    front and the lesser word first of equals, as long as it joins two labels at least and half of those at hand. A split set keeps its pattern; what doesn't
    fit goes on on its own.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        parent = pdf["parent"].iloc[0]
        docs = sorted({(c, tuple((label or "").split(" "))) for c, label in zip(pdf["child"], pdf["label"], strict=True)})
        found: list[tuple[tuple, tuple, list]] = []
        todo = [(docs, (), ())]
        while todo:
            here, front, back = todo.pop()
            best = None
            for place in (len(front), -1 - len(back)):
                counts = Counter(w[place] for _, w in here if len(w) > len(front) + len(back) + 1)
                if counts:
                    word, n = min(counts.items(), key=lambda x: (-x[1], x[0]))
                    if best is None or n > best[0]:
                        best = (n, place, word)
            if best is None or best[0] < 2 or 2 * best[0] < len(here):
                if front or back:
                    found.append((front, back, here))
                continue
            _, place, word = best
            inside = [d for d in here if len(d[1]) > len(front) + len(back) + 1 and d[1][place] == word]
            outside = [d for d in here if d not in inside]
            todo.append((inside, (*front, word) if place >= 0 else front, back if place >= 0 else (word, *back)))
            if len(outside) > 1:
                todo.append((outside, front, back))
        rows = [(f"{parent}|{' '.join(f)}|{' '.join(b)}", parent, c, list(f), list(b)) for f, b, members in found for c, _ in members]
        return pd.DataFrame(rows, columns=["set_id", "parent", "child", "front", "back"])

    return children.groupBy("parent").applyInPandas(split, "set_id string, parent string, child string, front array<string>, back array<string>")


def variable_text(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(set_id, child, text): what is left of a child's label (child, label) between its set's front and back; empty ones dropped."""
    words = F.split("label", " ")
    n = F.size(words) - F.size("front") - F.size("back")
    rows = sets.join(labels, "child").where(n > 0)
    return rows.select("set_id", "child", F.array_join(F.slice(words, F.size("front") + 1, n), " ").alias("text"))


def value_scores(texts: DataFrame, entities: DataFrame, references: DataFrame) -> DataFrame:
    """(text, value, score): the text itself and an entity of its name score 1, but an entity that it is known to refer to scores by frequency.

    entities (name); references (form, ent, freq).
    """
    distinct = texts.select("text").distinct()
    sure = distinct.select("text", F.col("text").alias("value"), F.lit(1.0).alias("score"), F.lit(0).alias("rank")).unionByName(
        distinct.join(entities.select(F.col("name").alias("value")), F.col("text") == F.col("value")).select("text", "value", F.lit(1.0).alias("score"), F.lit(0).alias("rank"))
    )
    seen = distinct.join(references, F.lower("text") == F.col("form")).select("text", F.col("ent").alias("value"), F.col("freq").alias("score"), F.lit(1).alias("rank"))
    return sure.unionByName(seen).groupBy("text", "value").agg(F.max_by("score", "rank").alias("score"))


def type_scores(words: DataFrame, lexicon: DataFrame, type_words: DataFrame) -> DataFrame:
    """(id, type, score): lexicalisation counts over an id's lemmas, normalised to 1; at least 1/words where a lemma is the type label's last word.

    words (id, lemma); lexicon (lemma, type, n); type_words (type, lemma).
    """
    size = words.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    counts = words.join(lexicon, "lemma").groupBy("id", "type").agg(F.sum("n").alias("n"))
    shares = counts.select("id", "type", (F.col("n") / F.sum("n").over(Window.partitionBy("id"))).alias("score"))
    floor = words.join(type_words, "lemma").select("id", "type").distinct().join(size, "id").select("id", "type", (1 / F.col("size")).alias("score"))
    return shares.unionByName(floor).groupBy("id", "type").agg(F.max("score").alias("score"))


def pattern_medians(contributions: DataFrame, matches: DataFrame) -> DataFrame:
    """(set_id, target, median): per set the targets whose median over all matching children, those without contribution counting 0, is largest and above 0.

    contributions (set_id, child, target, value), at most one a child; matches (set_id, n) matching children.
    """
    lists = contributions.groupBy("set_id", "target").agg(F.collect_list("value").alias("values"), F.count(F.lit(1)).alias("seen")).join(matches, "set_id")
    padded = F.array_sort(F.concat("values", F.array_repeat(F.lit(0.0), F.greatest(F.col("n") - F.col("seen"), F.lit(0)).cast("int"))))
    middle = F.size("p") / F.lit(2)
    low, high = F.element_at("p", F.ceil(middle).cast("int")), F.element_at("p", (F.floor(middle) + 1).cast("int"))
    medians = lists.withColumn("p", padded).select("set_id", "target", ((low + high) / 2).alias("median"))
    top = medians.withColumn("top", F.max("median").over(Window.partitionBy("set_id")))
    return top.where("median = top AND median > 0").select("set_id", "target", "median")


def pattern_confidence(weights: DataFrame) -> DataFrame:
    """(pattern, target, confidence): a target's share of its pattern's copies; weights (pattern, target, copies)."""
    sums = weights.groupBy("pattern", "target").agg(F.sum("copies").alias("copies"))
    return sums.select("pattern", "target", (F.col("copies") / F.sum("copies").over(Window.partitionBy("pattern"))).alias("confidence"))


def pattern_matches(labels: DataFrame, patterns: DataFrame) -> DataFrame:
    """(cat, front, back, text): the longest front pattern, then back pattern, that a label's words fit, some words left between.

    labels (cat, label); patterns (front, back) as strings, '' for none. Prefixes of labels join patterns, so no label walks a trie.
    """
    words = labels.withColumn("words", F.split("label", " ")).withColumn("n", F.size("words")).where("n > 1")
    cuts = words.select("cat", "words", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("f")).select("cat", "words", "n", "f", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("f") - 1)).alias("b"))
    joined = cuts.where("f + b > 0").select(
        "cat", "f", "b", F.array_join(F.slice("words", 1, F.col("f")), " ").alias("front"), F.array_join(F.slice("words", F.col("n") - F.col("b") + 1, F.col("b")), " ").alias("back"),
        F.array_join(F.slice("words", F.col("f") + 1, F.col("n") - F.col("f") - F.col("b")), " ").alias("text"),
    ).join(patterns.select("front", "back").distinct(), ["front", "back"])
    family = F.when(F.col("b") == 0, "front").when(F.col("f") == 0, "back").otherwise("both")
    order = Window.partitionBy("cat", "family").orderBy(F.desc("f"), F.desc("b"))
    return joined.withColumn("family", family).withColumn("r", F.row_number().over(order)).where("r = 1").select("cat", "family", "front", "back", "text")


def property_axioms(matches: DataFrame, confidence: DataFrame, frequencies: DataFrame, values: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """(cat, pred, value, score): per category and pattern family the best of frequency * confidence * value score, from ``least`` on.

    confidence (front, back, target, confidence); frequencies (cat, pred, value, freq); values (text, value, score).
    """
    scored = (
        matches.join(confidence.withColumnRenamed("target", "pred"), ["front", "back"]).join(frequencies, ["cat", "pred"]).join(values, ["text", "value"])
        .select("cat", "family", "pred", "value", (F.col("freq") * F.col("confidence") * F.col("score")).alias("score")).where(F.col("score") >= least)
    )
    order = Window.partitionBy("cat", "family").orderBy(F.desc("score"), "pred", "value")
    best = scored.withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.groupBy("cat", "pred", "value").agg(F.max("score").alias("score"))


def type_axioms(matches: DataFrame, confidence: DataFrame, frequencies: DataFrame, lexical: DataFrame, paths: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """(cat, type, score): the best-scored type, replaced by a lower-scored one only if that is its subtype.

    frequencies (cat, type, freq); lexical (front, back, type, score).
    """
    scored = (
        matches.join(confidence.withColumnRenamed("target", "type"), ["front", "back"]).join(frequencies, ["cat", "type"]).join(lexical.withColumnRenamed("score", "lex"), ["front", "back", "type"])
        .select("cat", "family", "type", (F.col("freq") * F.col("confidence") * F.col("lex")).alias("score")).where(F.col("score") >= least)
    )
    order = Window.partitionBy("cat", "family").orderBy(F.desc("score"), "type")
    ranked = scored.withColumn("r", F.row_number().over(order))
    first = ranked.where("r = 1").select("cat", "family", F.col("type").alias("ancestor"))
    below = ranked.join(first, ["cat", "family"]).join(paths.select("ancestor", F.col("descendant").alias("type"), "depth"), ["ancestor", "type"])
    deepest = Window.partitionBy("cat", "family").orderBy(F.desc("depth"), F.desc("score"), "type")
    lower = below.withColumn("d", F.row_number().over(deepest)).where("d = 1").select("cat", "family", F.col("type").alias("low"), F.col("score").alias("low_score"))
    return ranked.where("r = 1").join(lower, ["cat", "family"], "left").select("cat", F.coalesce("low", "type").alias("type"), F.coalesce("low_score", "score").alias("score")).groupBy("cat", "type").agg(F.max("score").alias("score"))


def inherit(axioms: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(full, reduced) axioms (type, pred, value): those of a type and its ancestors, and of these the ones no direct parent has."""
    full = axioms.select("type", "pred", "value").unionByName(axioms.join(paths, F.col("type") == F.col("ancestor")).select(F.col("descendant").alias("type"), "pred", "value")).distinct()
    above = full.select(F.col("type").alias("parent"), "pred", "value").join(edges, "parent").select(F.col("child").alias("type"), "pred", "value")
    return full, full.join(above, ["type", "pred", "value"], "left_anti")


def facts(full: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """(ent, pred, value) that axioms give to the entities of their types and that aren't known."""
    return members.join(full, "type").select("ent", "pred", "value").distinct().join(known, ["ent", "pred", "value"], "left_anti")


def axiom_edges(edges: DataFrame, axioms: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges whose parent has a type axiom that the child's type implies: the same type or a subtype of it. axioms (cat, type)."""
    reach = paths.select("ancestor", "descendant").unionByName(axioms.select(F.col("type").alias("ancestor"), F.col("type").alias("descendant"))).distinct()
    return (
        edges.join(axioms.select(F.col("cat").alias("parent"), F.col("type").alias("ancestor")), "parent")
        .join(axioms.select(F.col("cat").alias("child"), F.col("type").alias("descendant")), "child")
        .join(reach, ["ancestor", "descendant"], "left_semi").select("parent", "child").distinct()
    )


def accepts(pairs: DataFrame, types: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(cat, type, ent, accepted, rejected) of pairs (cat, type, ent): whether the entity has the axiom's type, or one disjoint with it."""
    own = types.select("ent", "type").distinct().withColumn("accepted", F.lit(True))
    against = types.select("ent", F.col("type").alias("b")).join(disjoint, "b").select("ent", F.col("a").alias("type")).distinct().withColumn("rejected", F.lit(True))
    return pairs.join(own, ["ent", "type"], "left").join(against, ["ent", "type"], "left").na.fill(False, ["accepted", "rejected"])


def hypernym_votes(axioms: DataFrame, corpus: DataFrame, external: DataFrame, axiom_least: int = 10, corpus_least: int = 100, external_least: float = 0.4) -> DataFrame:
    """(hypo, hyper, votes) of pairs with more than one vote: two from axioms, one each from corpus and external list.

    axioms, corpus (hypo, hyper, n); external (hypo, hyper, conf).
    """
    votes = (
        axioms.where(F.col("n") >= axiom_least).select("hypo", "hyper", F.lit(2).alias("vote"))
        .unionByName(corpus.where(F.col("n") >= corpus_least).select("hypo", "hyper", F.lit(1).alias("vote")))
        .unionByName(external.where(F.col("conf") >= external_least).select("hypo", "hyper", F.lit(1).alias("vote")))
    )
    return votes.where("hypo <> hyper").groupBy("hypo", "hyper").agg(F.sum("vote").alias("votes")).where("votes > 1")
