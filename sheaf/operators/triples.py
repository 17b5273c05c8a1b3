"""Lookups, multimaps and statistics over triples; long rows in place of dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subjects(triples: DataFrame, pred: str, obj: str | None = None) -> DataFrame:
    """(sub) that have the predicate, and the object if given."""
    rows = triples.where(F.col("pred") == pred)
    return (rows.where(F.col("obj") == obj) if obj is not None else rows).select("sub").distinct()


def cast(rows: DataFrame, column: str, lookup: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by the idx that ``lookup`` (name, idx) gives; rows without one are dropped."""
    return rows.join(lookup.select(F.col("name").alias(column), F.col("idx").alias("__idx")), column).drop(column).withColumnRenamed("__idx", column)


def multi_valued(triples: DataFrame, pred: str, reverse: bool = False, reflexive: bool = False) -> DataFrame:
    """(key, value) distinct rows of a predicate."""
    a, b = ("obj", "sub") if reverse else ("sub", "obj")
    rows = triples.where(F.col("pred") == pred).select(F.col(a).alias("key"), F.col(b).alias("value"))
    if reflexive:
        rows = rows.unionByName(rows.select(F.col("value").alias("key"), F.col("key").alias("value")))
    return rows.distinct()


def counted(triples: DataFrame, pred: str, reverse: bool = False) -> DataFrame:
    """(key, value, n); literals are lower-cased and their spaces collapsed, empty ones dropped."""
    plain = F.when(F.col("is_literal"), F.trim(F.regexp_replace(F.lower("obj"), r"\s+", " "))).otherwise(F.col("obj"))
    rows = triples.where(F.col("pred") == pred).select(F.col("sub").alias("key"), plain.alias("value")).where("value <> ''")
    if reverse:
        rows = rows.select(F.col("value").alias("key"), F.col("key").alias("value"))
    return rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def single_valued(triples: DataFrame, pred: str, order: str, reflexive: bool = False) -> DataFrame:
    """(key, value): the value of the last row by ``order`` (the greatest of equals)."""
    rows = triples.where(F.col("pred") == pred).select(F.col("sub").alias("key"), F.col("obj").alias("value"), F.col(order).alias("at"))
    if reflexive:
        rows = rows.unionByName(rows.select(F.col("value").alias("key"), F.col("key").alias("value"), "at"))
    return rows.groupBy("key").agg(F.max(F.struct("at", "value")).alias("last")).select("key", "last.value")


def two_level(triples: DataFrame, reverse: bool = False) -> DataFrame:
    """(key, pred, value) distinct."""
    a, b = ("obj", "sub") if reverse else ("sub", "obj")
    return triples.select(F.col(a).alias("key"), "pred", F.col(b).alias("value")).distinct()


def universe(names: DataFrame, rules: list[tuple[str, str]], other: str, meta: DataFrame | None = None) -> DataFrame:
    """(idx, name, kind, is_meta): names numbered from 0 in order of name; kind by the first prefix that fits; meta names flagged.

    Numbers come from per-prefix counts and offsets, so no single task sorts all names.
    """
    kind: Column = F.lit(other)
    for prefix, value in reversed(rules):
        kind = F.when(F.col("name").startswith(prefix), F.lit(value)).otherwise(kind)
    rows = names.select("name").where("name IS NOT NULL").distinct().withColumn("__part", F.substring("name", 1, 3))
    offsets = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("__part").orderBy("name")) - 1).join(offsets, "__part")
    out = numbered.select((F.col("at") + F.coalesce("base", F.lit(0))).cast("bigint").alias("idx"), "name", kind.alias("kind"))
    if meta is None:
        return out.withColumn("is_meta", F.lit(False))
    return out.join(meta.select("name").distinct().withColumn("is_meta", F.lit(True)), "name", "left").select("idx", "name", "kind", F.coalesce("is_meta", F.lit(False)).alias("is_meta"))


def category_is_meta(name: Column, tokens: tuple[str, ...] = ("wikipedia", "wikipedians", "wikiproject", "template", "templates", "navigational", "stubs", "maintenance")) -> Column:
    """Whether a category's name has a maintenance word or ending."""
    words = F.split(F.lower(name), "[_: ]")
    return F.arrays_overlap(words, F.array(*map(F.lit, tokens))) | F.lower(name).rlike("_(articles|pages|files|categories|templates)$")


def references(counts: DataFrame, redirects: DataFrame, entities: DataFrame) -> DataFrame:
    """(form, ent, freq): how often a surface form means an entity. counts (form, ent, n); redirects (src, dst) are folded in first."""
    folded = counts.join(redirects.select(F.col("src").alias("ent"), "dst"), "ent", "left").select("form", F.coalesce("dst", "ent").alias("ent"), "n")
    known = folded.join(entities.select("ent"), "ent", "left_semi").groupBy("form", "ent").agg(F.sum("n").alias("n"))
    return known.select("form", "ent", (F.col("n") / F.sum("n").over(Window.partitionBy("form"))).alias("freq"))


def resolve_redirects(rows: DataFrame, column: str, redirects: DataFrame, spelling_only: bool = False, distance: int = 2) -> DataFrame:
    """``rows`` with ``column`` replaced by its redirect's target; with ``spelling_only`` only where the names differ by at most ``distance`` edits."""
    rows = rows.join(redirects.select(F.col("src").alias(column), F.col("dst").alias("__dst")), column, "left")
    to = F.col("__dst")
    if spelling_only:
        to = F.when(F.levenshtein(F.col(column), to, distance) >= 0, to)
    return rows.withColumn(column, F.coalesce(to, F.col(column))).drop("__dst")


def properties(triples: DataFrame, predicates: DataFrame, inverse: bool = False) -> DataFrame:
    """(ent, pred, value, is_literal) of known predicates, object and literal values side by side; inverse swaps ends and drops literals."""
    rows = triples.join(predicates.select("pred"), "pred", "left_semi")
    if inverse:
        return rows.where(~F.col("is_literal")).select(F.col("obj").alias("ent"), "pred", F.col("sub").alias("value"), "is_literal").distinct()
    return rows.select(F.col("sub").alias("ent"), "pred", F.col("obj").alias("value"), "is_literal").distinct()


def category_type_frequency(members: DataFrame, types: DataFrame) -> DataFrame:
    """(cat, type, freq): share of a category's members that have a type."""
    size = members.groupBy("cat").agg(F.count(F.lit(1)).alias("size"))
    return members.join(types, "ent").groupBy("cat", "type").agg(F.count(F.lit(1)).alias("n")).join(size, "cat").select("cat", "type", (F.col("n") / F.col("size")).alias("freq"))


def category_property_frequency(members: DataFrame, props: DataFrame) -> DataFrame:
    """(cat, pred, value, freq): share of a category's members that have a property value.

    Members and properties are made distinct first, so an entity comes once for each value and rows are counted as they are joined.
    """
    size = members.groupBy("cat").agg(F.count(F.lit(1)).alias("size"))
    once = members.select("cat", "ent").where("ent IS NOT NULL").distinct().join(props.select("ent", "pred", "value").distinct(), "ent")
    return once.groupBy("cat", "pred", "value").agg(F.count(F.lit(1)).alias("n")).join(size, "cat").select("cat", "pred", "value", (F.col("n") / F.col("size")).alias("freq"))


def popularity(triples: DataFrame) -> DataFrame:
    """(ent, popularity): object properties out of and into each entity."""
    rows = triples.where(~F.col("is_literal"))
    return rows.select(F.explode(F.array("sub", "obj")).alias("ent")).groupBy("ent").agg(F.count(F.lit(1)).alias("popularity"))


def functional(triples: DataFrame, predicates: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(pred, functional): whether fewer than ``threshold`` of a predicate's subjects have several values; unused ones are."""
    each = triples.groupBy("pred", "sub").agg(F.countDistinct("obj").alias("n"))
    share = each.groupBy("pred").agg(F.avg((F.col("n") > 1).cast("double")).alias("share"))
    return predicates.select("pred").join(share, "pred", "left").select("pred", F.coalesce(F.col("share") < threshold, F.lit(True)).alias("functional"))


def domains(triples: DataFrame, types: DataFrame, paths: DataFrame, threshold: float, inverse: bool = False) -> DataFrame:
    """(pred, type, share): the type that at least ``threshold`` of a predicate's values' subjects (objects, if inverse) have.

    Of the types with the largest share the one without a subtype among them stays, the least name of several. types are transitive.
    """
    end = "obj" if inverse else "sub"
    rows = triples.select("pred", F.col(end).alias("ent"))
    total = rows.groupBy("pred").agg(F.count(F.lit(1)).alias("total"))
    share = rows.join(types, "ent").groupBy("pred", "type").agg(F.count(F.lit(1)).alias("n")).join(total, "pred").select("pred", "type", (F.col("n") / F.col("total")).alias("share"))
    best = share.where(F.col("share") >= threshold).withColumn("top", F.max("share").over(Window.partitionBy("pred"))).where("share = top").select("pred", "type", "share")
    above = best.select("pred", F.col("type").alias("descendant")).join(paths, "descendant").where("ancestor <> descendant").select("pred", F.col("ancestor").alias("type"))
    specific = best.join(above, ["pred", "type"], "left_anti")
    return specific.groupBy("pred").agg(F.min(F.struct("type", "share")).alias("b")).select("pred", "b.type", "b.share")


def type_weights(triples: DataFrame, types: DataFrame) -> DataFrame:
    """(type, pred, weight): (1 + ln uses) * ln(types / (1 + types with the predicate))."""
    uses = triples.select(F.col("sub").alias("ent"), "pred").join(types, "ent").groupBy("type", "pred").agg(F.count(F.lit(1)).alias("n"))
    total = types.select("type").distinct().agg(F.count(F.lit(1)).alias("total"))
    spread = uses.groupBy("pred").agg(F.count(F.lit(1)).alias("having")).crossJoin(F.broadcast(total))  # one row
    return uses.join(spread, "pred").select("type", "pred", ((1 + F.ln("n")) * F.ln(F.col("total") / (1 + F.col("having")))).alias("weight"))


def type_cosine(weights: DataFrame, types: DataFrame, paths: DataFrame) -> DataFrame:
    """(a, b, sim) of all pairs a < b of types: cosine of weights; 1 if one is above the other or has no weight."""
    norms = weights.groupBy("type").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = (
        weights.select(F.col("type").alias("a"), "pred", F.col("weight").alias("wa")).join(weights.select(F.col("type").alias("b"), "pred", F.col("weight").alias("wb")), "pred")
        .where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    )
    every = types.select("type").distinct()
    pairs = every.select(F.col("type").alias("a")).join(every.select(F.col("type").alias("b")), F.col("a") < F.col("b"))
    related = paths.select(F.least("ancestor", "descendant").alias("a"), F.greatest("ancestor", "descendant").alias("b")).distinct().withColumn("rel", F.lit(True))
    for side in ("a", "b"):
        pairs = pairs.join(norms.select(F.col("type").alias(side), F.col("norm").alias(f"n{side}")), side, "left")
    pairs = pairs.join(dots, ["a", "b"], "left").join(related, ["a", "b"], "left")
    length = F.col("na") * F.col("nb")
    sim = F.when(F.col("rel") | F.coalesce(length, F.lit(0.0)).isin(0.0), 1.0).otherwise(F.coalesce("dot", F.lit(0.0)) / length)
    return pairs.select("a", "b", sim.alias("sim"))


def disjoint_types(sims: DataFrame, paths: DataFrame, threshold: float = 0.132, exempt: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: types alike by at most ``threshold``, but for pairs with a common descendant, spread to subtypes; ``exempt`` (a, b) pairs go at last.

    Equal types are no pair, so a common descendant of both ends after spreading goes too.
    """
    reach = paths.select("ancestor", "descendant").unionByName(sims.select(F.col("a").alias("ancestor"), F.col("a").alias("descendant")).distinct()).unionByName(
        sims.select(F.col("b").alias("ancestor"), F.col("b").alias("descendant")).distinct()
    ).distinct()
    low = sims.where(F.col("sim") <= threshold).select("a", "b")
    shared = reach.select(F.col("ancestor").alias("a"), "descendant").join(reach.select(F.col("ancestor").alias("b"), "descendant"), "descendant").select("a", "b").distinct()
    low = low.join(shared, ["a", "b"], "left_anti")
    spread = low.join(reach.select(F.col("ancestor").alias("a"), F.col("descendant").alias("x")), "a").join(reach.select(F.col("ancestor").alias("b"), F.col("descendant").alias("y")), "b")
    out = spread.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
    return out.join(exempt, ["a", "b"], "left_anti") if exempt is not None else out


def property_frequencies(members: DataFrame, props: DataFrame, paths: DataFrame, least: int = 5) -> DataFrame:
    """(type, pred, value, freq): share of a type's entities with a property; with fewer than ``least`` direct entities those of all its subtypes count.

    An entity that reaches the type by several subtypes counts for each, as the levels add up.
    """
    size = members.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    counts = members.join(props, "ent").groupBy("type", "pred", "value").agg(F.count(F.lit(1)).alias("c"))
    every = paths.select(F.col("ancestor").alias("type")).unionByName(paths.select(F.col("descendant").alias("type"))).unionByName(members.select("type")).distinct()
    small = every.join(size, "type", "left").where(F.coalesce("n", F.lit(0)) < least).select("type")
    below = small.join(paths, F.col("type") == F.col("ancestor")).select("type", F.col("descendant").alias("sub")).unionByName(small.select("type", F.col("type").alias("sub")))
    n2 = below.join(size.withColumnRenamed("type", "sub"), "sub").groupBy("type").agg(F.sum("n").alias("n"))
    c2 = below.join(counts.withColumnRenamed("type", "sub"), "sub").groupBy("type", "pred", "value").agg(F.sum("c").alias("c"))
    large = size.where(F.col("n") >= least)
    return c2.join(n2, "type").unionByName(counts.join(large, "type")).select("type", "pred", "value", (F.col("c") / F.col("n")).alias("freq"))


def tag_of_types(types: DataFrame, mapping: DataFrame, default: int = 13) -> DataFrame:
    """(ent, tag): the least tag of an entity's types by ``mapping`` (type, tag), else the default."""
    found = types.join(mapping, "type").groupBy("ent").agg(F.min("tag").alias("tag"))
    return types.select("ent").distinct().join(found, "ent", "left").select("ent", F.coalesce("tag", F.lit(default)).alias("tag"))
