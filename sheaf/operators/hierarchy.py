"""Directed hierarchies as edge tables (parent, child): closure, levels, cycles, reduction, parent search and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import discard, materialize, materialize_measured


def closure(edges: DataFrame, with_self: bool = False, max_rounds: int = 64) -> DataFrame:
    """(ancestor, descendant, depth): every path, depth its shortest length; cycles are allowed.

    Paths double each round: one round joins paths of up to 2**r steps with each other, so rounds grow with the
    logarithm of the height. Null ends are dropped; ``with_self`` adds every node at depth 0.
    """
    base = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).where("ancestor IS NOT NULL AND descendant IS NOT NULL").distinct().withColumn("depth", F.lit(1))
    measures = {"n": F.count(F.lit(1)), "steps": F.sum("depth")}
    current, size = materialize_measured(base, "closure", **measures)
    for _ in range(max_rounds):
        right = current.select(F.col("ancestor").alias("mid"), F.col("descendant").alias("to"), F.col("depth").alias("more"))
        longer = current.join(right, F.col("descendant") == F.col("mid")).select("ancestor", F.col("to").alias("descendant"), (F.col("depth") + F.col("more")).alias("depth"))
        before = size
        following, size = materialize_measured(current.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")), "closure", **measures)
        discard(current)
        current = following
        if before == size:
            break
    else:
        raise RuntimeError("the closure did not settle")
    if with_self:
        nodes = base.select(F.explode(F.array("ancestor", "descendant")).alias("ancestor")).distinct()
        current = current.where("ancestor <> descendant").unionByName(nodes.select("ancestor", F.col("ancestor").alias("descendant"), F.lit(0).alias("depth")))
    return current


def depths(edges: DataFrame, root: str) -> DataFrame:
    """(node, depth): shortest path from the root; nodes it doesn't reach have -1."""
    reach = closure(edges).where(F.col("ancestor") == root).select(F.col("descendant").alias("node"), "depth").where(F.col("node") != root)
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("node")).where("node IS NOT NULL").distinct()
    return nodes.join(reach, "node", "left").select("node", F.when(F.col("node") == root, 0).otherwise(F.coalesce("depth", F.lit(-1))).alias("depth"))


def levels(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, level): longest path from a node without parents; a top-down order. Edges must have no cycle."""
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    current, seen = materialize_measured(nodes.withColumn("level", F.lit(0)), "levels", total=F.sum("level"))
    for _ in range(max_rounds):
        raised = edges.join(current, F.col("parent") == F.col("node")).groupBy("child").agg((F.max("level") + 1).alias("new"))
        before = seen
        following, seen = materialize_measured(
            current.join(raised, F.col("node") == F.col("child"), "left").select("node", F.greatest("level", F.coalesce("new", F.lit(0))).alias("level")), "levels", total=F.sum("level")
        )
        discard(current)
        current = following
        if seen == before:
            return current
    raise ValueError("the hierarchy has a cycle")


def cycle_edges(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Edges that lie on a cycle: the child reaches the parent."""
    paths = closure(edges) if paths is None else paths
    back = paths.select(F.col("ancestor").alias("child"), F.col("descendant").alias("parent"))
    return edges.join(back, ["parent", "child"], "left_semi")


def break_cycles(edges: DataFrame, root: str) -> DataFrame:
    """Edges without cycles: of those on one, the ones whose parent lies deeper than the child go, then those at equal depth."""
    depth = materialize(depths(edges, root), "depth")
    for deeper in (lambda p, c: p > c, lambda p, c: p >= c):
        on = cycle_edges(edges)
        marked = (
            on.join(depth.select(F.col("node").alias("parent"), F.col("depth").alias("up")), "parent")
            .join(depth.select(F.col("node").alias("child"), F.col("depth").alias("down")), "child")
            .where(deeper(F.col("up"), F.col("down")))
        )
        edges = materialize(edges.join(marked.select("parent", "child"), ["parent", "child"], "left_anti"), "acyclic")
    return edges


def transitive_reduction(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Edges that no longer path replaces. Edges must have no cycle."""
    paths = closure(edges) if paths is None else paths
    distinct = edges.select("parent", "child").distinct()
    through = distinct.select(F.col("parent"), F.col("child").alias("mid")).join(paths.select(F.col("ancestor").alias("mid"), F.col("descendant").alias("child")), "mid").select("parent", "child").distinct()
    return distinct.join(through, ["parent", "child"], "left_anti")


def independent(types: DataFrame, paths: DataFrame) -> DataFrame:
    """(ent, type) without the types that are ancestors of another type of the entity."""
    above = types.join(paths, F.col("type") == F.col("descendant")).where("ancestor <> descendant").select("ent", F.col("ancestor").alias("type"))
    return types.distinct().join(above, ["ent", "type"], "left_anti")


def transitive_types(types: DataFrame, paths: DataFrame, root: str | None = None) -> DataFrame:
    """(ent, type): types and all their ancestors, the root left out if named."""
    out = types.select("ent", "type").unionByName(types.join(paths, F.col("type") == F.col("descendant")).select("ent", F.col("ancestor").alias("type"))).distinct()
    return out.where(F.col("type") != root) if root else out


def disjoint_closure(disjoint: DataFrame, paths: DataFrame) -> DataFrame:
    """(a, b) of disjoint types in both directions, spread to all subtypes of either."""
    both = disjoint.select("a", "b").unionByName(disjoint.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    for side in ("a", "b"):
        below = paths.select(F.col("ancestor").alias(side), F.col("descendant").alias("below"))
        other = "b" if side == "a" else "a"
        both = both.unionByName(both.join(below, side).select(F.col("below").alias(side), other)).distinct()
    return both


def head_parents(lost: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, parent): parents for nodes by their head words.

    Both tables: (node, heads ARRAY, rest ARRAY of head remainders, other STRING outside the head). Candidates share a head; those with the same
    text outside the head win over those without any; a candidate's remainder must lie within the node's, the largest overlap
    wins; with no overlap at all only candidates without remainder do. Ties all count; a node is never its own parent.
    """
    left = lost.select(F.col("node"), F.explode("heads").alias("head"), F.col("rest").alias("rest"), F.col("other").alias("other"))
    right = nodes.select(F.col("node").alias("parent"), F.explode("heads").alias("head"), F.col("rest").alias("p_rest"), F.col("other").alias("p_other"))
    pairs = left.join(right, "head").where("node <> parent").drop("head").dropDuplicates(["node", "parent"])
    pairs = pairs.withColumn("tier", F.when(F.col("other") == F.col("p_other"), 0).when(F.col("p_other") == "", 1)).where("tier IS NOT NULL")
    pairs = pairs.where("size(array_except(p_rest, rest)) = 0").withColumn("overlap", F.size(F.array_intersect("rest", "p_rest")))
    pairs = pairs.where("overlap > 0 OR size(p_rest) = 0")
    order = Window.partitionBy("node").orderBy("tier", F.desc("overlap"))
    return pairs.withColumn("place", F.rank().over(order)).where("place = 1").select("node", "parent")


def append_unconnected(edges: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """``edges`` and an edge for each node without parent: to its head-word parents that the root reaches, else to the root."""
    lost = nodes.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti").where(F.col("node") != root)
    reach = closure(edges).where(F.col("ancestor") == root).select(F.col("descendant").alias("node"))
    known = nodes.join(reach, "node", "left_semi")
    found = head_parents(lost, known)
    rest = lost.select("node").join(found.select("node").distinct(), "node", "left_anti").select(F.lit(root).alias("parent"), F.col("node").alias("child"))
    return edges.select("parent", "child").unionByName(found.select("parent", F.col("node").alias("child"))).unionByName(rest).distinct()


def unrelated_edges(edges: DataFrame, heads: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """Edges none of whose child's head words equals, or has as hypernym, one of the parent's; heads (node, head), hypernyms (hypo, hyper)."""
    up = edges.join(heads.select(F.col("node").alias("parent"), F.col("head").alias("p")), "parent").join(heads.select(F.col("node").alias("child"), F.col("head").alias("c")), "child")
    related = up.join(hypernyms.select(F.col("hypo").alias("c"), F.col("hyper").alias("h")), "c", "left").where("p = c OR h = p").select("parent", "child").distinct()
    return edges.join(related, ["parent", "child"], "left_anti")


def merge_nodes(edges: DataFrame, labels: DataFrame, max_rounds: int = 32) -> DataFrame:
    """(node, target): where nodes are merged to. labels: (node, label, canonical).

    A node whose label isn't its canonical form goes to a parent with the same canonical words; failing that, two or more such
    siblings that share a canonical form go to their parent. Chains are followed to their end; a cycle of merges ends at its least node.
    """
    words = F.array_sort(F.array_distinct(F.split(F.lower("canonical"), " ")))
    known = labels.withColumn("words", words)
    movable = known.where("label <> canonical")
    up = edges.join(movable.select(F.col("node").alias("child"), "words", "canonical"), "child").join(known.select(F.col("node").alias("parent"), F.col("words").alias("p_words")), "parent")
    same = up.where("words = p_words").groupBy("child").agg(F.min("parent").alias("target"))
    others = up.join(same, "child", "left_anti")
    siblings = others.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("parent", "canonical"))).where("n > 1").groupBy("child").agg(F.min("parent").alias("target"))
    current = materialize(same.unionByName(siblings).select(F.col("child").alias("node"), "target"), "merge")
    for _ in range(max_rounds):
        ahead = current.select(F.col("node").alias("target"), F.col("target").alias("further"))
        following = materialize(current.join(ahead, "target", "left").select("node", F.when(F.col("further") == F.col("node"), F.least("node", "target")).otherwise(F.coalesce("further", "target")).alias("target")), "merge")
        changed = following.join(current, ["node", "target"], "left_anti").count()
        discard(current)
        current = following
        if not changed:
            break
    return current.where("node <> target")


def contract(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges after merging: each end replaced by its target, loops dropped."""
    for end in ("parent", "child"):
        edges = edges.join(merged.select(F.col("node").alias(end), F.col("target").alias("t")), end, "left").withColumn(end, F.coalesce("t", end)).drop("t")
    return edges.where("parent <> child").select("parent", "child").distinct()
