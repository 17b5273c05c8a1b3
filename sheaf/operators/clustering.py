"""Clusters of mentions from candidate pairs.

mm (src, dst, score) between mentions; me (src, dst, score) from mentions to entities. A cluster has one entity at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.components import connected_components
from sheaf.session import discard, materialize

MM, ME, PATH = 0.8, 0.95, 0.75


def _m(c):
    return F.concat(F.lit("m"), c.cast("string"))


def _e(c):
    return F.concat(F.lit("e"), c.cast("string"))


def alignment_graph(mm: DataFrame, me: DataFrame, mm_least: float = MM, me_least: float = ME, entities: bool = True) -> DataFrame:
    """(a, b, w): edges above the thresholds, weights cut at 1; nodes are 'm' and mention or 'e' and entity id."""
    edges = mm.where(F.col("score") > mm_least).select(_m(F.col("src")).alias("a"), _m(F.col("dst")).alias("b"), F.least("score", F.lit(1.0)).alias("w"))
    if entities:
        edges = edges.unionByName(me.where(F.col("score") > me_least).select(_m(F.col("src")).alias("a"), _e(F.col("dst")).alias("b"), F.least("score", F.lit(1.0)).alias("w")))
    return edges.where("w > 0").groupBy("a", "b").agg(F.max("w").alias("w"))


def with_singles(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """Components with the nodes that no edge touches, each on its own."""
    rest = nodes.select("node").distinct().join(components, "node", "left_anti")
    return components.unionByName(rest.select("node", F.col("node").alias("component")))


def best_paths(graph: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, entity, path): for each node the entity with the largest product of weights along a path; lower entities first of equals.

    Rounds of relaxation from all entities at once until nothing improves; weights are at most 1, so it ends.
    """
    both = materialize(graph.select("a", "b", "w").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "paths")
    current = materialize(both.where(F.col("a").startswith("e")).select(F.col("a").alias("node"), F.col("a").alias("entity"), F.lit(1.0).alias("path")).distinct(), "paths")
    # products within 1e-12 are equal, so the order of the factors doesn't matter
    order = F.struct(F.round("path", 12).alias("p"), (-F.substring("entity", 2, 19).cast("bigint")).alias("id"), "entity", "path")
    for _ in range(max_rounds):
        moved = current.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "entity", (F.col("path") * F.col("w")).alias("path")).where(~F.col("node").startswith("e"))
        following = materialize(current.unionByName(moved).groupBy("node").agg(F.max(order).alias("x")).select("node", "x.entity", "x.path"), "paths")
        changed = following.select("node", "entity").join(current.select("node", "entity"), ["node", "entity"], "left_anti").count() + (
            following.join(current.select("node", F.col("path").alias("old")), "node").where("path > old + 1e-12").count()
        )
        discard(current)
        current = following
        if not changed:
            return current
    raise RuntimeError("paths did not settle")


def nasty(mm: DataFrame, me: DataFrame, mentions: DataFrame, mm_least: float = MM, me_least: float = ME, path_least: float = PATH) -> DataFrame:
    """(mention, cluster, entity): components with one entity at most stay whole; in others each mention goes to the entity of its best path above ``path_least``, and the rest form components of their own."""
    graph = materialize(alignment_graph(mm, me, mm_least, me_least), "graph")
    parts = materialize(with_singles(connected_components(graph, "a", "b"), mentions.select(_m(F.col("id")).alias("node"))), "parts")
    per = parts.groupBy("component").agg(F.count(F.when(F.col("node").startswith("e"), 1)).alias("n"), F.min(F.when(F.col("node").startswith("e"), F.col("node"))).alias("entity"))
    single = parts.join(per.where("n <= 1"), "component").select("node", F.col("component").alias("cluster"), "entity")
    tangled = parts.join(per.where("n > 1").select("component"), "component", "left_semi").select("node")
    inside = graph.join(tangled.select(F.col("node").alias("a")), "a", "left_semi")
    found = best_paths(inside).where((F.col("path") > path_least) & F.col("node").startswith("m")).select("node", F.col("entity").alias("cluster"), "entity")
    left = tangled.where("node LIKE 'm%'").join(found, "node", "left_anti")
    among = inside.join(left.select(F.col("node").alias("a")), "a", "left_semi").join(left.select(F.col("node").alias("b")), "b", "left_semi")
    rest = with_singles(connected_components(among, "a", "b"), left).select("node", F.col("component").alias("cluster"), F.lit(None).cast("string").alias("entity"))
    out = single.unionByName(found).unionByName(rest).where("node LIKE 'm%'")
    return out.select(F.substring("node", 2, 19).cast("bigint").alias("mention"), "cluster", F.substring("entity", 2, 19).cast("bigint").alias("entity"))


def majority(mm: DataFrame, me: DataFrame, mentions: DataFrame, mm_least: float = MM, me_least: float = ME, share: float = 0.5) -> DataFrame:
    """(mention, cluster, entity): components over mention pairs; a cluster takes the entity that is best for at least ``share`` of its mentions (the most, then lowest)."""
    graph = alignment_graph(mm, me, mm_least, me_least, entities=False)
    parts = with_singles(connected_components(graph, "a", "b"), mentions.select(_m(F.col("id")).alias("node")))
    members = parts.select(F.substring("node", 2, 19).cast("bigint").alias("mention"), F.col("component").alias("cluster"))
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    top = me.where(F.col("score") > me_least).withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("src").alias("mention"), F.col("dst").alias("entity"))
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    votes = members.join(top, "mention").groupBy("cluster", "entity").agg(F.count(F.lit(1)).alias("n")).join(size, "cluster").where(F.col("n") >= share * F.col("size"))
    first = Window.partitionBy("cluster").orderBy(F.desc("n"), "entity")
    chosen = votes.withColumn("r", F.row_number().over(first)).where("r = 1").select("cluster", "entity")
    return members.join(chosen, "cluster", "left").select("mention", "cluster", "entity")


def bottom_up(mm: DataFrame, me: DataFrame, mentions: DataFrame, mm_least: float = MM, me_least: float = ME) -> DataFrame:
    """(mention, cluster, entity): edges by falling score; a mention's best entity edge sets its cluster's entity if it has none, a mention edge joins clusters
    unless both have an entity; clusters of one entity are one in the end.

    The order matters only within a component of the whole graph, so each component is worked on by itself.
    """
    import pandas as pd

    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    top = me.where(F.col("score") > me_least).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    graph = materialize(alignment_graph(mm, top, mm_least, me_least), "graph")
    parts = materialize(with_singles(connected_components(graph, "a", "b"), mentions.select(_m(F.col("id")).alias("node"))), "parts")
    edges = graph.join(parts.withColumnRenamed("node", "a"), "a").select("component", "a", "b", "w")
    alone = parts.where("node LIKE 'm%'").select("component", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(-1.0).alias("w"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}
        entity: dict[str, str | None] = {}

        def find(x: str) -> str:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a in pdf.loc[pdf["b"].isna(), "a"]:
            find(a)
        rows = pdf[pdf["b"].notna()].sort_values(["w", "a", "b"], ascending=[False, True, True])
        for a, b in zip(rows["a"], rows["b"], strict=True):
            ra = find(a)
            if b.startswith("e"):
                if entity.get(ra) is None:
                    entity[ra] = b
                continue
            rb = find(b)
            if ra == rb or (entity.get(ra) is not None and entity.get(rb) is not None):
                continue
            lo, hi = min(ra, rb), max(ra, rb)
            parent[hi] = lo
            entity[lo] = entity.get(lo) or entity.get(hi)
        out = []
        for x in sorted(k for k in parent if k.startswith("m")):
            e = entity.get(find(x))
            out.append((int(x[1:]), e or find(x), int(e[1:]) if e else None))
        return pd.DataFrame(out, columns=["mention", "cluster", "entity"]).astype({"mention": "int64", "entity": "Int64"})

    return edges.unionByName(alone).groupBy("component").applyInPandas(merge, "mention bigint, cluster string, entity bigint")


def cluster_ids(clusters: DataFrame, first_new: int) -> DataFrame:
    """(mention, idx): the cluster's entity, or a new number from ``first_new`` on in order of the cluster's least mention."""
    new = clusters.where("entity IS NULL").groupBy("cluster").agg(F.min("mention").alias("least"))
    from sheaf.operators.triples import universe

    numbered = universe(new.select(F.lpad(F.col("least").cast("string"), 19, "0").alias("name")), [], "new").select(F.col("name").cast("bigint").alias("least"), (F.col("idx") + first_new).alias("idx"))
    named = new.join(numbered, "least").select("cluster", F.col("idx").alias("new_idx"))
    return clusters.join(named, "cluster", "left").select("mention", F.coalesce("entity", "new_idx").alias("idx"))
