"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node id in it.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each round rewires every
    node's larger, then its smaller neighbours to the least node it knows, so the number of rounds
    grows with the logarithm of the component size rather than its diameter. Rows with a null end are dropped;
    self loops give a one-node component; direction and repeats don't matter; an empty table gives none.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    # written with its loops, so that reading the result doesn't make the edges again
    pairs = materialize(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops = pairs.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    current = pairs.where("a <> b")
    signature = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(below, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        following = materialize(small, "components")
        seen = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if signature is not None:  # the edges stay, for the loops
            discard(current)
        current = following
        if tuple(seen) == signature:
            break
        signature = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return members.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
