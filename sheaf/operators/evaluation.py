"""Entity disambiguation end to end: matchers by name, clusterers by name, scores for all, known and unknown mentions, grid search."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators import clustering as C
from sheaf.operators import linkage as L
from sheaf.operators import metrics as M
from sheaf.session import materialize

#: Candidate makers of (left, right or None) tables (id, label) or (id, vector).
MATCHERS: dict[str, Callable[..., DataFrame]] = {
    "exact": lambda left, right: L.match_on_key(left, right, L.exact_key),
    "word": lambda left, right: L.match_on_key(left, right, L.word_key),
    "bm25": lambda left, right: L.bm25(left, left if right is None else right).where("src <> dst" if right is None else "true"),
    "vectors": lambda left, right: L.nearest(left, left if right is None else right, same=right is None),
}
#: Clusterers of (mm, me, mentions).
CLUSTERERS: dict[str, Callable[..., DataFrame]] = {"nasty": C.nasty, "majority": C.majority, "bottom_up": C.bottom_up}


def partitions(rows: DataFrame, alignment: DataFrame, mention: str) -> DataFrame:
    """``rows`` three times with part 'all', 'known' or 'unknown' by whether the mention's entity is known; alignment (mention, entity, is_known)."""
    flagged = rows.join(alignment.select(F.col("mention").alias(mention), "is_known"), mention)
    return flagged.withColumn("part", F.explode(F.array(F.lit("all"), F.when(F.col("is_known"), "known").otherwise("unknown")))).drop("is_known")


def mention_scores(candidates: DataFrame, alignment: DataFrame) -> DataFrame:
    """(part, predicted, actual, correct, precision, recall, f1) of mention-entity candidates (src, dst) per part."""
    made = partitions(candidates.select("src", "dst").distinct(), alignment, "src").groupBy("part").agg(F.count(F.lit(1)).alias("predicted"))
    real = partitions(alignment.select("mention", "entity").distinct(), alignment, "mention").groupBy("part").agg(F.count(F.lit(1)).alias("actual"))
    hits = candidates.select("src", "dst").distinct().join(alignment.select(F.col("mention").alias("src"), F.col("entity").alias("dst")), ["src", "dst"])
    right = partitions(hits, alignment, "src").groupBy("part").agg(F.count(F.lit(1)).alias("correct"))
    out = real.join(made, "part", "left").join(right, "part", "left").na.fill(0, ["predicted", "correct"])
    p, r = F.when(F.col("predicted") > 0, F.col("correct") / F.col("predicted")).otherwise(0.0), F.col("correct") / F.col("actual")
    return out.select("part", "predicted", "actual", "correct", p.alias("precision"), r.alias("recall"), M.f1(p, r).alias("f1"))


def counts(alignment: DataFrame) -> DataFrame:
    """(part, mentions, entities, pairs): how many mentions, entities and pairs of mentions of one entity a part has."""
    rows = partitions(alignment.select("mention", "entity"), alignment, "mention")
    per = rows.groupBy("part", "entity").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("part").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("entities"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))


def grid_search(mm: DataFrame, me: DataFrame, alignment: DataFrame, clusterer: str, grid: dict[str, list[float]]) -> DataFrame:
    """One row of parameters and clustering scores for each combination; candidates are made once and read again for each."""
    mm, me = materialize(mm, "mm"), materialize(me, "me")
    mentions = alignment.select(F.col("mention").alias("id")).distinct()
    gold = alignment.select(F.col("mention").alias("id"), F.col("entity").alias("gold"))
    out = None
    for values in product(*grid.values()):
        chosen = dict(zip(grid, values, strict=True))
        found = CLUSTERERS[clusterer](mm, me, mentions, **chosen).select(F.col("mention").alias("id"), F.col("cluster").alias("pred"))
        row = M.clustering_scores(gold.join(found, "id")).select(*[F.lit(float(v)).alias(k) for k, v in chosen.items()], "*")
        out = row if out is None else out.unionByName(row)
    return out


def disambiguate(mentions: DataFrame, entities: DataFrame, matcher: str = "bm25", clusterer: str = "nasty", first_new: int = 50_000_000, **thresholds: float) -> DataFrame:
    """(mention, idx): candidates among mentions and to entities, clusters, and an entity number for each, new ones from ``first_new`` on.

    Matchers of labels work on distinct labels, each standing for its mentions, so frequent labels make no pairs among themselves.
    """
    lexical = matcher != "vectors"
    own = mentions.select("label").distinct().withColumn("id", F.expr("xxhash64(label) & 9223372036854775807")) if lexical else mentions
    own = materialize(own, "mentions")
    mm = materialize(MATCHERS["word" if matcher == "bm25" else matcher](own, None), "mm")
    me = MATCHERS[matcher](own, entities)
    if matcher == "bm25":
        me = materialize(me, "me")
        me = me.withColumn("score", F.col("score") / F.lit(me.agg(F.max("score")).first()[0] or 1.0))
    me = materialize(me, "me")
    ids = C.cluster_ids(materialize(CLUSTERERS[clusterer](mm, me, own, **thresholds), "clusters"), first_new)
    if not lexical:
        return ids
    return mentions.select("id", "label").join(own.select("label", F.col("id").alias("mention")), "label").join(ids, "mention").select(F.col("id").alias("mention"), "idx")
