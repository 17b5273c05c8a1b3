"""Mention detection: weak labels, chunks for a tagger, decoding of its output, and what is kept of it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ITEMS, MOST_TOKENS, ITEM_TOKENS, LEAST_ITEMS = 15, 300, 30, 3
IGNORED = -100


def weak_labels(mentions: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(page, listing, item, ent, label) of list pages: mentions of a page's related entities are 1, others that can't be subjects 0.

    mentions (page, listing, item, start, ent); positives, negatives (page, ent). A listing with one or two positives is left out; an item counts if it has a positive or
    if all its entities are negatives.
    """
    flagged = mentions.join(positives.select("page", "ent").distinct().withColumn("pos", F.lit(1)), ["page", "ent"], "left").join(
        negatives.select("page", "ent").distinct().withColumn("neg", F.lit(1)), ["page", "ent"], "left"
    ).na.fill(0, ["pos", "neg"])
    listing = Window.partitionBy("page", "listing")
    item = Window.partitionBy("page", "listing", "item")
    kept = flagged.withColumn("n", F.sum("pos").over(listing)).where("n = 0 OR n > 2").withColumn("has", F.max("pos").over(item)).withColumn("all", F.min(F.greatest("pos", "neg")).over(item))
    return kept.where("has = 1 OR all = 1").select("page", "listing", "item", "ent", F.col("pos").alias("label"))


def first_mentions(labels: DataFrame, mentions: DataFrame) -> DataFrame:
    """(page, listing, item, start, stop, ent): the first mention of each item with a positive one."""
    order = Window.partitionBy("page", "listing", "item").orderBy("start", "stop")
    rows = mentions.join(labels.where("label = 1").select("page", "listing", "item", "ent").distinct(), ["page", "listing", "item", "ent"])
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("page", "listing", "item", "start", "stop", "ent")


def token_labels(items: DataFrame, spans: DataFrame) -> DataFrame:
    """items (page, listing, item, tokens) with labels ARRAY<INT>: the tag inside the item's span, 0 outside; spans (..., start, stop, tag)."""
    joined = items.join(spans.select("page", "listing", "item", "start", "stop", "tag"), ["page", "listing", "item"], "left")
    return joined.select("page", "listing", "item", "tokens", F.transform("tokens", lambda t, i: F.when((i >= F.col("start")) & (i < F.col("stop")), F.col("tag")).otherwise(F.lit(0))).alias("labels"))


def chunks(items: DataFrame, context: DataFrame) -> DataFrame:
    """(page, listing, chunk, item, tokens): items of a listing packed in order under 300 tokens with the context, 15 items and 30 tokens an item; chunks of fewer than 3 items go.

    items (page, listing, item, tokens); context (page, listing, context ARRAY<STRING>).
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        budget = MOST_TOKENS - len(pdf["context"].iloc[0] if pdf["context"].iloc[0] is not None else [])
        rows, held, used, number = [], [], 0, 0
        for item, tokens in zip(pdf["item"], pdf["tokens"], strict=True):
            tokens = list(tokens)[: ITEM_TOKENS - 1]
            cost = len(tokens) + 1  # a start token before each
            if held and (used + cost > budget or len(held) == MOST_ITEMS):
                rows += [(number, *x) for x in held] if len(held) >= LEAST_ITEMS else []
                number += len(held) >= LEAST_ITEMS
                held, used = [], 0
            held.append((item, tokens))
            used += cost
        rows += [(number, *x) for x in held] if len(held) >= LEAST_ITEMS else []
        return pd.DataFrame([(pdf["page"].iloc[0], pdf["listing"].iloc[0], *r) for r in rows], columns=["page", "listing", "chunk", "item", "tokens"])

    return items.join(context, ["page", "listing"], "left").groupBy("page", "listing").applyInPandas(pack, "page string, listing int, chunk int, item int, tokens array<string>")


def context_tokens(page: str = "page", top: str = "top_section", section: str = "section"):
    """Context of a listing: page, top section and section between separators, the last one closing."""
    return F.concat(F.split(page, " "), F.array(F.lit("[CXS]")), F.split(top, " "), F.array(F.lit("[CXS]")), F.split(section, " "), F.array(F.lit("[CXE]")))


def negative_items(items: DataFrame, share: float = 0.1, seed: int = 17) -> DataFrame:
    """Items in synthetic listings that have no subject: a hashed share of all items, regrouped by hash so that neighbours come from different listings."""
    h = F.xxhash64("page", "listing", "item", F.lit(seed))
    rows = items.where(F.pmod(h, F.lit(10_000)) < int(share * 10_000)).withColumn("group", F.pmod(F.xxhash64(h), F.greatest(F.lit(1), F.lit(1_000_003))))
    order = Window.partitionBy(F.pmod("group", F.lit(4096))).orderBy("group", "page", "listing", "item")
    numbered = rows.withColumn("n", F.row_number().over(order) - 1)
    return numbered.select(F.concat(F.lit("negative-"), F.pmod("group", F.lit(4096))).alias("page"), F.floor(F.col("n") / 10).cast("int").alias("listing"), (F.col("n") % 10).cast("int").alias("item"), "tokens")


def tag(items: DataFrame, tagger: Callable | None = None) -> DataFrame:
    """items with tags ARRAY<INT>; the default tags the first run of capitalised tokens with 1. A plug-in is a function of the tokens column."""
    if tagger is not None:
        return items.withColumn("tags", tagger(F.col("tokens")))
    caps = F.transform("tokens", lambda t: t.rlike(r"^\p{Lu}").cast("int"))
    first, stop = _first_run("caps")
    runs = items.withColumn("caps", caps).withColumn("first", first).withColumn("stop", stop)
    n, lead, run = F.size("tokens"), F.greatest("first", F.lit(0)), F.col("stop") - F.greatest("first", F.lit(0))
    tags = F.concat(F.array_repeat(F.lit(0), lead), F.array_repeat(F.lit(1), run), F.array_repeat(F.lit(0), n - lead - run))
    return runs.withColumn("tags", tags).drop("caps", "first", "stop")


def _first_run(flags: str) -> tuple:
    """(start, stop) of the first run of ones in a column of 0/1 arrays; start is -1 without one."""
    at = F.array_position(flags, 1).cast("int")
    rest = F.slice(flags, F.greatest(at, F.lit(1)), F.greatest(F.size(flags), F.lit(1)))
    zero = F.array_position(rest, 0).cast("int")
    return at - 1, F.when(at == 0, 0).when(zero > 0, at + zero - 2).otherwise(F.size(flags))


def decode(tagged: DataFrame) -> DataFrame:
    """(page, listing, item, start, stop, tag, label): the first run of each item's tags; the run's first tag counts; labels under 3 characters and numbers go."""
    from sheaf.functions.text import valid_label

    first, stop = _first_run("flags")
    spans = tagged.withColumn("flags", F.transform("tags", lambda t: (t > 0).cast("int"))).withColumn("start", first).withColumn("stop", stop).where("start >= 0")
    out = spans.select("page", "listing", "item", "start", "stop", F.get("tags", F.col("start")).alias("tag"), "tokens")
    out = out.withColumn("label", F.array_join(F.slice("tokens", F.greatest(F.col("start") + 1, F.lit(1)), F.greatest(F.col("stop") - F.col("start"), F.lit(0))), " ")).drop("tokens")
    return out.where(valid_label(F.col("label")))


def prune_frequent(found: DataFrame, known: DataFrame, most: int = 50) -> DataFrame:
    """Mentions without those of labels that occur more than ``most`` times and that no resource has; known (label)."""
    counted = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label")))
    rare = counted.where(F.col("n") <= most)
    often = counted.where(F.col("n") > most).join(known.select("label").distinct(), "label", "left_semi")
    return rare.unionByName(often.select(rare.columns)).drop("n")


def main_entity(subjects: DataFrame, share: float = 0.75) -> DataFrame:
    """(page, listing, ent) of listings most of whose items (``share`` at least) have the same known subject."""
    total = subjects.groupBy("page", "listing").agg(F.count(F.lit(1)).alias("total"))
    each = subjects.where("ent IS NOT NULL").groupBy("page", "listing", "ent").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("page", "listing").orderBy(F.desc("n"), "ent")
    return each.withColumn("r", F.row_number().over(order)).where("r = 1").join(total, ["page", "listing"]).where(F.col("n") >= share * F.col("total")).select("page", "listing", "ent")


def majority_tag(chunked: DataFrame) -> DataFrame:
    """(chunk, tag): the commonest tag above 0, the least of equals."""
    each = chunked.where("tag > 0").groupBy("chunk", "tag").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("chunk").agg(F.max(F.struct("n", (-F.col("tag")).alias("t"))).alias("x")).select("chunk", (-F.col("x.t")).alias("tag"))


def entity_info(found: DataFrame, least_forms: int = 2) -> tuple[DataFrame, DataFrame]:
    """((ent, label), (ent, form)): the commonest label of each entity (the least of equals), and labels that occur more than ``least_forms`` times."""
    counts = found.groupBy("ent", "label").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("ent").orderBy(F.desc("n"), "label")
    labels = counts.withColumn("r", F.row_number().over(order)).where("r = 1").select("ent", "label")
    return labels, counts.where(F.col("n") > least_forms).select("ent", F.col("label").alias("form"))
