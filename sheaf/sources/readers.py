"""Readers of the engine's input formats; each gives a typed table and leaves scanning and pruning to Spark."""

from __future__ import annotations

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A line whose object is a resource, and one whose object is a literal, maybe typed or English.
_OBJECT = r"^<([^>]+)> <([^>]+)> <([^>]+)> \.\s*$"
_LITERAL = r'^<([^>]+)> <([^>]+)> "(.+)"(?:\^\^.*|@en.*)? \.\s*$'


@F.pandas_udf(T.StringType())
def decode_iri(iri: pd.Series) -> pd.Series:
    """Percent-decoding that leaves '+' alone, which url_decode doesn't."""
    return iri.map(lambda s: unquote(s) if s is not None and "%" in s else s)


def _decoded(c: Column) -> Column:
    return F.when(c.contains("%"), decode_iri(c)).otherwise(c)


def parse_triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(sub, pred, obj, is_literal) of N-Triples lines: resources before literals, subjects and objects percent-decoded, lines that fit neither dropped.

    Literals in other languages than English don't fit; datatypes are cut off; predicates stay as they are.
    """
    c = F.col(column)
    kind = F.when(c.rlike(_OBJECT), F.lit(False)).when(c.rlike(_LITERAL), F.lit(True))
    rows = lines.select(c.alias("line"), kind.alias("is_literal")).where("is_literal IS NOT NULL")
    pick = lambda i: F.when(F.col("is_literal"), F.regexp_extract("line", _LITERAL, i)).otherwise(F.regexp_extract("line", _OBJECT, i))
    return rows.select(
        _decoded(pick(1)).alias("sub"), pick(2).alias("pred"), F.when(F.col("is_literal"), pick(3)).otherwise(_decoded(pick(3))).alias("obj"), "is_literal"
    )


def read_triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Triples of plain, gzip or bzip2 files."""
    return parse_triples(spark.read.text(path))


def read_pages(spark: SparkSession, path: str, namespaces: tuple[int, ...] = (0, 10, 14)) -> DataFrame:
    """(title, ns, text) of a wiki XML dump; the last text of a title stays."""
    raw = spark.read.format("xml").option("rowTag", "page").schema("title string, ns int, revision struct<text:string>").load(path)
    rows = raw.select("title", "ns", F.col("revision.text").alias("text"), F.monotonically_increasing_id().alias("at")).where(F.col("ns").isin(*namespaces))
    return rows.groupBy("title").agg(F.max_by(F.struct("ns", "text"), "at").alias("last")).select("title", "last.ns", "last.text")


def split_pages(pages: DataFrame) -> dict[str, DataFrame]:
    """Articles, templates and categories of one dump."""
    return {"articles": pages.where("ns = 0"), "templates": pages.where("ns = 10"), "categories": pages.where("ns = 14")}


def nif_texts(triples: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(name, text) of NIF contexts: the subject before its last '?', the text without line breaks and bracketed parts; known entities only, if given."""
    from sheaf.functions.text import remove_brackets

    rows = triples.where(F.col("pred").endswith("nif-core#isString")).select(
        F.regexp_replace("sub", r"\?[^?]*$", "").alias("name"), remove_brackets(F.regexp_replace("obj", r"\\n|[\r\n]+", " ")).alias("text")
    )
    return rows.join(entities, "name", "left_semi") if entities is not None else rows


def read_hypernyms(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, confidence) of an external hypernym list, tab-separated with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema="parent string, child string, confidence double")


def read_mention_examples(spark: SparkSession, path: str, pages: DataFrame, entities: DataFrame, first_new: int = 50_000_000) -> DataFrame:
    """Entity-linking examples of JSON lines: resolved by page id, else by external id; unresolved known ones dropped; new entities numbered from ``first_new``.

    pages (page_id, idx); entities (wikidata_id, idx).
    """
    schema = "id string, mention string, context string, offset int, length int, wikipedia_page_id long, wikidata_id string, nil boolean"
    rows = spark.read.schema(schema).json(path)
    found = rows.join(pages.select(F.col("page_id").alias("wikipedia_page_id"), F.col("idx").alias("page_idx")), "wikipedia_page_id", "left").join(
        entities.select("wikidata_id", F.col("idx").alias("known_idx")), "wikidata_id", "left"
    )
    found = found.where(F.col("page_idx").isNotNull() & (F.col("nil") | F.col("known_idx").isNotNull()))
    names = found.where("nil").select("wikidata_id").distinct()
    from pyspark.sql import Window

    numbered = names.withColumn("new_idx", F.row_number().over(Window.orderBy("wikidata_id")) - 1 + first_new)  # one row a new entity
    return found.join(numbered, "wikidata_id", "left").select("id", "mention", "context", "offset", "length", "page_idx", F.when(F.col("nil"), F.col("new_idx")).otherwise(F.col("known_idx")).alias("entity_idx"), "nil")


def read_mention_gold(spark: SparkSession, path: str) -> DataFrame:
    """(tag, page_idx, listing_idx) of a mention-detection gold table; rows without tag are unannotated."""
    raw = spark.read.csv(path, sep="\t", header=True)
    c = raw.columns
    return raw.select(F.col(f"`{c[0]}`").alias("tag"), F.col(f"`{c[1]}`").cast("long").alias("page_idx"), F.col(f"`{c[5]}`").cast("int").alias("listing_idx")).where("tag IS NOT NULL AND tag <> ''")


def read_span_gold(spark: SparkSession, path: str) -> DataFrame:
    """(content, label, start, stop) of span annotations in JSON lines; their ends are inclusive, ours exclusive."""
    raw = spark.read.schema("content string, annotation array<struct<label:array<string>,points:array<struct<start:int,end:int>>>>").json(path)
    one = raw.select("content", F.explode("annotation").alias("a")).select("content", F.explode("a.label").alias("label"), F.col("a.points").alias("points"))
    return one.select("content", "label", F.explode("points").alias("p")).select("content", "label", F.col("p.start").alias("start"), (F.col("p.end") + 1).alias("stop"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, vector) of lines 'name v1 v2 ...'."""
    words = F.split("value", " ")
    return spark.read.text(path).select(words[0].alias("name"), F.transform(F.slice(words, 2, 100_000), lambda x: x.cast("float")).alias("vector"))


def read_or_create(spark: SparkSession, folder: str, name: str, version: int, make) -> DataFrame:
    """The stored table of that name and version; made and stored first where it isn't there."""
    path = f"{folder.rstrip('/')}/{name}/v={version}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_candidates(spark: SparkSession, folder: str, approach: str) -> DataFrame:
    """Stored candidates of the approaches whose id starts with ``approach``; the partition filter prunes the scan."""
    return spark.read.parquet(folder).where(F.col("approach").startswith(approach))
