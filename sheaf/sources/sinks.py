"""Writers: triples as N-Triples lines, type distributions as JSON, statistics and metric tables."""

from __future__ import annotations

import json
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
PROV = "http://www.w3.org/ns/prov#"
#: Characters that stay as they are in a name, besides those that quoting leaves alone.
OPEN = "\"!#$&'()*,:;=@"


@F.pandas_udf(T.StringType())
def encode_resource(iris: pd.Series) -> pd.Series:
    """IRI with its name percent-encoded: the name is what follows the last '/wiki/', else the last '/'."""

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        cut = s.rfind("/wiki/") + 6 if "/wiki/" in s else s.rfind("/") + 1
        return s[:cut] + quote(s[cut:], safe="/" + OPEN.replace('"', ""))

    return iris.map(one)


def encode_literal(c: Column) -> Column:
    """Backslashes and quotes escaped, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), r"\s+", " "))


def object_line(sub: Column, pred: Column, obj: Column) -> Column:
    return F.format_string("<%s> <%s> <%s> .", sub, pred, obj)


def literal_line(sub: Column, pred: Column, obj: Column, kind: str = "string") -> Column:
    """A literal triple's line; integers, floats and dates have their XSD type, strings and booleans none."""
    text = encode_literal(obj) if kind == "string" else F.date_format(obj, "yyyy-MM-dd") if kind == "date" else F.lower(obj.cast("string")) if kind == "boolean" else obj.cast("string")
    end = {"integer": f"^^<{XSD}integer>", "float": f"^^<{XSD}float>", "date": f"^^<{XSD}date>"}.get(kind, "")
    return F.concat(F.lit("<"), sub, F.lit("> <"), pred, F.lit('> "'), text, F.lit(f'"{end} .'))


def write_lines(lines: DataFrame, path: str, compression: str = "bzip2") -> None:
    """One text folder of lines."""
    lines.toDF("value").write.mode("overwrite").option("compression", compression).text(path)


def metadata_lines(graph: str, entities: DataFrame, classes: DataFrame, predicates: DataFrame, name: str, day: str) -> DataFrame:
    """VoID description of a graph with its counts."""
    void = "http://rdfs.org/ns/void#"
    spark = entities.sparkSession
    counts = [("entities", entities.count()), ("classes", classes.count()), ("properties", predicates.count())]
    rows = [f"<{graph}> <{RDF}type> <{void}Dataset> .", f'<{graph}> <http://purl.org/dc/terms/title> "{name}" .', f'<{graph}> <http://purl.org/dc/terms/issued> "{day}"^^<{XSD}date> .', f'<{graph}> <{void}uriSpace> "{graph}" .']
    rows += [f'<{graph}> <{void}{k}> "{n}"^^<{XSD}integer> .' for k, n in counts]
    return spark.createDataFrame([(r,) for r in rows], "value string")


def ontology_lines(classes: DataFrame, edges: DataFrame, labels: DataFrame, predicates: DataFrame, disjoint: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Lines of classes, labels, subclass edges, predicates, disjointness (each pair once) and value restrictions (each defined once).

    classes (iri); edges (parent, child); labels (iri, label); predicates (iri, is_object); disjoint (a, b); restrictions (cls, pred, value, is_literal).
    """
    lit = F.lit
    p = lambda name: lit(name)
    node = F.concat(lit("http://kg.example/restriction/"), F.sha2(F.concat_ws(" ", "pred", "value"), 256))
    once = restrictions.dropDuplicates(["pred", "value"]).withColumn("node", node)
    parts = [
        classes.select(object_line(F.col("iri"), p(RDF + "type"), p(OWL + "Class"))),
        labels.select(literal_line(F.col("iri"), p(RDFS + "label"), F.col("label"))),
        edges.select(object_line(F.col("child"), p(RDFS + "subClassOf"), F.col("parent"))),
        predicates.select(object_line(F.col("iri"), p(RDF + "type"), F.when(F.col("is_object"), OWL + "ObjectProperty").otherwise(OWL + "DatatypeProperty"))),
        disjoint.where("a < b").select(object_line(F.col("a"), p(OWL + "disjointWith"), F.col("b"))),
        once.select(object_line(F.col("node"), p(RDF + "type"), p(OWL + "Restriction"))),
        once.select(object_line(F.col("node"), p(OWL + "onProperty"), F.col("pred"))),
        once.select(F.when(F.col("is_literal"), literal_line(F.col("node"), p(OWL + "hasValue"), F.col("value"))).otherwise(object_line(F.col("node"), p(OWL + "hasValue"), F.col("value")))),
        restrictions.withColumn("node", node).select(object_line(F.col("cls"), p(RDFS + "subClassOf"), F.col("node"))),
    ]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].toDF("value")
    for x in parts[1:]:
        out = out.unionByName(x.toDF("value"))
    return out


def mapping_lines(parts: DataFrame) -> DataFrame:
    """Output to seed ontology; parts (node, seed, is_predicate)."""
    return parts.select(object_line(F.col("node"), F.when(F.col("is_predicate"), OWL + "equivalentProperty").otherwise(RDFS + "subClassOf"), F.col("seed")).alias("value"))


def provenance_lines(rows: DataFrame) -> DataFrame:
    """(iri, source) once each."""
    return rows.select("iri", "source").distinct().select(object_line(F.col("iri"), F.lit(PROV + "wasDerivedFrom"), F.col("source")).alias("value"))


def type_lines(types: DataFrame) -> DataFrame:
    """Direct types, and each entity as a named individual."""
    named = types.select("ent").distinct().select(object_line(F.col("ent"), F.lit(RDF + "type"), F.lit(OWL + "NamedIndividual")))
    return _union([named, types.select(object_line(F.col("ent"), F.lit(RDF + "type"), F.col("type")))])


def transitive_type_lines(types: DataFrame, transitive: DataFrame) -> DataFrame:
    """Transitive types that aren't direct."""
    return type_rest(types, transitive).select(object_line(F.col("ent"), F.lit(RDF + "type"), F.col("type")).alias("value"))


def type_rest(types: DataFrame, transitive: DataFrame) -> DataFrame:
    return transitive.join(types, ["ent", "type"], "left_anti")


def label_lines(labels: DataFrame, forms: DataFrame) -> DataFrame:
    """label and prefLabel of each entity, and its other forms as altLabels."""
    alt = forms.join(labels, "ent").where("form <> label").select("ent", "form").distinct()
    return _union([
        labels.select(literal_line(F.col("ent"), F.lit(RDFS + "label"), F.col("label"))),
        labels.select(literal_line(F.col("ent"), F.lit(SKOS + "prefLabel"), F.col("label"))),
        alt.select(literal_line(F.col("ent"), F.lit(SKOS + "altLabel"), F.col("form"))),
    ])


def relation_lines(facts: DataFrame) -> DataFrame:
    """(ent, pred, value, is_literal)."""
    return facts.select(F.when(F.col("is_literal"), literal_line(F.col("ent"), F.col("pred"), F.col("value"))).otherwise(object_line(F.col("ent"), F.col("pred"), F.col("value"))).alias("value"))


def same_as_lines(links: DataFrame) -> DataFrame:
    """(ent, seed)."""
    return links.select(object_line(F.col("ent"), F.lit(OWL + "sameAs"), F.col("seed")).alias("value"))


def new_rows(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """What the seed graph doesn't have: new entities, types and relations."""
    return rows.join(known, keys, "left_anti")


def type_distribution(types: DataFrame, paths: DataFrame) -> DataFrame:
    """(type, n): entities per type and its ancestors, one type an entity (the one with the least hash, so the choice is stable)."""
    one = types.groupBy("ent").agg(F.min_by("type", F.xxhash64("ent", "type")).alias("type"))
    # each entity has one type here, so types are counted before they are carried up
    direct = one.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    up = paths.select("descendant", "ancestor").where("ancestor <> descendant").distinct()
    every = direct.join(up, F.col("type") == F.col("descendant")).select(F.col("ancestor").alias("type"), "n").unionByName(direct)
    return every.groupBy("type").agg(F.sum("n").alias("n"))


def sunburst(counts: dict[str, int], children: dict[str, list[str]], node: str, level: int = 0, shares: tuple[float, ...] = (0.005, 0.1, 0.15)) -> dict:
    """Tree of a type distribution: children under a share of their parent are put together as '-other-', and what the children leave as '...'."""
    total = counts.get(node, 0)
    least = shares[min(level, len(shares) - 1)]
    parts, other = [], 0
    for c in sorted(children.get(node, []), key=lambda x: (-counts.get(x, 0), x)):
        n = counts.get(c, 0)
        if total and n / total >= least:
            parts.append(sunburst(counts, children, c, level + 1, shares))
        else:
            other += n
    if other:
        parts.append({"name": "-other-", "value": other})
    rest = total - sum(p["value"] for p in parts)
    if parts and rest > 0:
        parts.append({"name": "...", "value": rest})
    return {"name": node, "value": total} | ({"children": parts} if parts else {})


def sunburst_json(counts: DataFrame, edges: DataFrame, root: str) -> str:
    """JSON of the distribution; the ontology's types, not its entities, come to the driver."""
    n = {r["type"]: r["n"] for r in counts.collect()}
    children: dict[str, list[str]] = {}
    for r in edges.select("parent", "child").distinct().collect():
        children.setdefault(r["parent"], []).append(r["child"])
    return json.dumps(sunburst(n, children, root), sort_keys=True)


def statistics(types: DataFrame, facts: DataFrame, edges: DataFrame, labels: DataFrame, depth: DataFrame) -> DataFrame:
    """(measure, value): counts, means and medians of an ontology and its entities."""
    def per(df: DataFrame, key: str, name: str) -> DataFrame:
        each = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return each.agg(F.count(F.lit(1)).alias(f"{name}_subjects"), F.sum("n").alias(f"{name}_rows"), F.avg("n").alias(f"{name}_mean"), F.percentile("n", F.lit(0.5)).alias(f"{name}_median"), F.max("n").alias(f"{name}_max"))

    tables = [
        per(types, "ent", "types"), per(types, "type", "members"), per(facts, "ent", "facts"), per(facts, "pred", "predicates"), per(edges, "parent", "children"), per(edges, "child", "parents"),
        labels.agg(F.count(F.lit(1)).alias("labels"), F.countDistinct("label").alias("distinct_labels")), depth.agg(F.avg("depth").alias("depth_mean"), F.max("depth").alias("depth_max")),
    ]
    out = None
    for t in tables:
        long = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in t.columns])).alias("x")).select("x.*")
        out = long if out is None else out.unionByName(long)
    return out


def store(df: DataFrame, folder: str, name: str, version: int) -> None:
    """Put a table under its name and version."""
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/v={version}")


def store_candidates(candidates: DataFrame, folder: str, approach: str) -> None:
    """Put candidates under their approach, one partition each."""
    candidates.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/approach={approach}")


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(path)


def evaluation_lines(clusters: DataFrame) -> DataFrame:
    """Tab-separated lines (mention, start, end, cluster, score, type) for cluster evaluation tools; every cluster is a NIL one."""
    return clusters.select(F.concat_ws("\t", F.concat(F.lit("d"), F.col("mention").cast("string")), F.lit("0"), F.lit("1"), F.concat(F.lit("NIL"), F.col("cluster").cast("string")), F.lit("1.0"), F.lit("")).alias("value"))
