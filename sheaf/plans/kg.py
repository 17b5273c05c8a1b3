"""Queries of triples, hierarchies and statistics over the knowledge-graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import hierarchy as H
from sheaf.operators import triples as T
from sheaf.plans import views as V
from sheaf.plans.registry import query
from sheaf.plans.views import oracle
from sheaf.sources.readers import parse_triples

BASE = "http://kg.example/"


def _lines(spark, sf_dir):
    iri = lambda c: F.concat(F.lit(f"<{BASE}"), F.col(c), F.lit(">"))
    value = F.when(F.col("is_literal"), F.concat(F.lit('"'), F.col("obj"), F.lit('"@en'))).otherwise(iri("obj"))
    return V.triples(spark, sf_dir).select(F.concat_ws(" ", iri("sub"), iri("pred"), value, F.lit(".")).alias("value"))


@query("triples_scan", oracle(f"SELECT '{BASE}' || sub AS sub, '{BASE}' || pred AS pred, CASE WHEN is_literal THEN obj ELSE '{BASE}' || obj END AS obj, is_literal FROM kg_triples", "kg_triples"))
def triples_scan(spark, sf_dir):
    return parse_triples(_lines(spark, sf_dir))


@query("triples_subjects", oracle("SELECT DISTINCT sub FROM kg_triples WHERE pred = 'inNation' AND obj = 'N3'", "kg_triples"))
def triples_subjects(spark, sf_dir):
    return T.subjects(V.triples(spark, sf_dir), "inNation", "N3")


@query("triples_cast", oracle(", ids AS (SELECT sub AS name, row_number() OVER (ORDER BY sub) - 1 AS idx FROM (SELECT DISTINCT sub FROM kg_triples WHERE pred = 'inRegion')) SELECT t.sub, i.idx AS obj FROM kg_triples t JOIN ids i ON t.obj = i.name WHERE t.pred = 'inNation'", "kg_triples"))
def triples_cast(spark, sf_dir):
    t = V.triples(spark, sf_dir)
    ids = T.universe(T.subjects(t, "inRegion").select(F.col("sub").alias("name")), [], "entity").select("name", "idx")
    return T.cast(t.where("pred = 'inNation'").select("sub", "obj"), "obj", ids)


@query("triples_multimap", oracle("SELECT DISTINCT obj AS key, sub AS value FROM kg_triples WHERE pred = 'suppliedBy'", "kg_triples"))
def triples_multimap(spark, sf_dir):
    return T.multi_valued(V.triples(spark, sf_dir), "suppliedBy", reverse=True)


@query("triples_reflexive", oracle("SELECT DISTINCT sub AS key, obj AS value FROM kg_triples WHERE pred = 'inRegion' UNION SELECT obj, sub FROM kg_triples WHERE pred = 'inRegion'", "kg_triples"))
def triples_reflexive(spark, sf_dir):
    return T.multi_valued(V.triples(spark, sf_dir), "inRegion", reflexive=True)


@query("triples_countmap", oracle("SELECT lower(obj) AS key, sub AS value, count(*) AS n FROM kg_triples WHERE pred = 'brand' GROUP BY ALL", "kg_triples"))
def triples_countmap(spark, sf_dir):
    return T.counted(V.triples(spark, sf_dir), "brand", reverse=True)


@query("triples_single_val", "SELECT o_custkey AS key, max_by('O' || CAST(o_orderkey AS VARCHAR), struct_pack(a := o_orderdate, b := 'O' || CAST(o_orderkey AS VARCHAR))) AS value FROM orders GROUP BY o_custkey")
def triples_single_val(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("sub"), F.lit("placed").alias("pred"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("obj"), F.col("o_orderdate").alias("at"))
    return T.single_valued(rows, "placed", "at")


@query("triples_two_level", oracle("SELECT DISTINCT sub AS key, pred, obj AS value FROM kg_triples", "kg_triples"))
def triples_two_level(spark, sf_dir):
    return T.two_level(V.triples(spark, sf_dir))


@query("resource_universe", oracle(""", names AS (SELECT sub AS name FROM kg_triples UNION SELECT obj FROM kg_triples WHERE NOT is_literal)
SELECT row_number() OVER (ORDER BY name) - 1 AS idx, name, CASE WHEN name LIKE 'C%' THEN 'customer' WHEN name LIKE 'P%' THEN 'part' WHEN name LIKE 'O%' THEN 'order' ELSE 'other' END AS kind, name LIKE 'R%' AS is_meta FROM names""", "kg_triples"))
def resource_universe(spark, sf_dir):
    t = V.triples(spark, sf_dir)
    names = t.select(F.col("sub").alias("name")).unionByName(t.where(~F.col("is_literal")).select(F.col("obj").alias("name")))
    return T.universe(names, [("C", "customer"), ("P", "part"), ("O", "order")], "other", names.where("name LIKE 'R%'"))


@query("class_universe", oracle("SELECT row_number() OVER (ORDER BY name) - 1 AS idx, name, CASE WHEN name LIKE '%/%' THEN 'leaf' ELSE 'type' END AS kind FROM (SELECT parent AS name FROM kg_subclass UNION SELECT child FROM kg_subclass UNION SELECT type FROM kg_types)", "kg_subclass", "kg_types"))
def class_universe(spark, sf_dir):
    s = V.subclass(spark, sf_dir)
    names = s.select(F.explode(F.array("parent", "child")).alias("name")).unionByName(V.types(spark, sf_dir).select(F.col("type").alias("name")))
    return T.universe(names, [], "type").select("idx", "name", F.when(F.col("name").contains("/"), "leaf").otherwise("type").alias("kind"))


@query("category_universe", oracle("SELECT DISTINCT cat, list_has_any(string_split(lower(cat), ' '), ['brand#1', 'widget', 'templates']) AS is_meta FROM kg_categories", "kg_categories"))
def category_universe(spark, sf_dir):
    return V.categories(spark, sf_dir).select("cat").distinct().withColumn("is_meta", T.category_is_meta(F.col("cat"), ("brand#1", "widget", "templates")))


@query("inverse_properties", oracle("SELECT DISTINCT obj AS ent, pred, sub AS value, is_literal FROM kg_triples WHERE NOT is_literal AND pred IN ('inNation', 'inRegion', 'suppliedBy')", "kg_triples"))
def inverse_properties(spark, sf_dir):
    known = spark.createDataFrame([(p,) for p in ("inNation", "inRegion", "suppliedBy", "brand")], "pred string")
    return T.properties(V.triples(spark, sf_dir), known, inverse=True)


@query("entity_props", oracle("SELECT DISTINCT sub AS ent, pred, obj AS value, is_literal FROM kg_triples WHERE pred IN ('inNation', 'inRegion', 'brand')", "kg_triples"))
def entity_props(spark, sf_dir):
    known = spark.createDataFrame([(p,) for p in ("inNation", "inRegion", "brand")], "pred string")
    return T.properties(V.triples(spark, sf_dir), known)


@query("surface_ref_freq", """WITH r AS (SELECT p_partkey AS src, min(p_partkey) OVER (PARTITION BY p_name) AS dst, p_size FROM part),
n AS (SELECT lower(split_part(p_name, ' ', 1)) AS form, CASE WHEN r.p_size < 8 THEN r.dst ELSE l_partkey END AS ent FROM lineitem JOIN part ON l_partkey = p_partkey JOIN r ON r.src = l_partkey),
g AS (SELECT form, ent, count(*) AS n FROM n GROUP BY ALL) SELECT form, ent, round(n / sum(n) OVER (PARTITION BY form), 6) AS freq FROM g""")
def surface_ref_freq(spark, sf_dir):
    """Small parts are redirects to the first part of their name."""
    from pyspark.sql import Window

    part = V.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    counts = (
        V.table(spark, sf_dir, "lineitem").select("l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.lower(F.split("p_name", " ")[0]).alias("form"), F.col("l_partkey").alias("ent")).groupBy("form", "ent").agg(F.count(F.lit(1)).alias("n"))
    )
    redirects = part.select(F.col("p_partkey").alias("src"), F.min("p_partkey").over(Window.partitionBy("p_name")).alias("dst"), "p_size").where("p_size < 8").select("src", "dst")
    return T.references(counts, redirects, part.select(F.col("p_partkey").alias("ent"))).withColumn("freq", F.round("freq", 6))


@query("redirect_fold", "SELECT p_partkey, CASE WHEN levenshtein(p_name, p_brand || '') <= 12 THEN p_brand ELSE p_name END AS name FROM part")
def redirect_fold(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit("|"), F.col("p_name")).alias("key"), "p_name", "p_brand")
    # the redirect's names are compared without the key that keeps them apart
    redirects = part.select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst"), "p_partkey")
    near = redirects.where(F.levenshtein(F.col("src"), F.col("dst"), 12) >= 0)
    return part.join(near.select("p_partkey", "dst"), "p_partkey", "left").select("p_partkey", F.coalesce("dst", "p_name").alias("name"))


@query("category_stats_types", oracle(", size AS (SELECT cat, count(*) AS n FROM kg_categories GROUP BY cat) SELECT c.cat, t.type, round(count(*) / s.n, 6) AS freq FROM kg_categories c JOIN kg_transitive t ON t.ent = c.ent JOIN size s ON s.cat = c.cat GROUP BY c.cat, t.type, s.n", "kg_categories", "kg_transitive"))
def category_stats_types(spark, sf_dir):
    types = H.transitive_types(V.types(spark, sf_dir), H.closure(V.subclass(spark, sf_dir)), "Thing")
    return T.category_type_frequency(V.categories(spark, sf_dir), types).withColumn("freq", F.round("freq", 6))


@query("category_stats_props", oracle(", size AS (SELECT cat, count(*) AS n FROM kg_categories GROUP BY cat) SELECT c.cat, t.pred, t.obj AS value, round(count(DISTINCT c.ent) / s.n, 6) AS freq FROM kg_categories c JOIN kg_triples t ON t.sub = c.ent JOIN size s ON s.cat = c.cat GROUP BY c.cat, t.pred, t.obj, s.n", "kg_categories", "kg_triples"))
def category_stats_props(spark, sf_dir):
    props = T.two_level(V.triples(spark, sf_dir)).withColumnRenamed("key", "ent")
    return T.category_property_frequency(V.categories(spark, sf_dir), props).withColumn("freq", F.round("freq", 6))


@query("property_frequencies", oracle(""", props AS (SELECT DISTINCT sub AS ent, pred, obj AS value FROM kg_triples WHERE pred IN ('inNation', 'inRegion', 'size', 'segment')),
size AS (SELECT type, count(*) AS n FROM kg_types GROUP BY type), counts AS (SELECT type, pred, value, count(*) AS c FROM kg_types JOIN props USING (ent) GROUP BY ALL),
every AS (SELECT parent AS type FROM kg_subclass UNION SELECT child FROM kg_subclass UNION SELECT type FROM kg_types),
small AS (SELECT e.type FROM every e LEFT JOIN size s ON s.type = e.type WHERE coalesce(s.n, 0) < 5),
below AS (SELECT s.type, c.descendant AS sub FROM small s JOIN kg_closure c ON c.ancestor = s.type UNION ALL SELECT type, type FROM small),
n2 AS (SELECT b.type, sum(s.n) AS n FROM below b JOIN size s ON s.type = b.sub GROUP BY b.type), c2 AS (SELECT b.type, pred, value, sum(c) AS c FROM below b JOIN counts k ON k.type = b.sub GROUP BY b.type, pred, value)
SELECT c2.type, pred, value, round(c / n, 6) AS freq FROM c2 JOIN n2 ON c2.type = n2.type UNION ALL
SELECT k.type, pred, value, round(c / n, 6) FROM counts k JOIN size s ON s.type = k.type WHERE s.n >= 5""", "kg_types", "kg_triples", "kg_subclass", "kg_closure"))
def property_frequencies(spark, sf_dir):
    props = T.two_level(V.triples(spark, sf_dir).where("pred IN ('inNation', 'inRegion', 'size', 'segment')")).withColumnRenamed("key", "ent")
    return T.property_frequencies(V.types(spark, sf_dir), props, H.closure(V.subclass(spark, sf_dir))).withColumn("freq", F.round("freq", 6))


@query("popularity", oracle("SELECT ent, count(*) AS popularity FROM (SELECT sub AS ent FROM kg_triples WHERE NOT is_literal UNION ALL SELECT obj FROM kg_triples WHERE NOT is_literal) x GROUP BY ent", "kg_triples"))
def popularity(spark, sf_dir):
    return T.popularity(V.triples(spark, sf_dir))


@query("functional_predicates", oracle(""", each AS (SELECT pred, sub, count(DISTINCT obj) AS n FROM kg_triples GROUP BY ALL),
s AS (SELECT pred, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS share FROM each GROUP BY pred),
p AS (SELECT DISTINCT pred FROM kg_triples UNION SELECT 'unused') SELECT p.pred, coalesce(s.share < 0.05, true) AS functional FROM p LEFT JOIN s ON s.pred = p.pred""", "kg_triples"))
def functional_predicates(spark, sf_dir):
    t = V.triples(spark, sf_dir)
    return T.functional(t, t.select("pred").distinct().unionByName(spark.createDataFrame([("unused",)], "pred string")))


def _domain_sql(end: str, threshold: float) -> str:
    return oracle(f""", total AS (SELECT pred, count(*) AS total FROM kg_triples GROUP BY pred),
share AS (SELECT k.pred, t.type, count(*) / any_value(total.total) AS share FROM kg_triples k JOIN kg_transitive t ON t.ent = k.{end} JOIN total ON total.pred = k.pred GROUP BY k.pred, t.type),
best AS (SELECT * FROM (SELECT *, max(share) OVER (PARTITION BY pred) AS top FROM share WHERE share >= {threshold}) x WHERE share = top),
spec AS (SELECT b.pred, b.type, b.share FROM best b WHERE NOT EXISTS (SELECT 1 FROM best o JOIN kg_closure c ON c.descendant = o.type WHERE o.pred = b.pred AND c.ancestor = b.type))
SELECT pred, type, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY type) AS r FROM spec) x WHERE r = 1""", "kg_triples", "kg_transitive")


def _domains(spark, sf_dir, threshold, inverse):
    paths = H.closure(V.subclass(spark, sf_dir))
    types = H.transitive_types(V.types(spark, sf_dir), paths, "Thing")
    return T.domains(V.triples(spark, sf_dir), types, paths, threshold, inverse).withColumn("share", F.round("share", 6))


@query("domain_inference", _domain_sql("sub", 0.96))
def domain_inference(spark, sf_dir):
    return _domains(spark, sf_dir, 0.96, False)


@query("range_inference", _domain_sql("obj", 0.77))
def range_inference(spark, sf_dir):
    return _domains(spark, sf_dir, 0.77, True)


_WEIGHTS = """, uses AS (SELECT t.type, k.pred, count(*) AS n FROM kg_triples k JOIN kg_transitive t ON t.ent = k.sub GROUP BY ALL),
total AS (SELECT count(DISTINCT type) AS total FROM kg_transitive), spread AS (SELECT pred, count(*) AS having_n FROM uses GROUP BY pred),
weights AS (SELECT u.type, u.pred, (1 + ln(n)) * ln(total / (1 + having_n)) AS weight FROM uses u JOIN spread s ON s.pred = u.pred CROSS JOIN total)
"""
_COSINE = _WEIGHTS + """, norms AS (SELECT type, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY type),
dots AS (SELECT x.type AS a, y.type AS b, sum(x.weight * y.weight) AS dot FROM weights x JOIN weights y ON x.pred = y.pred AND x.type < y.type GROUP BY ALL),
every AS (SELECT DISTINCT type FROM kg_transitive), rel AS (SELECT DISTINCT least(ancestor, descendant) AS a, greatest(ancestor, descendant) AS b FROM kg_closure),
sims AS (SELECT p.a, p.b, CASE WHEN rel.a IS NOT NULL OR coalesce(na.norm * nb.norm, 0) = 0 THEN 1.0 ELSE coalesce(d.dot, 0) / (na.norm * nb.norm) END AS sim
  FROM (SELECT x.type AS a, y.type AS b FROM every x JOIN every y ON x.type < y.type) p LEFT JOIN norms na ON na.type = p.a LEFT JOIN norms nb ON nb.type = p.b
  LEFT JOIN dots d ON d.a = p.a AND d.b = p.b LEFT JOIN rel ON rel.a = p.a AND rel.b = p.b)
"""


def _weights(spark, sf_dir):
    paths = H.closure(V.subclass(spark, sf_dir))
    types = H.transitive_types(V.types(spark, sf_dir), paths, "Thing")
    return T.type_weights(V.triples(spark, sf_dir), types), types, paths


@query("type_property_weights", oracle(_WEIGHTS + "SELECT type, pred, round(weight, 6) AS weight FROM weights", "kg_triples", "kg_transitive"))
def type_property_weights(spark, sf_dir):
    return _weights(spark, sf_dir)[0].withColumn("weight", F.round("weight", 6))


@query("type_cosine", oracle(_COSINE + "SELECT a, b, round(sim, 6) AS sim FROM sims", "kg_triples", "kg_transitive"))
def type_cosine(spark, sf_dir):
    return T.type_cosine(*_weights(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query("disjoint_types", oracle(_COSINE + """, reach AS (SELECT ancestor, descendant FROM kg_closure UNION SELECT type, type FROM every),
low AS (SELECT a, b FROM sims WHERE sim <= 0.132 AND NOT EXISTS (SELECT 1 FROM reach x JOIN reach y ON x.descendant = y.descendant WHERE x.ancestor = sims.a AND y.ancestor = sims.b))
SELECT DISTINCT least(x.descendant, y.descendant) AS a, greatest(x.descendant, y.descendant) AS b FROM low JOIN reach x ON x.ancestor = low.a JOIN reach y ON y.ancestor = low.b
WHERE x.descendant <> y.descendant AND NOT (least(x.descendant, y.descendant) = 'Nation' AND greatest(x.descendant, y.descendant) = 'Supplier')""", "kg_triples", "kg_transitive"))
def disjoint_types(spark, sf_dir):
    weights, types, paths = _weights(spark, sf_dir)
    return T.disjoint_types(T.type_cosine(weights, types, paths), paths, exempt=spark.createDataFrame([("Nation", "Supplier")], "a string, b string"))


@query("class_closure", oracle("SELECT ancestor, descendant, depth FROM kg_closure", "kg_closure"))
def class_closure(spark, sf_dir):
    return H.closure(V.subclass(spark, sf_dir))


@query("class_depth", oracle("SELECT descendant AS node, depth FROM kg_closure WHERE ancestor = 'Thing' UNION ALL SELECT 'Thing', 0", "kg_closure"))
def class_depth(spark, sf_dir):
    return H.depths(V.subclass(spark, sf_dir), "Thing")


@query("class_levels", oracle("""SELECT node, max(level) AS level FROM (WITH RECURSIVE w(node, level) AS (SELECT 'Thing', 0 UNION ALL SELECT s.child, w.level + 1 FROM w JOIN kg_subclass s ON s.parent = w.node) SELECT * FROM w) GROUP BY node""", "kg_subclass"))
def class_levels(spark, sf_dir):
    return H.levels(V.subclass(spark, sf_dir))


@query("transitive_types", oracle("SELECT ent, type FROM kg_transitive", "kg_transitive"))
def transitive_types(spark, sf_dir):
    return H.transitive_types(V.types(spark, sf_dir), H.closure(V.subclass(spark, sf_dir)), "Thing")


@query("independent_types", oracle("SELECT t.ent, t.type FROM kg_transitive t WHERE NOT EXISTS (SELECT 1 FROM kg_transitive o JOIN kg_closure c ON c.descendant = o.type WHERE o.ent = t.ent AND c.ancestor = t.type)", "kg_transitive"))
def independent_types(spark, sf_dir):
    paths = H.closure(V.subclass(spark, sf_dir))
    return H.independent(H.transitive_types(V.types(spark, sf_dir), paths, "Thing"), paths)


@query("type_labels", oracle("SELECT t.ent, coalesce(min(CASE t.type WHEN 'Agent' THEN 1 WHEN 'Place' THEN 4 WHEN 'Supplier' THEN 2 WHEN 'Product' THEN 7 END), 13) AS tag FROM kg_transitive t GROUP BY t.ent", "kg_transitive"))
def type_labels(spark, sf_dir):
    mapping = spark.createDataFrame([("Agent", 1), ("Place", 4), ("Supplier", 2), ("Product", 7)], "type string, tag int")
    return T.tag_of_types(H.transitive_types(V.types(spark, sf_dir), H.closure(V.subclass(spark, sf_dir)), "Thing"), mapping)


_SHORT = ", edges AS (SELECT parent, child FROM kg_subclass UNION SELECT ancestor, descendant FROM kg_closure WHERE depth = 2)"


def _with_shortcuts(spark, sf_dir):
    edges = V.subclass(spark, sf_dir)
    return edges.unionByName(H.closure(edges).where("depth = 2").select(F.col("ancestor").alias("parent"), F.col("descendant").alias("child")))


@query("transitive_reduction", oracle("SELECT DISTINCT parent, child FROM kg_subclass", "kg_subclass"))
def transitive_reduction(spark, sf_dir):
    return H.transitive_reduction(_with_shortcuts(spark, sf_dir))


_BACK = "SELECT parent, child FROM kg_subclass UNION SELECT 'MACHINERY', 'Agent' UNION SELECT 'Order', 'Event' UNION SELECT 'Nation', 'Region'"


def _with_cycles(spark, sf_dir):
    return V.subclass(spark, sf_dir).unionByName(spark.createDataFrame([("MACHINERY", "Agent"), ("Order", "Event"), ("Nation", "Region")], "parent string, child string"))


@query("edge_in_cycle", oracle(", edges AS (" + _BACK + """), reach AS (SELECT DISTINCT a, b FROM (WITH RECURSIVE w(a, b, n) AS (SELECT parent, child, 1 FROM edges UNION ALL SELECT w.a, e.child, n + 1 FROM w JOIN edges e ON e.parent = w.b WHERE n < 6) SELECT a, b FROM w))
SELECT parent, child FROM edges e WHERE EXISTS (SELECT 1 FROM reach r WHERE r.a = e.child AND r.b = e.parent)""", "kg_subclass"))
def edge_in_cycle(spark, sf_dir):
    return H.cycle_edges(_with_cycles(spark, sf_dir))


@query("cycles_broken", oracle("SELECT DISTINCT parent, child FROM kg_subclass UNION SELECT 'Nation', 'Region'", "kg_subclass"))
def cycles_broken(spark, sf_dir):
    return H.break_cycles(_with_cycles(spark, sf_dir), "Thing")


@query("disjoint_closure", oracle(""", d(a, b) AS (SELECT * FROM (VALUES ('Agent', 'Place'), ('Product', 'Event')) v UNION SELECT b, a FROM (VALUES ('Agent', 'Place'), ('Product', 'Event')) v(a, b)),
x AS (SELECT a, b FROM d UNION SELECT c.descendant, b FROM d JOIN kg_closure c ON c.ancestor = d.a) SELECT a, b FROM x UNION SELECT a, c.descendant FROM x JOIN kg_closure c ON c.ancestor = x.b""", "kg_closure"))
def disjoint_closure(spark, sf_dir):
    pairs = spark.createDataFrame([("Agent", "Place"), ("Product", "Event")], "a string, b string")
    return H.disjoint_closure(pairs, H.closure(V.subclass(spark, sf_dir)))
