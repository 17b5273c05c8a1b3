"""Queries of keyed lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.operators import lookups as K
from sheaf.operators.hierarchy import closure
from sheaf.plans import views as V
from sheaf.plans.registry import query
from sheaf.plans.views import oracle
from sheaf.sources import sinks as S

KG = "http://kg.example/"


def _merged(spark, sf_dir):
    """Parts' names are merged into their last words."""
    part = V.table(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("node"), F.element_at(F.split("p_name", " "), -1).alias("target")).where("node <> target").distinct()


_PARTS = "parts AS (SELECT split_part(p_name, ' ', -1) AS node, split_part(p_name, ' ', -1) AS part FROM part UNION SELECT split_part(p_name, ' ', -1), p_name FROM part)"


@query("node_parts", f"WITH {_PARTS} SELECT node, part FROM parts")
def node_parts(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    return K.node_parts(merged.select(F.explode(F.array("node", "target")).alias("node")), merged)


@query("seed_types", f"WITH {_PARTS}, seeds AS (SELECT DISTINCT p_name AS seed FROM part UNION SELECT DISTINCT p_type FROM part) SELECT s.seed, p.node AS type FROM seeds s LEFT JOIN parts p ON p.part = s.seed")
def seed_types(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    return K.types_of_seed(node_parts(spark, sf_dir), part.select(F.col("p_name").alias("seed")).union(part.select("p_type")))


@query("seed_entities", """WITH r AS (SELECT n_name || 'x' AS src, n_name AS dst FROM nation UNION ALL SELECT n_name || 'wxyz', n_name FROM nation), s AS (SELECT src AS seed FROM r UNION SELECT n_name FROM nation)
SELECT s.seed, n.n_name AS ent FROM s LEFT JOIN r ON r.src = s.seed LEFT JOIN nation n ON n.n_name = CASE WHEN levenshtein(r.src, r.dst) <= 2 THEN r.dst ELSE s.seed END""")
def seed_entities(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation").select("n_name")
    redirects = n.select(F.concat("n_name", F.lit("x")).alias("src"), F.col("n_name").alias("dst")).union(n.select(F.concat("n_name", F.lit("wxyz")), F.col("n_name")))
    return K.entity_of_seed(redirects.select(F.col("src").alias("seed")).union(n), redirects, n.select(F.col("n_name").alias("ent")))


def _words(spark, sf_dir):
    """Synonyms: words of part names that stand with the same last word in names of one brand."""
    part = V.table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    return part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(-1)), F.lit("_of_"), F.col("p_brand")).alias("synonym")).distinct()


_SYN = "syn AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word, split_part(p_name, ' ', -1) || '_of_' || p_brand AS synonym FROM part), pairs AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', -1) AS b FROM part UNION SELECT n_name, n_name || 'ese' FROM nation UNION SELECT DISTINCT lower(n_name), upper(n_name) FROM nation)"
_IS_SYN = """(a = b OR ((a = upper(a[1]) || lower(a[2:]) OR b = upper(b[1]) || lower(b[2:])) AND (starts_with(lower(a), lower(b)) OR starts_with(lower(b), lower(a))))
 OR EXISTS (SELECT 1 FROM syn WHERE word = b AND contains(synonym, a)) OR EXISTS (SELECT 1 FROM syn WHERE word = a AND contains(synonym, b)))"""


def _pairs(spark, sf_dir):
    part, n = V.table(spark, sf_dir, "part"), V.table(spark, sf_dir, "nation")
    own = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(-1)).alias("b"))
    return own.unionByName(n.select(F.col("n_name").alias("a"), F.concat("n_name", F.lit("ese")).alias("b"))).unionByName(n.select(F.lower("n_name").alias("a"), F.upper("n_name").alias("b"))).distinct()


@query("synonyms", f"WITH {_SYN} SELECT a, b, {_IS_SYN} AS synonym FROM pairs")
def synonyms(spark, sf_dir):
    return K.synonymous(_pairs(spark, sf_dir), _words(spark, sf_dir))


@query("hypernyms", f"WITH {_SYN}, h AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', -1)) AS b FROM part WHERE p_size > 40) SELECT a AS hyper, b AS hypo, {_IS_SYN} OR EXISTS (SELECT 1 FROM h WHERE h.a = lower(pairs.a) AND h.b = lower(pairs.b)) AS hypernym FROM pairs")
def hypernyms(spark, sf_dir):
    listed = V.table(spark, sf_dir, "part").where("p_size > 40").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("hyper"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(-1))).alias("hypo"))
    return K.hypernymous(_pairs(spark, sf_dir).toDF("hyper", "hypo"), _words(spark, sf_dir), listed)


@query("variations", """WITH s AS (SELECT DISTINCT a.p_name AS text, b.p_name AS variation FROM (SELECT DISTINCT p_name, p_brand FROM part) a JOIN (SELECT DISTINCT p_name, p_brand FROM part) b ON a.p_brand = b.p_brand)
SELECT text, variation FROM s WHERE levenshtein(replace(text, ' ', '_'), replace(variation, ' ', '_')) <= 2""")
def variations(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select("p_brand", F.translate("p_name", " ", "_").alias("name")).distinct()
    table = part.select(F.col("name").alias("word"), "p_brand").join(part.select(F.col("name").alias("synonym"), "p_brand"), "p_brand").select("word", "synonym").distinct()
    return K.variations(V.table(spark, sf_dir, "part").select(F.col("p_name").alias("text")), table)


_EQUIVALENT = [("Customer", "Client"), ("Client", "Buyer"), ("Place", "Location")]
_EQ_SQL = """, main(type, main) AS (VALUES ('Customer', 'Buyer'), ('Client', 'Buyer'), ('Buyer', 'Buyer'), ('Place', 'Location'), ('Location', 'Location')),
types AS (SELECT parent AS type FROM kg_subclass UNION SELECT child FROM kg_subclass UNION SELECT type FROM main),
classes AS (SELECT t.type, coalesce(m.main, t.type) AS main FROM types t LEFT JOIN main m ON m.type = t.type)"""


@query("equivalent_types", oracle(_EQ_SQL + " SELECT type, main FROM classes", "kg_subclass"))
def equivalent_types(spark, sf_dir):
    equivalents = spark.createDataFrame(_EQUIVALENT, "a string, b string")
    edges = V.subclass(spark, sf_dir)
    types = edges.select(F.explode(F.array("parent", "child")).alias("type")).union(equivalents.select(F.explode(F.array("a", "b"))))
    return K.equivalence_classes(equivalents, types)


@query("equivalent_closure", oracle(_EQ_SQL + """, e AS (SELECT DISTINCT p.main AS parent, c.main AS child FROM kg_subclass s JOIN classes p ON p.type = s.parent JOIN classes c ON c.type = s.child),
paths AS (SELECT * FROM (WITH RECURSIVE w(ancestor, descendant) AS (SELECT parent, child FROM e UNION SELECT w.ancestor, e.child FROM w JOIN e ON e.parent = w.descendant) SELECT * FROM w))
SELECT DISTINCT a.type AS ancestor, d.type AS descendant FROM paths p JOIN classes a ON a.main = p.ancestor JOIN classes d ON d.main = p.descendant""", "kg_subclass"))
def equivalent_closure(spark, sf_dir):
    return K.equivalent_closure(V.subclass(spark, sf_dir), spark.createDataFrame(_EQUIVALENT, "a string, b string"))


@query("disjoint_corrected", oracle(""", d(a, b) AS (SELECT * FROM (VALUES ('Agent', 'Place'), ('Place', 'Agent'), ('Order', 'Customer'), ('Customer', 'Order')) v),
x AS (SELECT a, b FROM d UNION SELECT c.descendant, b FROM d JOIN kg_closure c ON c.ancestor = d.a) SELECT a, b FROM x UNION SELECT a, c.descendant FROM x JOIN kg_closure c ON c.ancestor = x.b""", "kg_closure"))
def disjoint_corrected(spark, sf_dir):
    pairs = lambda *rows: spark.createDataFrame(rows, "a string, b string")
    return K.corrected_disjoint(pairs(("Agent", "Place"), ("Product", "Event")), pairs(("Order", "Customer")), pairs(("Event", "Product")), closure(V.subclass(spark, sf_dir)))


@query("subword_labels", """WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL),
s AS (SELECT conv_id, turn, list_concat(list_concat([-100], flatten(list_transform(w, lambda x: list_concat([length(x)], list_transform(range(CAST(greatest(ceil(length(x) / 4.0), 1) AS BIGINT) - 1), lambda i: -100))))), [-100]) AS l FROM t)
SELECT conv_id, turn, array_to_string(list_transform(l, lambda x: CAST(x AS VARCHAR)), ' ') AS labels FROM s""")
def subword_labels(spark, sf_dir):
    """Words cut into pieces of four letters, between two marks that belong to no word; a word's label is its length."""
    rows = V.table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("w", F.split("text", " "))
    pieces = F.flatten(F.transform("w", lambda x, i: F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.length(x) / 4), F.lit(1)).cast("int")), lambda _: i)))
    words = F.concat(F.array(F.lit(None).cast("int")), pieces, F.array(F.lit(None).cast("int")))
    labels = F.transform("w", F.length)
    return rows.withColumn("labels", labels).withColumn("pieces", words).select("conv_id", "turn", F.array_join(K.subword_labels(F.col("labels"), F.col("pieces")), " ").alias("labels"))


@query("gold_subjects", oracle(""", w AS (SELECT DISTINCT s_suppkey AS page, p_type AS type FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1)
SELECT page, listing, item, ent, max(CASE WHEN hit THEN 1 ELSE 0 END) AS label FROM (SELECT l_suppkey AS page, l_linenumber AS listing, l_orderkey AS item, l_partkey AS ent, EXISTS (SELECT 1 FROM w JOIN part_types t ON t.type = w.type WHERE w.page = l_suppkey AND t.E = l_partkey) AS hit
FROM lineitem WHERE l_suppkey IN (SELECT page FROM w)) x GROUP BY ALL""", "part_types"))
def gold_subjects(spark, sf_dir):
    line, part = V.table(spark, sf_dir, "lineitem"), V.table(spark, sf_dir, "part")
    asked = line.where("l_linenumber = 1").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("page"), F.col("p_type").alias("type")).distinct()
    mentions = line.select(F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("listing"), F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("ent"))
    return K.gold_subjects(mentions, V.part_types(spark, sf_dir).withColumnRenamed("E", "ent"), asked)


@query("seed_new_instances", oracle("SELECT DISTINCT ent FROM kg_types EXCEPT SELECT sub FROM kg_triples WHERE pred = 'inNation'", "kg_types", "kg_triples"))
def seed_new_instances(spark, sf_dir):
    known = V.triples(spark, sf_dir).where("pred = 'inNation'").select(F.col("sub").alias("ent"))
    return S.new_rows(V.types(spark, sf_dir).select("ent").distinct(), known, ["ent"])


@query("seed_new_relations", oracle("SELECT DISTINCT sub, pred, obj FROM kg_triples WHERE NOT is_literal EXCEPT SELECT sub, pred, obj FROM kg_triples WHERE pred = 'placedBy'", "kg_triples"))
def seed_new_relations(spark, sf_dir):
    t = V.triples(spark, sf_dir)
    return S.new_rows(t.where("NOT is_literal").select("sub", "pred", "obj").distinct(), t.where("pred = 'placedBy'"), ["sub", "pred", "obj"])


@query("iri_kinds", f"""WITH i AS (SELECT '{KG}resource/' || CASE WHEN p_size < 10 THEN 'Category:' WHEN p_size < 20 THEN 'File:' WHEN p_size < 30 THEN 'List_of_' ELSE '' END || p_partkey AS iri, p_size FROM part UNION ALL SELECT '{KG}ontology/' || p_partkey, -1 FROM part UNION ALL SELECT 'urn:' || p_partkey, -2 FROM part)
SELECT iri, CASE WHEN p_size = -1 THEN 'class' WHEN p_size = -2 THEN NULL WHEN p_size < 10 THEN 'category' WHEN p_size < 20 THEN 'file' WHEN p_size < 30 THEN 'list' ELSE 'resource' END AS kind FROM i""")
def iri_kinds(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select("p_size", F.col("p_partkey").cast("string").alias("k"))
    own = F.when(F.col("p_size") < 10, "Category:").when(F.col("p_size") < 20, "File:").when(F.col("p_size") < 30, "List_of_").otherwise("")
    iris = part.select(F.concat(F.lit(KG + "resource/"), own, "k").alias("iri")).union(part.select(F.concat(F.lit(KG + "ontology/"), "k"))).union(part.select(F.concat(F.lit("urn:"), "k")))
    return iris.select("iri", X.iri_kind(F.col("iri"), KG).alias("kind"))
