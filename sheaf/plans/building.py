"""Queries of axioms, mentions, ontology building and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import wikitext as W
from sheaf.operators import axioms as A
from sheaf.operators import hierarchy as H
from sheaf.operators import mentions as N
from sheaf.operators import ontology as O
from sheaf.operators import triples as T
from sheaf.plans import views as V
from sheaf.plans.registry import query
from sheaf.plans.views import oracle
from sheaf.sources import sinks as S

KG = "http://kg.example/"


def _paths(spark, sf_dir):
    return H.closure(V.subclass(spark, sf_dir))


# ---- axioms


def _children(spark, sf_dir):
    label = F.concat("p_type", F.lit(" "), "p_name")
    return V.table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), -1).alias("parent"), label.alias("child"), label.alias("label")).distinct()


@query("category_sets")
def category_sets(spark, sf_dir):
    s = A.category_sets(_children(spark, sf_dir))
    return s.select("set_id", "parent", "child", F.array_join("front", " ").alias("front"), F.array_join("back", " ").alias("back"))


@query("variable_text")
def variable_text(spark, sf_dir):
    return A.variable_text(A.category_sets(_children(spark, sf_dir)), _children(spark, sf_dir).select("child", "label"))


@query("best_words", "SELECT p_type, word, n FROM (SELECT p_type, split_part(p_name, ' ', 1) AS word, count(DISTINCT p_name) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(DISTINCT p_name) DESC, split_part(p_name, ' ', 1)) AS r FROM part GROUP BY 1, 2) x WHERE r = 1")
def best_words(spark, sf_dir):
    from pyspark.sql import Window

    words = V.table(spark, sf_dir, "part").select("p_type", "p_name").distinct().groupBy("p_type", F.element_at(F.split("p_name", " "), 1).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("r", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("n"), "word"))).where("r = 1").select("p_type", "word", "n")


@query("value_scores", """WITH t AS (SELECT DISTINCT p_name AS text FROM part), refs AS (SELECT p_name AS form, p_brand AS ent, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_name) AS total FROM part GROUP BY p_name, p_brand)
SELECT text, text AS value, 1.0::DOUBLE AS score FROM t UNION ALL SELECT t.text, r.ent, round(r.n / r.total, 6) FROM t JOIN refs r ON lower(t.text) = r.form""")
def value_scores(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    n = part.groupBy(F.col("p_name").alias("form"), F.col("p_brand").alias("ent")).agg(F.count(F.lit(1)).alias("n"))
    refs = T.references(n, spark.createDataFrame([], "src string, dst string"), part.select(F.col("p_brand").alias("ent")).distinct())
    names = part.select(F.col("p_name").alias("text")).distinct()
    return A.value_scores(names, part.select(F.col("p_brand").alias("name")).distinct(), refs).withColumn("score", F.round("score", 6))


@query("type_scores", """WITH w AS (SELECT DISTINCT p_name AS id, unnest(string_split(p_name, ' ')) AS lemma FROM part), lex AS (SELECT lemma, p_type AS type, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS lemma, p_type FROM part) x GROUP BY ALL),
c AS (SELECT id, type, sum(n) AS n FROM w JOIN lex USING (lemma) GROUP BY ALL), s AS (SELECT id, type, n / sum(n) OVER (PARTITION BY id) AS score FROM c) SELECT id, type, round(CASE WHEN list_contains(string_split(id, ' '), lower(type)) THEN greatest(score, 0.5) ELSE score END, 6) AS score FROM s""")
def type_scores(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    words = part.select(F.col("p_name").alias("id"), F.explode(F.split("p_name", " ")).alias("lemma")).distinct()
    lexicon = part.select(F.explode(F.split("p_name", " ")).alias("lemma"), F.col("p_type").alias("type")).groupBy("lemma", "type").agg(F.count(F.lit(1)).alias("n"))
    types = part.select(F.col("p_type").alias("type"), F.lower("p_type").alias("lemma")).distinct()
    return A.type_scores(words, lexicon, types).withColumn("score", F.round("score", 6))


_CONTRIB = """contrib AS (SELECT p_brand AS set_id, p_name AS child, p_type AS target, max(p_size) / 100.0 AS value FROM part GROUP BY ALL), m AS (SELECT p_brand AS set_id, count(DISTINCT p_name) AS n FROM part GROUP BY 1),
grid AS (SELECT s.set_id, s.child, t.target FROM (SELECT DISTINCT set_id, child FROM contrib) s JOIN (SELECT DISTINCT set_id, target FROM contrib) t ON s.set_id = t.set_id),
med AS (SELECT g.set_id, g.target, median(coalesce(c.value, 0)) AS median FROM grid g LEFT JOIN contrib c ON c.set_id = g.set_id AND c.child = g.child AND c.target = g.target GROUP BY ALL)"""


def _contributions(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    rows = part.groupBy(F.col("p_brand").alias("set_id"), F.col("p_name").alias("child"), F.col("p_type").alias("target")).agg((F.max("p_size") / 100.0).alias("value"))
    return rows, part.groupBy(F.col("p_brand").alias("set_id")).agg(F.countDistinct("p_name").alias("n"))


@query("patterns_median", f"WITH {_CONTRIB} SELECT set_id, target, round(median, 6) AS median FROM (SELECT *, max(median) OVER (PARTITION BY set_id) AS top FROM med) x WHERE median = top AND median > 0")
def patterns_median(spark, sf_dir):
    return A.pattern_medians(*_contributions(spark, sf_dir)).withColumn("median", F.round("median", 6))


@query("pattern_confidence", "SELECT pattern, target, round(copies / sum(copies) OVER (PARTITION BY pattern), 6) AS confidence FROM (SELECT split_part(p_name, ' ', 1) AS pattern, p_type AS target, sum(p_size) AS copies FROM part GROUP BY ALL) x")
def pattern_confidence(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), 1).alias("pattern"), F.col("p_type").alias("target"), F.col("p_size").alias("copies"))
    return A.pattern_confidence(part).withColumn("confidence", F.round("confidence", 6))


def _labels(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    cats = part.select(F.concat("p_brand", F.lit(" "), "p_name").alias("label")).distinct().withColumn("cat", F.col("label"))
    patterns = part.select(F.col("p_brand").alias("front"), F.lit("").alias("back")).unionByName(part.select(F.lit("").alias("front"), F.element_at(F.split("p_name", " "), -1).alias("back"))).distinct()
    return cats, patterns


@query("pattern_matches", """SELECT DISTINCT p_brand || ' ' || p_name AS cat, 'front' AS family, p_brand AS front, '' AS back, p_name AS text FROM part
UNION ALL SELECT DISTINCT p_brand || ' ' || p_name, 'back', '', split_part(p_name, ' ', -1), p_brand || ' ' || split_part(p_name, ' ', 1) FROM part""")
def pattern_matches(spark, sf_dir):
    return A.pattern_matches(*_labels(spark, sf_dir))


@query("axiom_apply", """WITH m AS (SELECT DISTINCT p_brand || ' ' || p_name AS cat, p_brand AS front, p_name AS text FROM part), f AS (SELECT p_brand || ' ' || p_name AS cat, p_type AS value, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand || ' ' || p_name) AS total FROM part GROUP BY p_brand || ' ' || p_name, p_type),
v AS (SELECT p_name AS text, p_type AS value, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_name) AS total FROM part GROUP BY p_name, p_type),
s AS (SELECT m.cat, f.value, (f.n / f.total) * 0.5 * (v.n / v.total) AS score FROM m JOIN f ON f.cat = m.cat JOIN v ON v.text = m.text AND v.value = f.value)
SELECT cat, 'kind' AS pred, value, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY score DESC, value) AS r FROM s WHERE score >= 0.05) x WHERE r = 1""")
def axiom_apply(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    cats, patterns = _labels(spark, sf_dir)
    members = part.select(F.concat("p_brand", F.lit(" "), "p_name").alias("cat"), F.col("p_partkey").alias("ent"), F.col("p_type").alias("value"))
    freq = T.category_property_frequency(members.select("cat", "ent"), members.select("ent", F.lit("kind").alias("pred"), "value"))
    n = part.groupBy(F.col("p_name").alias("form"), F.col("p_type").alias("ent")).agg(F.count(F.lit(1)).alias("n"))
    refs = T.references(n, spark.createDataFrame([], "src string, dst string"), part.select(F.col("p_type").alias("ent")).distinct())
    values = refs.select(F.col("form").alias("text"), F.col("ent").alias("value"), F.col("freq").alias("score"))
    conf = patterns.where("back = ''").select("front", "back", F.lit("kind").alias("target"), F.lit(0.5).alias("confidence"))
    return A.property_axioms(A.pattern_matches(cats, patterns.where("back = ''")), conf, freq, values).withColumn("score", F.round("score", 6))


@query("type_axioms")
def type_axioms(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    cats, patterns = _labels(spark, sf_dir)
    members = part.select(F.concat("p_brand", F.lit(" "), "p_name").alias("cat"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ent"))
    paths = _paths(spark, sf_dir)
    freq = T.category_type_frequency(members, H.transitive_types(V.types(spark, sf_dir), paths, "Thing"))
    front = patterns.where("back = ''")
    types = freq.select("type").distinct()
    conf = front.crossJoin(F.broadcast(types)).select("front", "back", F.col("type").alias("target"), F.lit(0.5).alias("confidence"))  # patterns by types: a demo's grid
    lex = conf.select("front", "back", F.col("target").alias("type"), F.lit(0.5).alias("score"))
    return A.type_axioms(A.pattern_matches(cats, front), conf, freq, lex, paths).withColumn("score", F.round("score", 6))


_AXIOMS = ", ax(type, pred, value) AS (SELECT * FROM (VALUES ('Agent', 'kind', 'actor'), ('Customer', 'kind', 'actor'), ('Customer', 'role', 'buyer'), ('Place', 'kind', 'place'), ('Thing', 'exists', 'yes')) v), full_ax AS (SELECT type, pred, value FROM ax UNION SELECT c.descendant, pred, value FROM ax JOIN kg_closure c ON c.ancestor = ax.type)"


def _axioms(spark):
    return spark.createDataFrame([("Agent", "kind", "actor"), ("Customer", "kind", "actor"), ("Customer", "role", "buyer"), ("Place", "kind", "place"), ("Thing", "exists", "yes")], "type string, pred string, value string")


@query("axiom_inherit", oracle(_AXIOMS + " SELECT type, pred, value FROM full_ax EXCEPT SELECT s.child, f.pred, f.value FROM full_ax f JOIN kg_subclass s ON s.parent = f.type", "kg_subclass", "kg_closure"))
def axiom_inherit(spark, sf_dir):
    return A.inherit(_axioms(spark), V.subclass(spark, sf_dir), _paths(spark, sf_dir))[1]


@query("axiom_facts", oracle(_AXIOMS + " SELECT DISTINCT t.ent, pred, value FROM kg_types t JOIN full_ax f ON f.type = t.type WHERE NOT (pred = 'exists' AND ent LIKE 'S%')", "kg_subclass", "kg_closure", "kg_types"))
def axiom_facts(spark, sf_dir):
    full, _ = A.inherit(_axioms(spark), V.subclass(spark, sf_dir), _paths(spark, sf_dir))
    types = V.types(spark, sf_dir)
    known = types.where("ent LIKE 'S%'").select("ent", F.lit("exists").alias("pred"), F.lit("yes").alias("value"))
    return A.facts(full, types, known)


@query("axiom_edges", oracle(", a AS (SELECT parent AS cat, parent AS type FROM kg_subclass UNION SELECT child, child FROM kg_subclass WHERE child NOT LIKE '%/%') SELECT DISTINCT s.parent, s.child FROM kg_subclass s JOIN a x ON x.cat = s.parent JOIN a y ON y.cat = s.child", "kg_subclass"))
def axiom_edges(spark, sf_dir):
    edges = V.subclass(spark, sf_dir)
    axioms = edges.select(F.col("parent").alias("node")).unionByName(edges.where("child NOT LIKE '%/%'").select(F.col("child").alias("node"))).distinct().select(F.col("node").alias("cat"), F.col("node").alias("type"))
    return A.axiom_edges(edges, axioms, _paths(spark, sf_dir))


@query("axiom_accepts", oracle(", pairs AS (SELECT c.cat, p.p_type AS type, c.ent FROM kg_categories c JOIN part p ON c.ent = 'P' || CAST(p_partkey AS VARCHAR)) SELECT DISTINCT p.cat, p.type, p.ent, t.ent IS NOT NULL AS accepted, p.type = 'STANDARD' AND t.ent IS NULL AS rejected FROM pairs p LEFT JOIN (SELECT DISTINCT ent, type FROM kg_transitive) t ON t.ent = p.ent AND t.type = p.type", "kg_categories", "kg_transitive"))
def axiom_accepts(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ent"), F.col("p_type").alias("type"))
    pairs = V.categories(spark, sf_dir).join(part, "ent").select("cat", "type", "ent").distinct()
    types = H.transitive_types(V.types(spark, sf_dir), _paths(spark, sf_dir), "Thing")
    return A.accepts(pairs, types, spark.createDataFrame([("Agent", "Place"), ("Place", "Agent")], "a string, b string"))


_VOTES = """w AS (SELECT split_part(p_name, ' ', -1) AS hypo, p_type AS hyper, count(*) AS n FROM part GROUP BY ALL), x AS (SELECT split_part(p_name, ' ', 1) AS hypo, p_type AS hyper, count(*) AS n FROM part GROUP BY ALL),
e AS (SELECT split_part(p_name, ' ', -1) AS hypo, p_type AS hyper, avg(p_size) / 50 AS conf FROM part GROUP BY ALL)"""


@query("hypernym_vote", f"WITH {_VOTES} SELECT hypo, hyper, CAST(sum(v) AS BIGINT) AS votes FROM (SELECT hypo, hyper, 2 AS v FROM w WHERE n >= 10 UNION ALL SELECT hypo, hyper, 1 FROM x WHERE n >= 100 UNION ALL SELECT hypo, hyper, 1 FROM e WHERE conf >= 0.4) u GROUP BY ALL HAVING sum(v) > 1")
def hypernym_vote(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    last, first = F.element_at(F.split("p_name", " "), -1).alias("hypo"), F.element_at(F.split("p_name", " "), 1).alias("hypo")
    kind = F.col("p_type").alias("hyper")
    return A.hypernym_votes(
        part.groupBy(last, kind).agg(F.count(F.lit(1)).alias("n")), part.groupBy(first, kind).agg(F.count(F.lit(1)).alias("n")), part.groupBy(last, kind).agg((F.avg("p_size") / 50).alias("conf"))
    )


# ---- pages and mentions


def _markup(spark, sf_dir):
    lines = F.concat(F.lit("* [["), "l_part", F.lit("]] by line "), F.col("l_linenumber").cast("string"))
    line = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("title"), "l_orderkey", "l_linenumber", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("l_part"))
    rows = line.withColumn("line", lines).groupBy("title").agg(F.array_join(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "line"))).getField("line"), "\n").alias("body"))
    return rows.select("title", F.concat(F.lit("== Parts ==\n"), "body").alias("text"))


@query("page_items", "SELECT CAST(l_suppkey AS VARCHAR) AS page, 'P' || CAST(l_partkey AS VARCHAR) AS target, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 3) GROUP BY ALL")
def page_items(spark, sf_dir):
    items = W.parse_pages(_markup(spark, sf_dir))
    return items.select("page", F.element_at("mentions", 1).getField("target").alias("target")).groupBy("page", "target").agg(F.count(F.lit(1)).alias("n"))


@query("page_errors", "SELECT NULL::VARCHAR AS page, NULL::VARCHAR AS error WHERE false")
def page_errors(spark, sf_dir):
    return W.parsed_pages(_markup(spark, sf_dir)).where("error IS NOT NULL").select("page", "error")


@query("page_useful", "SELECT CAST(l_suppkey AS VARCHAR) AS page FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def page_useful(spark, sf_dir):
    return W.useful_pages(W.parse_pages(_markup(spark, sf_dir)))


@query("templates_expanded", "SELECT CAST(p_partkey AS VARCHAR) AS title, '[' || p_brand || ' of ' || lower(p_type) || '] by {' || p_name || '}' AS text FROM part")
def templates_expanded(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    pages = part.select(F.col("p_partkey").cast("string").alias("title"), F.concat(F.lit("{{Old "), F.col("p_type"), F.lit("|"), F.col("p_brand"), F.lit("}} by {"), F.col("p_name"), F.lit("}{{missing}}")).alias("text"))
    kinds = part.select("p_type").distinct()
    templates = kinds.select(F.col("p_type").alias("name"), F.concat(F.lit("<noinclude>doc</noinclude>[{{brand|{{{1}}}}} of "), F.lower("p_type"), F.lit("]")).alias("text"))
    templates = templates.unionByName(kinds.select(F.concat(F.lit("Old "), F.col("p_type")).alias("name"), F.concat(F.lit("#REDIRECT [[Template:"), F.col("p_type"), F.lit("]]")).alias("text")))
    templates = templates.unionByName(spark.createDataFrame([("brand", "{{{1|none}}}<noinclude>{{brand}}</noinclude>")], "name string, text string"))
    return W.expanded_pages(pages, templates)


@query("html_items", """SELECT page_id, i - 1 AS item, regexp_extract(l[i], '>([^<]+)</a>', 1) AS label, regexp_extract(l[i], 'href="([^"]*)"', 1) AS target FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i
FROM (SELECT page_id, regexp_extract_all(html, '<li>\\s*<a href="[^"]*">[^<]*</a>\\s*</li>') AS l FROM pages) x) y""")
def html_items(spark, sf_dir):
    return W.html_items(V.table(spark, sf_dir, "pages"))


def _items(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("page"), F.lit(0).alias("listing"), F.col("turn").cast("int").alias("item"), F.split("text", " ").alias("tokens"))


@query("chunks")
def chunks(spark, sf_dir):
    items = _items(spark, sf_dir)
    context = items.select("page", "listing").distinct().withColumn("context", N.context_tokens(F.col("page"), F.lit("top"), F.lit("section")))
    return N.chunks(items, context).select("page", "listing", "chunk", "item", F.size("tokens").alias("n_tokens"))


@query("negative_items")
def negative_items(spark, sf_dir):
    return N.negative_items(_items(spark, sf_dir), 0.5).select("page", "listing", "item", F.size("tokens").alias("n_tokens"))


@query("tag_decode", """WITH t AS (SELECT 'c' || CAST(conv_id AS VARCHAR) AS page, CAST(turn AS INTEGER) AS item, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL),
f AS (SELECT page, item, w, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^\\p{Lu}') THEN 1 ELSE 0 END) AS c FROM t), s AS (SELECT *, list_position(c, 1) AS p FROM f WHERE list_contains(c, 1)),
e AS (SELECT *, list_position(c[p:], 0) AS z FROM s), r AS (SELECT page, 0 AS listing, item, CAST(p - 1 AS INTEGER) AS start, CAST(CASE WHEN z > 0 THEN p + z - 2 ELSE len(c) END AS INTEGER) AS stop, w FROM e)
SELECT page, listing, item, start, stop, 1 AS tag, array_to_string(w[start + 1:stop], ' ') AS label FROM r WHERE length(array_to_string(w[start + 1:stop], ' ')) > 2""")
def tag_decode(spark, sf_dir):
    return N.decode(N.tag(_items(spark, sf_dir)))


@query("frequent_labels", "WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, p_name AS label, count(*) OVER (PARTITION BY p_name) AS n FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT label, count(*) AS n FROM m WHERE n <= 90 OR label LIKE 'red%' GROUP BY label")
def frequent_labels(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("label"))
    m = V.table(spark, sf_dir, "lineitem").select("l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return N.prune_frequent(m.select("l_partkey", "label"), part.where("label LIKE 'red%'"), 90).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_WEAK = """m AS (SELECT l_suppkey AS page, l_returnflag AS listing, l_orderkey AS item, l_partkey AS ent, l_linenumber AS start FROM lineitem),
fl AS (SELECT m.*, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS pos, CASE WHEN p_size < 15 THEN 1 ELSE 0 END AS neg FROM m JOIN part ON ent = p_partkey),
k AS (SELECT *, max(pos) OVER (PARTITION BY page, listing, item) AS has, min(greatest(pos, neg)) OVER (PARTITION BY page, listing, item) AS al, sum(pos) OVER (PARTITION BY page, listing) AS n FROM fl)"""


def _weak(spark, sf_dir):
    m = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_returnflag").alias("listing"), F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("ent"), F.col("l_linenumber").alias("start"))
    seen = m.select("page", "ent").distinct().join(V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ent"), "p_type", "p_size"), "ent")
    return m, N.weak_labels(m, seen.where("p_type = 'PROMO'").select("page", "ent"), seen.where("p_size < 15").select("page", "ent"))


@query("weak_labels", f"WITH {_WEAK} SELECT page, listing, item, ent, pos AS label FROM k WHERE (n = 0 OR n > 2) AND (has = 1 OR al = 1)")
def weak_labels(spark, sf_dir):
    return _weak(spark, sf_dir)[1]


@query("first_mentions", f"WITH {_WEAK}, l AS (SELECT DISTINCT page, listing, item, ent FROM k WHERE n > 2 AND pos = 1) SELECT page, listing, item, min(start) AS start FROM m JOIN l USING (page, listing, item, ent) GROUP BY ALL")
def first_mentions(spark, sf_dir):
    m, labels = _weak(spark, sf_dir)
    return N.first_mentions(labels, m.withColumn("stop", F.col("start") + 1)).select("page", "listing", "item", "start")


@query("token_labels_span", """SELECT 'c' || CAST(conv_id AS VARCHAR) AS page, 0 AS listing, CAST(turn AS INTEGER) AS item, greatest(least(3, len(string_split(text, ' '))) - 1, 0) * 2 AS total FROM conversations WHERE text IS NOT NULL""")
def token_labels_span(spark, sf_dir):
    items = _items(spark, sf_dir)
    spans = items.select("page", "listing", "item").distinct().select("*", F.lit(1).alias("start"), F.lit(3).alias("stop"), F.lit(2).alias("tag"))
    return N.token_labels(items, spans).select("page", "listing", "item", F.aggregate("labels", F.lit(0), lambda a, x: a + x).alias("total"))


@query("main_entity", "WITH c AS (SELECT o_custkey AS page, o_orderstatus AS ent, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_custkey) AS total FROM orders GROUP BY o_custkey, o_orderstatus) SELECT page, 0 AS listing, ent FROM c WHERE n >= 0.75 * total")
def main_entity(spark, sf_dir):
    return N.main_entity(V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.lit(0).alias("listing"), F.col("o_orderstatus").alias("ent")))


@query("majority_tag", "SELECT chunk, tag FROM (SELECT l_suppkey AS chunk, l_linenumber AS tag, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem WHERE l_linenumber > 0 GROUP BY l_suppkey, l_linenumber) x WHERE r = 1")
def majority_tag(spark, sf_dir):
    return N.majority_tag(V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chunk"), F.col("l_linenumber").alias("tag")))


@query("entity_labels", "SELECT ent, label FROM (SELECT l_suppkey AS ent, p_name AS label, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_name) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_name) x WHERE r = 1")
def entity_labels(spark, sf_dir):
    return N.entity_info(_named(spark, sf_dir))[0]


@query("entity_forms", "SELECT l_suppkey AS ent, p_name AS form FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) > 2")
def entity_forms(spark, sf_dir):
    return N.entity_info(_named(spark, sf_dir))[1]


def _named(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("label"))
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ent"), "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select("ent", "label")


# ---- ontology


def _cat_edges(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    last = F.element_at(F.split("p_name", " "), -1)
    return part.select(F.lit("Thing").alias("parent"), last.alias("child")).unionByName(part.select(last.alias("parent"), F.col("p_name").alias("child"))).distinct()


@query("conceptual_graph", "SELECT DISTINCT split_part(p_name, ' ', -1) || 's' AS parent, p_name || 's' AS child FROM part UNION SELECT DISTINCT 'Thing', split_part(p_name, ' ', -1) || 's' FROM part")
def conceptual_graph(spark, sf_dir):
    name = lambda c: F.when(F.col(c) == "Thing", "Thing").otherwise(F.concat(c, F.lit("s"))).alias(c)
    edges = _cat_edges(spark, sf_dir).select(name("parent"), name("child"))
    odd = spark.createDataFrame([("Thing", "History"), ("History", "history of art")], "parent string, child string")
    every = edges.unionByName(odd)
    labels = every.select(F.explode(F.array("parent", "child")).alias("node")).distinct().withColumn("label", F.col("node"))
    return O.conceptual(every, labels, "Thing")[1]


@query("leaf_lists", "SELECT DISTINCT 'Thing' AS parent, split_part(p_name, ' ', -1) AS child FROM part")
def leaf_lists(spark, sf_dir):
    edges = _cat_edges(spark, sf_dir)
    return O.without_leaf_lists(edges, edges.where("parent <> 'Thing'").select(F.col("child").alias("node")).distinct())


@query("list_category_mapping", "SELECT DISTINCT 'list of ' || p_name AS list, p_name AS cat, 'equal' AS how FROM part")
def list_category_mapping(spark, sf_dir):
    names = V.table(spark, sf_dir, "part").select("p_name").distinct()
    lists = names.select(F.concat(F.lit("list of "), "p_name").alias("id"), F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("label"))
    cats = names.select(F.col("p_name").alias("id"), F.col("p_name").alias("label"))
    last = lambda c: F.element_at(F.split(c, " "), -1)
    candidates = lists.select(F.col("id").alias("list"), last("id").alias("k")).join(cats.select(F.col("id").alias("cat"), last("id").alias("k")), "k").select("list", "cat")
    return O.list_categories(lists, candidates, cats, spark.createDataFrame([], "a string, b string"))


@query("graph_merge", oracle("SELECT DISTINCT parent, child FROM kg_subclass UNION SELECT DISTINCT 'Product', p_name FROM part", "kg_subclass"))
def graph_merge(spark, sf_dir):
    base = V.subclass(spark, sf_dir)
    nodes = base.select(F.explode(F.array("parent", "child")).alias("node")).distinct().withColumn("label", F.col("node"))
    other = V.table(spark, sf_dir, "part").select(F.lit("c:product").alias("parent"), F.col("p_name").alias("child")).distinct()
    labels = other.select(F.explode(F.array("parent", "child")).alias("node")).distinct().withColumn("label", F.regexp_replace("node", "^c:", ""))
    return O.merge_graphs(base, nodes, other, labels)[0]


def _node_scores(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    types = H.transitive_types(V.types(spark, sf_dir), paths, "Thing")
    return O.type_resource_scores(V.categories(spark, sf_dir).withColumnRenamed("cat", "node"), types), paths


@query("node_type_scores", oracle(", size AS (SELECT cat, count(*) AS n FROM kg_categories GROUP BY cat HAVING count(*) >= 5) SELECT c.cat AS node, t.type, round(count(*) / s.n, 6) AS score FROM kg_categories c JOIN kg_transitive t ON t.ent = c.ent JOIN size s ON s.cat = c.cat GROUP BY c.cat, t.type, s.n", "kg_categories", "kg_transitive"))
def node_type_scores(spark, sf_dir):
    return _node_scores(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


def _mapping(spark, sf_dir):
    scores, paths = _node_scores(spark, sf_dir)
    lexical = scores.select("node", "type", F.when(F.col("type") == "Product", 0.3).otherwise(0.9).alias("score"))
    return O.node_types(scores, lexical, paths, spark.createDataFrame([("Agent", "Place"), ("Place", "Agent")], "a string, b string"))


@query("node_type_mapping")
def node_type_mapping(spark, sf_dir):
    return _mapping(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("propagated_types")
def propagated_types(spark, sf_dir):
    return O.propagate_types(_mapping(spark, sf_dir), _cat_edges(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("coherent_types")
def coherent_types(spark, sf_dir):
    return O.coherent_types(O.propagate_types(_mapping(spark, sf_dir), _cat_edges(spark, sf_dir)), spark.createDataFrame([("ECONOMY", "PROMO"), ("PROMO", "ECONOMY")], "a string, b string")).withColumn("score", F.round("score", 6))


_CONF = oracle(", d(a, b) AS (SELECT * FROM (VALUES ('Agent', 'Customer'), ('Customer', 'Agent'), ('Product', 'Agent')) v) SELECT s.parent, s.child FROM kg_subclass s JOIN d ON d.a = s.parent AND d.b = s.child", "kg_subclass")


def _conflict_input(spark, sf_dir):
    edges = V.subclass(spark, sf_dir)
    mapped = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct().withColumn("type", F.col("node"))
    return edges, mapped, spark.createDataFrame([("Agent", "Customer"), ("Customer", "Agent"), ("Product", "Agent")], "a string, b string")


@query("conflicting_edges", _CONF)
def conflicting_edges(spark, sf_dir):
    return O.conflicting_edges(*_conflict_input(spark, sf_dir))


@query("disjoint_repair", oracle("SELECT parent, child FROM kg_subclass WHERE NOT (parent = 'Agent' AND child = 'Customer') UNION ALL SELECT 'Thing', 'Customer'", "kg_subclass"))
def disjoint_repair(spark, sf_dir):
    return O.resolve_disjoint(*_conflict_input(spark, sf_dir), "Thing")


@query("disjoint_own", oracle(", d(a, b) AS (SELECT * FROM (VALUES ('Agent', 'Place'), ('Product', 'Event')) v UNION SELECT b, a FROM (VALUES ('Agent', 'Place'), ('Product', 'Event')) v(a, b)) SELECT a, b FROM d", "kg_subclass"))
def disjoint_own(spark, sf_dir):
    pairs = spark.createDataFrame([("Agent", "Place"), ("Product", "Event")], "a string, b string")
    edges = V.subclass(spark, sf_dir)
    return O.inherited_only(H.disjoint_closure(pairs, H.closure(edges)), edges)


@query("clean_types", oracle(", d(a, b) AS (SELECT * FROM (VALUES ('Supplier', 'Nation'), ('Nation', 'Supplier')) v), x AS (SELECT ent, type FROM kg_types UNION SELECT ent, 'Nation' FROM kg_types WHERE ent LIKE 'S%1') SELECT ent, type FROM x WHERE NOT EXISTS (SELECT 1 FROM x y JOIN d ON d.a = y.type WHERE y.ent = x.ent AND d.b = x.type)", "kg_types"))
def clean_types(spark, sf_dir):
    types = V.types(spark, sf_dir)
    odd = types.where("ent LIKE 'S%1'").select("ent", F.lit("Nation").alias("type"))
    return O.clean_types(types.unionByName(odd), _paths(spark, sf_dir), spark.createDataFrame([("Supplier", "Nation"), ("Nation", "Supplier")], "a string, b string"))


@query("listing_entity_merge", oracle("SELECT DISTINCT ent, 'Fresh' AS type FROM kg_types WHERE ent LIKE 'C%'", "kg_types"))
def listing_entity_merge(spark, sf_dir):
    known = V.types(spark, sf_dir).where("ent LIKE 'C%' OR ent LIKE 'S%'")
    found = known.select("ent", F.lit("page").alias("origin"), F.lit("Fresh").alias("type"), F.lit(3).alias("n"))
    return O.merge_listing_types(found, known, spark.createDataFrame([("Supplier", "Fresh"), ("Fresh", "Supplier")], "a string, b string"))


def _head_nodes(spark, sf_dir):
    labels = V.table(spark, sf_dir, "part").select(F.col("p_name").alias("node")).unionByName(V.table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), -1).alias("node"))).distinct()
    from sheaf.functions.text import lexical_head

    return labels.withColumn("h", lexical_head("node")).select("node", F.col("h.subjects").alias("heads"), F.col("h.rest").alias("rest"), F.col("h.other").alias("other"))


@query("append_unconnected", "SELECT DISTINCT split_part(p_name, ' ', -1) AS parent, p_name AS child FROM part UNION SELECT DISTINCT 'Thing', split_part(p_name, ' ', -1) FROM part")
def append_unconnected(spark, sf_dir):
    nodes = _head_nodes(spark, sf_dir)
    edges = nodes.where("node NOT LIKE '% %'").select(F.lit("Thing").alias("parent"), F.col("node").alias("child"))
    return H.append_unconnected(edges, nodes, "Thing")


@query("unrelated_edges", "SELECT DISTINCT 'Thing' AS parent, split_part(p_name, ' ', -1) AS child FROM part WHERE split_part(p_name, ' ', -1) <> 'widget'")
def unrelated_edges(spark, sf_dir):
    edges = _cat_edges(spark, sf_dir)
    heads = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct().withColumn("head", F.element_at(F.split("node", " "), -1))
    return H.unrelated_edges(edges, heads, spark.createDataFrame([("widget", "Thing")], "hypo string, hyper string"))


@query("merge_nodes", "SELECT DISTINCT p_name AS node, split_part(p_name, ' ', -1) AS target FROM part")
def merge_nodes(spark, sf_dir):
    edges = _cat_edges(spark, sf_dir)
    labels = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct().select("node", F.col("node").alias("label"), F.element_at(F.split("node", " "), -1).alias("canonical"))
    return H.merge_nodes(edges, labels)


@query("contracted_edges", "SELECT DISTINCT 'Thing' AS parent, split_part(p_name, ' ', -1) AS child FROM part")
def contracted_edges(spark, sf_dir):
    return H.contract(_cat_edges(spark, sf_dir), merge_nodes(spark, sf_dir))


# ---- sinks


@query("nt_objects", oracle(f"SELECT '<{KG}' || sub || '> <{KG}' || pred || '> <{KG}' || obj || '> .' AS value FROM kg_triples WHERE NOT is_literal", "kg_triples"))
def nt_objects(spark, sf_dir):
    iri = lambda c: S.encode_resource(F.concat(F.lit(KG), F.col(c)))
    return V.triples(spark, sf_dir).where("NOT is_literal").select(S.object_line(iri("sub"), F.concat(F.lit(KG), "pred"), iri("obj")).alias("value"))


@query("nt_literals", oracle(f"SELECT '<{KG}' || sub || '> <{KG}' || pred || '> \"' || obj || '\" .' AS value FROM kg_triples WHERE is_literal", "kg_triples"))
def nt_literals(spark, sf_dir):
    return V.triples(spark, sf_dir).where("is_literal").select(S.literal_line(F.concat(F.lit(KG), "sub"), F.concat(F.lit(KG), "pred"), F.col("obj")).alias("value"))


@query("nt_typed", f"SELECT '<{KG}O' || CAST(o_orderkey AS VARCHAR) || '> <{KG}day> \"' || strftime(o_orderdate, '%Y-%m-%d') || '\"^^<{S.XSD}date> .' AS value FROM orders UNION ALL SELECT '<{KG}P' || CAST(p_partkey AS VARCHAR) || '> <{KG}size> \"' || CAST(p_size AS VARCHAR) || '\"^^<{S.XSD}integer> .' FROM part")
def nt_typed(spark, sf_dir):
    o, p = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "part")
    name = lambda letter, key: F.concat(F.lit(KG + letter), F.col(key).cast("string"))
    return o.select(S.literal_line(name("O", "o_orderkey"), F.lit(KG + "day"), F.col("o_orderdate"), "date").alias("value")).unionByName(p.select(S.literal_line(name("P", "p_partkey"), F.lit(KG + "size"), F.col("p_size"), "integer").alias("value")))


@query("nt_types", oracle(f"SELECT '<' || ent || '> <{S.RDF}type> <{S.OWL}NamedIndividual> .' AS value FROM (SELECT DISTINCT ent FROM kg_types) x UNION ALL SELECT '<' || ent || '> <{S.RDF}type> <' || type || '> .' FROM kg_types", "kg_types"))
def nt_types(spark, sf_dir):
    return S.type_lines(V.types(spark, sf_dir))


@query("nt_transitive_types", oracle(f"SELECT '<' || t.ent || '> <{S.RDF}type> <' || t.type || '> .' AS value FROM kg_transitive t WHERE NOT EXISTS (SELECT 1 FROM kg_types k WHERE k.ent = t.ent AND k.type = t.type)", "kg_transitive"))
def nt_transitive_types(spark, sf_dir):
    types = V.types(spark, sf_dir)
    return S.transitive_type_lines(types, H.transitive_types(types, _paths(spark, sf_dir), "Thing"))


@query("nt_labels", f"""WITH l AS (SELECT '{KG}S' || CAST(s_suppkey AS VARCHAR) AS ent, s_name AS label, n_name AS form FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT '<' || ent || '> <{S.RDFS}label> "' || label || '" .' AS value FROM l UNION ALL SELECT '<' || ent || '> <{S.SKOS}prefLabel> "' || label || '" .' FROM l UNION ALL SELECT '<' || ent || '> <{S.SKOS}altLabel> "' || form || '" .' FROM l""")
def nt_labels(spark, sf_dir):
    s, n = V.table(spark, sf_dir, "supplier"), V.table(spark, sf_dir, "nation")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit(KG + "S"), F.col("s_suppkey").cast("string")).alias("ent"), F.col("s_name").alias("label"), F.col("n_name").alias("form"))
    return S.label_lines(rows.select("ent", "label"), rows.select("ent", "form").unionByName(rows.select("ent", F.col("label").alias("form"))))


@query("nt_ontology")
def nt_ontology(spark, sf_dir):
    edges = V.subclass(spark, sf_dir)
    classes = edges.select(F.explode(F.array("parent", "child")).alias("iri")).distinct()
    predicates = spark.createDataFrame([("inNation", True), ("name", False)], "iri string, is_object boolean")
    disjoint = spark.createDataFrame([("Agent", "Place"), ("Place", "Agent")], "a string, b string")
    restrictions = spark.createDataFrame([("Agent", "kind", "actor", True), ("Customer", "kind", "actor", True)], "cls string, pred string, value string, is_literal boolean")
    return S.ontology_lines(classes, edges, classes.select("iri", F.col("iri").alias("label")), predicates, disjoint, restrictions)


@query("nt_metadata")
def nt_metadata(spark, sf_dir):
    t = V.triples(spark, sf_dir)
    return S.metadata_lines(KG, t.select("sub").distinct(), V.types(spark, sf_dir).select("type").distinct(), t.select("pred").distinct(), "demo", "2024-01-01")


@query("nt_links", f"SELECT '<{KG}' || n_name || '> <{S.OWL}sameAs> <http://seed.example/' || n_name || '> .' AS value FROM nation UNION ALL SELECT '<{KG}' || n_name || '> <{S.PROV}wasDerivedFrom> <http://page.example/' || n_name || '> .' FROM nation UNION ALL SELECT '<{KG}' || n_name || '> <{S.RDFS}subClassOf> <http://seed.example/' || n_name || '> .' FROM nation")
def nt_links(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    ent, seed = F.concat(F.lit(KG), "n_name"), F.concat(F.lit("http://seed.example/"), "n_name")
    return (
        S.same_as_lines(n.select(ent.alias("ent"), seed.alias("seed")))
        .unionByName(S.provenance_lines(n.select(ent.alias("iri"), F.concat(F.lit("http://page.example/"), "n_name").alias("source"))))
        .unionByName(S.mapping_lines(n.select(ent.alias("node"), seed.alias("seed"), F.lit(False).alias("is_predicate"))))
    )


@query("nt_relations", oracle("SELECT CASE WHEN is_literal THEN '<' || sub || '> <' || pred || '> \"' || obj || '\" .' ELSE '<' || sub || '> <' || pred || '> <' || obj || '> .' END AS value FROM kg_triples WHERE pred IN ('brand', 'inNation')", "kg_triples"))
def nt_relations(spark, sf_dir):
    return S.relation_lines(V.triples(spark, sf_dir).where("pred IN ('brand', 'inNation')").select(F.col("sub").alias("ent"), "pred", F.col("obj").alias("value"), "is_literal"))


@query("seed_new_types", oracle("SELECT ent, type FROM kg_transitive EXCEPT SELECT ent, type FROM kg_types", "kg_transitive"))
def seed_new_types(spark, sf_dir):
    types = V.types(spark, sf_dir)
    return S.new_rows(H.transitive_types(types, _paths(spark, sf_dir), "Thing"), types, ["ent", "type"])


@query("type_distribution", oracle("SELECT type, count(DISTINCT ent) AS n FROM (SELECT ent, type FROM kg_types UNION SELECT t.ent, c.ancestor FROM kg_types t JOIN kg_closure c ON c.descendant = t.type) x GROUP BY type", "kg_types", "kg_closure"))
def type_distribution(spark, sf_dir):
    return S.type_distribution(V.types(spark, sf_dir), _paths(spark, sf_dir))


@query("sunburst")
def sunburst(spark, sf_dir):
    edges = V.subclass(spark, sf_dir)
    return spark.createDataFrame([(S.sunburst_json(S.type_distribution(V.types(spark, sf_dir), H.closure(edges)), edges, "Thing"),)], "json string")


@query("statistics", oracle(""", p AS (SELECT ent AS k, count(*) AS n FROM kg_types GROUP BY 1), q AS (SELECT type AS k, count(*) AS n FROM kg_types GROUP BY 1) SELECT * FROM (
SELECT 'types_subjects' AS measure, count(*)::DOUBLE AS value FROM p UNION ALL SELECT 'types_rows', sum(n)::DOUBLE FROM p UNION ALL SELECT 'types_mean', round(avg(n), 6) FROM p UNION ALL SELECT 'types_median', median(n)::DOUBLE FROM p UNION ALL SELECT 'types_max', max(n)::DOUBLE FROM p
UNION ALL SELECT 'members_subjects', count(*)::DOUBLE FROM q UNION ALL SELECT 'members_rows', sum(n)::DOUBLE FROM q UNION ALL SELECT 'members_mean', round(avg(n), 6) FROM q UNION ALL SELECT 'members_median', median(n)::DOUBLE FROM q UNION ALL SELECT 'members_max', max(n)::DOUBLE FROM q) x""", "kg_types"))
def statistics(spark, sf_dir):
    types, edges = V.types(spark, sf_dir), V.subclass(spark, sf_dir)
    facts = V.triples(spark, sf_dir).select(F.col("sub").alias("ent"), "pred")
    labels = V.table(spark, sf_dir, "part").select(F.col("p_name").alias("label"))
    every = S.statistics(types, facts, edges, labels, H.depths(edges, "Thing"))
    return every.where("measure LIKE 'types%' OR measure LIKE 'members%'").withColumn("value", F.round("value", 6))


@query("evaluation_lines", "SELECT 'd' || CAST(vec_id AS VARCHAR) || chr(9) || '0' || chr(9) || '1' || chr(9) || 'NIL' || CAST(label AS VARCHAR) || chr(9) || '1.0' || chr(9) AS value FROM embeddings")
def evaluation_lines(spark, sf_dir):
    return S.evaluation_lines(V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("mention"), F.col("label").alias("cluster")))
