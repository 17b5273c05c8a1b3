"""Queries of text functions, linkage, clustering and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.operators import clustering as C
from sheaf.operators import linkage as L
from sheaf.operators import metrics as M
from sheaf.operators.components import connected_components
from sheaf.plans import views as V
from sheaf.plans.registry import query
from sheaf.session import materialize

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def _key_sql(label: str) -> str:
    words = f"list_filter(string_split_regex(regexp_replace(lower({label}), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
    kept = f"list_filter({words}, lambda w: NOT list_contains([{_STOP}], w))"
    return f"array_to_string(list_sort(list_distinct(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words} END)), ' ')"


def mentions(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    line = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("p_name").alias("label"), "l_partkey", "l_orderkey", "l_linenumber")


def entities(spark, sf_dir):
    return V.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("id")).select("id", "label")


def vectors(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_MENTIONS = "mentions AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, p_name AS label FROM lineitem JOIN part ON l_partkey = p_partkey), entities AS (SELECT min(p_partkey) AS id, p_name AS label FROM part GROUP BY p_name)"


@query("name_normalise", """SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS capital, replace(p_name, ' ', '_') AS name, 'http://kg.example/' || replace(p_name, ' ', '_') AS iri,
trim(regexp_replace('  ' || p_name || '   x ', '\\s+', ' ', 'g')) AS spaces, replace(p_brand, '-', '_') AS separators, CASE WHEN length(trim(regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))) > 2
THEN trim(regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) ELSE p_brand END AS plain FROM part""")
def name_normalise(spark, sf_dir):
    n, b = F.col("p_name"), F.col("p_brand")
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", X.capitalize(n).alias("capital"), X.label_to_name(n).alias("name"), X.name_to_iri(X.label_to_name(n), "http://kg.example/").alias("iri"),
        X.regular_spaces(F.concat(F.lit("  "), n, F.lit("   x "))).alias("spaces"), X.normal_separators(b).alias("separators"), X.alphanumeric(b).alias("plain"),
    )


@query("bracket_removal", "SELECT doc_id, trim(regexp_replace(text, '\\s*\\([^()]*\\)\\s*', ' ', 'g')) AS plain FROM documents")
def bracket_removal(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", X.remove_brackets(F.col("text")).alias("plain"))


@query("canonical_label", "SELECT p_partkey, trim(regexp_replace(p_name, '\\s+[A-Z]\\s*[-]\\s*[A-Z]$', '')) AS label FROM part")
def canonical_label(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", X.canonical_label(F.concat("p_name", F.lit(": A-C"))).alias("label"))


@query("casing_transfer", "SELECT n_nationkey, CASE WHEN true THEN upper(lower(n_name)[1]) || lower(n_name)[2:] END AS cased FROM nation")
def casing_transfer(spark, sf_dir):
    return V.table(spark, sf_dir, "nation").select("n_nationkey", X.transfer_casing(X.capitalize(F.lower("n_name")), F.upper("n_name")).alias("cased"))


@query("label_tokens", f"SELECT p_partkey, {_key_sql('p_name')} AS key FROM part")
def label_tokens(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", L.word_key(F.col("p_name")).alias("key"))


@query("token_labels", "SELECT conv_id, turn, regexp_replace(ltrim(text), '[ ,(]+$', '') AS label FROM conversations WHERE text IS NOT NULL")
def token_labels(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    tokens = F.split("text", " ")
    spaces = F.transform(tokens, lambda t, i: F.when(i == F.size(tokens) - 1, "").otherwise(" "))
    return rows.select("conv_id", "turn", X.token_label(tokens, spaces).alias("label"))


@query("valid_labels", "SELECT p_partkey, length(p_brand) > 2 AND NOT regexp_full_match(p_brand, '[0-9]+') AS valid FROM part")
def valid_labels(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", X.valid_label(F.col("p_brand")).alias("valid"))


@query("same_words", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_name = b.n_name AS same FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def same_words(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    left, right = (n.select(F.col("n_nationkey").alias(x), F.col("n_name").alias(f"{x}_name"), "n_regionkey") for x in "ab")
    return left.join(right, "n_regionkey").select("a", "b", X.same_words(F.concat(F.lit("X "), "a_name"), F.concat(F.col("b_name"), F.lit(" x"))).alias("same"))


@query("lexhead", "SELECT p_partkey, split_part(p_name, ' ', -1) AS head, split_part(p_name, ' ', 1) AS rest, false AS plural FROM part")
def lexhead(spark, sf_dir):
    h = X.lexical_head("p_name")
    return V.table(spark, sf_dir, "part").withColumn("h", h).select("p_partkey", F.col("h.subjects")[0].alias("head"), F.array_join("h.rest", " ").alias("rest"), F.col("h.plural").alias("plural"))


@query("by_phrase", "SELECT p_partkey, p_name AS label FROM part")
def by_phrase(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", X.remove_by_phrase(F.concat("p_name", F.lit(" by country"))).alias("label"))


@query("singularise", "SELECT p_partkey, p_name AS label FROM part")
def singularise(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", X.singularize(F.concat("p_name", F.lit("s"))).alias("label"))


@query("content_lemmas")
def content_lemmas(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.content_lemmas("p_name"), " ").alias("lemmas"))


def _hearst_sql() -> str:
    word, no, beside = X._WORD.replace("'", "''"), X.NO_NOUNS, X.BESIDE
    tail = f"regexp_replace(regexp_extract(right(p[i], {beside}), '((?:{word}\\s+){{0,3}}{word})\\z', 1), '\\s+', ' ', 'g')"
    head = f"regexp_replace(regexp_replace(regexp_extract(left(p[i + 1], {beside}), '^((?:{word}\\s+){{0,3}}{word})', 1), '\\s+', ' ', 'g'), '^(?:{X.OPENERS}) ', '')"
    each = []
    for words, left in X.HEARST:
        pattern = rf"\s+{words}\s+".replace(" ", r"\s+")
        b, a = ("hyper", "hypo") if left else ("hypo", "hyper")
        each.append(f"""SELECT CASE WHEN t <> '' AND NOT regexp_matches(t, '(?:^| )(?:{no})\\z') THEN trim(regexp_replace(' ' || t, '^.* (?:{no}) ', ' ')) END AS {b},
CASE WHEN h <> '' AND NOT regexp_matches(h, '^(?:{no})(?: |\\z)') THEN regexp_extract(h, '^(.*?)(?: (?:{no})(?: .*)?)?\\z', 1) END AS {a}
FROM (SELECT {tail} AS t, {head} AS h FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split_regex(lower(text), '{pattern}') AS p FROM documents WHERE text IS NOT NULL) x) y) z""")
    return "SELECT hypo, hyper, count(*) AS n FROM (" + " UNION ALL BY NAME ".join(each) + ") u WHERE hypo <> hyper GROUP BY ALL"


@query("hearst_pairs", _hearst_sql())
def hearst_pairs(spark, sf_dir):
    pairs = V.table(spark, sf_dir, "documents").select(F.explode(X.hearst_pairs(F.col("text"))).alias("p"))
    return pairs.groupBy("p.hypo", "p.hyper").agg(F.count(F.lit(1)).alias("n"))


@query("type_lexicalisations", "WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS lemma, p_type AS type FROM part) SELECT lemma, type, count(*) AS n FROM w GROUP BY ALL")
def type_lexicalisations(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    return part.select(F.explode(F.split("p_name", " ")).alias("lemma"), F.col("p_type").alias("type")).groupBy("lemma", "type").agg(F.count(F.lit(1)).alias("n"))


@query("match_exact", f"WITH {_MENTIONS} SELECT m.id AS src, e.id AS dst, 1.0::DOUBLE AS score FROM mentions m JOIN entities e ON lower(m.label) = lower(e.label)")
def match_exact(spark, sf_dir):
    return L.match_on_key(mentions(spark, sf_dir).select("id", "label").distinct(), entities(spark, sf_dir), L.exact_key)


@query("match_word", f"WITH {_MENTIONS} SELECT m.id AS src, e.id AS dst, 1.0::DOUBLE AS score FROM mentions m JOIN entities e ON {_key_sql('m.label')} = {_key_sql('e.label')}")
def match_word(spark, sf_dir):
    return L.match_on_key(mentions(spark, sf_dir).select("id", "label").distinct(), entities(spark, sf_dir), L.word_key)


@query("match_pairs", "SELECT a.s_suppkey AS src, b.s_suppkey AS dst, 1.0::DOUBLE AS score FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def match_pairs(spark, sf_dir):
    rows = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("label"))
    return L.match_on_key(rows, None, L.exact_key)


@query("match_bm25", f"""WITH {_MENTIONS}, docs AS (SELECT id AS dst, unnest(list_distinct(string_split(lower(label), ' '))) AS term FROM entities), sizes AS (SELECT dst, count(*) AS len FROM docs GROUP BY dst),
stats AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM sizes), df AS (SELECT term, count(*) AS df FROM docs GROUP BY term),
idx AS (SELECT d.dst, d.term, ln(1 + (stats.docs - df.df + 0.5) / (df.df + 0.5)) * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * s.len / stats.avg_len)) AS w FROM docs d JOIN sizes s ON s.dst = d.dst JOIN df ON df.term = d.term CROSS JOIN stats),
q AS (SELECT DISTINCT label FROM mentions), t AS (SELECT label, unnest(list_distinct(string_split(lower(label), ' '))) AS term FROM q),
sc AS (SELECT t.label, i.dst, sum(i.w) AS score FROM t JOIN idx i ON i.term = t.term GROUP BY t.label, i.dst),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, dst) AS r FROM sc) x WHERE r <= 4)
SELECT m.id AS src, b.dst, round(b.score, 6) AS score FROM mentions m JOIN b ON b.label = m.label""")
def match_bm25(spark, sf_dir):
    return L.bm25(mentions(spark, sf_dir).select("id", "label").distinct(), entities(spark, sf_dir)).withColumn("score", F.round("score", 6))


_KNN = """knn AS (SELECT src, dst, score FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS r
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) x WHERE r <= 4)"""


@query("knn_topk", f"WITH {_KNN} SELECT src, dst, round(score, 6) AS score FROM knn")
def knn_topk(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "vector")
    return L.nearest(v, v, 4).withColumn("score", F.round("score", 6))


@query("knn_lsh")
def knn_lsh(spark, sf_dir):
    return L.nearest_lsh(vectors(spark, sf_dir), 4).withColumn("score", F.round("score", 6))


def _pairs(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "vector")
    near = L.nearest(v, v, 4).where("score > 0")
    norm = v.select("id", F.sqrt(L.dot(F.col("vector"), F.col("vector"))).alias("n"))
    both = near.join(norm.select(F.col("id").alias("src"), F.col("n").alias("ns")), "src").join(norm.select(F.col("id").alias("dst"), F.col("n").alias("nd")), "dst")
    return both.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.round(F.col("score") / (F.col("ns") * F.col("nd")), 4).alias("score")).distinct()


_PAIRS = f"""{_KNN}, nrm AS (SELECT vec_id, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
pairs AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, round(score / (x.n * y.n), 4) AS score FROM knn JOIN nrm x ON x.vec_id = src JOIN nrm y ON y.vec_id = dst WHERE score > 0)"""
_COMPONENTS = """edges AS (SELECT src AS a, dst AS b FROM pairs WHERE score > 0.4 UNION SELECT dst, src FROM pairs WHERE score > 0.4),
comp AS (SELECT node, min(reach) AS component FROM (WITH RECURSIVE w(node, reach) AS (SELECT a, a FROM edges UNION SELECT w.node, e.b FROM w JOIN edges e ON e.a = w.reach) SELECT * FROM w) GROUP BY node)"""


@query("alignment_graph", f"WITH {_PAIRS} SELECT 'm' || CAST(src AS VARCHAR) AS a, 'm' || CAST(dst AS VARCHAR) AS b, least(score, 1.0) AS w FROM pairs WHERE score > 0.4")
def alignment_graph(spark, sf_dir):
    return C.alignment_graph(_pairs(spark, sf_dir), None, 0.4, 1.0, entities=False)


@query("connected_components", f"WITH {_PAIRS}, {_COMPONENTS} SELECT node, component FROM comp")
def components(spark, sf_dir):
    return connected_components(_pairs(spark, sf_dir).where("score > 0.4"))


def _cluster_input(spark, sf_dir):
    mm = materialize(_pairs(spark, sf_dir), "pairs")  # read several times by what follows
    v = vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min("id").alias("dst")).select("dst")  # the first vector of each label stands for an entity
    return mm, mm.select("dst", "src", "score").join(first, "dst", "left_semi").select("src", "dst", "score"), v.select("id")


@query("cluster_nasty")
def cluster_nasty(spark, sf_dir):
    return C.nasty(*_cluster_input(spark, sf_dir), 0.4, 0.45, 0.15)


@query("cluster_majority")
def cluster_majority(spark, sf_dir):
    return C.majority(*_cluster_input(spark, sf_dir), 0.4, 0.45, 0.3)


@query("cluster_bottom_up")
def cluster_bottom_up(spark, sf_dir):
    return C.bottom_up(*_cluster_input(spark, sf_dir), 0.4, 0.45)


@query("cluster_ids", "WITH g AS (SELECT n_regionkey AS c, min(n_nationkey) AS least FROM nation GROUP BY n_regionkey), r AS (SELECT c, row_number() OVER (ORDER BY least) - 1 + 1000 AS idx FROM g WHERE c >= 3) SELECT n_nationkey AS mention, CASE WHEN n_regionkey < 3 THEN n_regionkey ELSE r.idx END AS idx FROM nation LEFT JOIN r ON r.c = n_regionkey")
def cluster_ids(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    rows = n.select(F.col("n_nationkey").cast("bigint").alias("mention"), F.col("n_regionkey").cast("string").alias("cluster"), F.when(F.col("n_regionkey") < 3, F.col("n_regionkey").cast("bigint")).alias("entity"))
    return C.cluster_ids(rows, 1000)


@query("rerank_best_entity", f"""WITH {_MENTIONS}, cand AS (SELECT m.id AS src, m.label AS a, e.id AS dst, e.label AS b FROM mentions m JOIN entities e ON split_part(m.label, ' ', 1) = split_part(e.label, ' ', 1)),
sc AS (SELECT src, dst, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS score FROM cand)
SELECT src, dst, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM sc) x WHERE r = 1""")
def rerank_best_entity(spark, sf_dir):
    m, e = mentions(spark, sf_dir).select("id", "label"), entities(spark, sf_dir)
    return L.rerank_on_key(m, e, lambda c: F.split(c, " ")[0]).withColumn("score", F.round("score", 6))


@query("popular_candidate", """WITH pop AS (SELECT l_partkey AS dst, count(*) AS popularity FROM lineitem GROUP BY 1), cand AS (SELECT o.p_partkey AS src, e.p_partkey AS dst FROM part o JOIN part e ON o.p_brand = e.p_brand AND o.p_type = e.p_type)
SELECT src, dst, 1.0::DOUBLE AS score FROM (SELECT c.src, c.dst, row_number() OVER (PARTITION BY c.src ORDER BY coalesce(popularity, 0) DESC, c.dst) AS r FROM cand c LEFT JOIN pop ON pop.dst = c.dst) x WHERE r = 1""")
def popular_candidate(spark, sf_dir):
    part, key = V.table(spark, sf_dir, "part"), ["p_brand", "p_type"]
    pop = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("popularity"))
    return L.popular_on_key(part.select(F.col("p_partkey").alias("src"), *key), part.select(F.col("p_partkey").alias("dst"), *key), key, pop)


@query("ordered_candidates", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, CAST(max(struct_pack(a := l_orderkey * 10 + l_linenumber, s := l_quantity)).s AS DOUBLE) AS score FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def ordered_candidates(spark, sf_dir):
    line = V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return L.ordered_pairs(line, "at")


@query("nil_consistent", "WITH k AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey NOT IN (SELECT id FROM k) AND o_custkey NOT IN (SELECT id FROM k)")
def nil_consistent(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    pairs = orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return L.nil_consistent(pairs, orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), True).select("src", "dst")


@query("training_pairs", f"""WITH {_KNN}, al AS (SELECT vec_id AS mention, label AS entity FROM embeddings)
SELECT a.mention AS src, b.mention AS dst, 1 AS label FROM al a JOIN al b ON a.entity = b.entity AND a.mention < b.mention
UNION ALL SELECT src, dst, 0 FROM (SELECT k.src, k.dst, row_number() OVER (PARTITION BY k.src ORDER BY k.score DESC, k.dst) AS r FROM knn k JOIN al a ON a.mention = k.src JOIN al b ON b.mention = k.dst WHERE a.entity <> b.entity) x WHERE r <= 1""")
def training_pairs(spark, sf_dir):
    v = vectors(spark, sf_dir)
    near = L.nearest(v, v, 4)
    return L.training_pairs(v.select(F.col("id").alias("mention"), F.col("label").alias("entity")), near)


@query("corpus_split")
def corpus_split(spark, sf_dir):
    return L.corpus_split(V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")))


@query("mention_inputs")
def mention_inputs(spark, sf_dir):
    m = mentions(spark, sf_dir).select("id", "label", F.col("l_orderkey").cast("string").alias("page"), F.lit("items").alias("section"), F.col("l_orderkey").alias("listing"), F.col("l_linenumber").alias("item"))
    return L.mention_input(m)


@query("entity_inputs", """WITH f AS (SELECT s_suppkey AS id, list_sort(list_distinct([concat_ws(' ', 'inNation', n_name), concat_ws(' ', 'balance', CASE WHEN s_acctbal > 0 THEN 'positive' ELSE 'negative' END)])) AS l FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey AS id, concat_ws(' [SEP] ', s_name, CASE WHEN s_acctbal > 5000 THEN 'abstract of ' || s_name END, array_to_string(l, ', ')) AS text FROM supplier JOIN f ON f.id = s_suppkey""")
def entity_inputs(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier")
    n = V.table(spark, sf_dir, "nation")
    facts = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.lit("inNation").alias("pred"), F.col("n_name").alias("value")).unionByName(
        s.select(F.col("s_suppkey").alias("id"), F.lit("balance").alias("pred"), F.when(F.col("s_acctbal") > 0, "positive").otherwise("negative").alias("value"))
    )
    abstracts = s.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("abstract of "), "s_name").alias("abstract"))
    return L.entity_input(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")), abstracts, facts)


def _labels(spark, sf_dir):
    parts = connected_components(_pairs(spark, sf_dir).where("score > 0.4"))
    v = vectors(spark, sf_dir).select("id", F.col("label").alias("gold"))
    return v.join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("pred"), "gold")


_LAB = f"{_PAIRS}, {_COMPONENTS}, lab AS (SELECT vec_id AS id, coalesce(component, vec_id) AS pred, label AS gold FROM embeddings LEFT JOIN comp ON node = vec_id)"


@query("contingency_table", f"WITH {_LAB} SELECT pred, gold, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY pred) AS BIGINT) AS a, CAST(sum(count(*)) OVER (PARTITION BY gold) AS BIGINT) AS b FROM lab GROUP BY pred, gold")
def contingency_table(spark, sf_dir):
    return M.contingency(_labels(spark, sf_dir))


@query("clustering_scores", f"""WITH {_LAB}, c AS (SELECT pred, gold, count(*) AS n, sum(count(*)) OVER (PARTITION BY pred) AS a, sum(count(*)) OVER (PARTITION BY gold) AS b FROM lab GROUP BY pred, gold),
j AS (SELECT sum(n) AS N, sum(n * (n - 1) / 2) AS sn, sum(n * n / a) AS bp, sum(n * n / b) AS br, count(*) AS cells, sum(n * ln(n)) AS hn FROM c),
r AS (SELECT sum(a * (a - 1) / 2) AS sa, count(*) AS na, sum(a * ln(a)) AS ha FROM (SELECT DISTINCT pred, a FROM c)), k AS (SELECT sum(b * (b - 1) / 2) AS sb, count(*) AS nb, sum(b * ln(b)) AS hb FROM (SELECT DISTINCT gold, b FROM c)),
m AS (SELECT CAST(N AS BIGINT) AS n, (sn - sa * sb / (N * (N - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (N * (N - 1) / 2)) AS ari, 2 * ((hn - ha - hb) / N + ln(N)) / (2 * ln(N) - ha / N - hb / N) AS nmi,
  bp / N AS p, br / N AS r, (N - cells) / (N - na) AS mp, (N - cells) / (N - nb) AS mr FROM j, r, k)
SELECT n, round(ari, 6) AS ari, round(nmi, 6) AS nmi, round(p, 6) AS b3_precision, round(r, 6) AS b3_recall, round(2 * p * r / (p + r), 6) AS b3_f1, round(mp, 6) AS muc_precision, round(mr, 6) AS muc_recall, round(2 * mp * mr / (mp + mr), 6) AS muc_f1 FROM m""")
def clustering_scores(spark, sf_dir):
    scores = M.clustering_scores(_labels(spark, sf_dir))
    return scores.select("n", *[F.round(c, 6).alias(c) for c in scores.columns if c != "n"])


@query("ceaf_scores")
def ceaf_scores(spark, sf_dir):
    return M.ceaf(_labels(spark, sf_dir))


@query("cluster_assignment")
def cluster_assignment(spark, sf_dir):
    return M.assignment(M.contingency(_labels(spark, sf_dir)))


@query("match_counts", "SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairs FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def match_counts(spark, sf_dir):
    return M.pair_count(vectors(spark, sf_dir), "label")


@query("precision_recall", f"""WITH {_KNN}, p AS (SELECT DISTINCT src, dst FROM knn), g AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
c AS (SELECT (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM g) AS actual, (SELECT count(*) FROM p JOIN g USING (src, dst)) AS correct)
SELECT predicted, actual, correct, round(correct / predicted, 6) AS precision, round(correct / actual, 6) AS recall, round(2 * (correct / predicted) * (correct / actual) / (correct / predicted + correct / actual), 6) AS f1 FROM c""")
def precision_recall(spark, sf_dir):
    v = vectors(spark, sf_dir)
    out = M.precision_recall_of_labels(L.nearest(v, v, 4), v)
    return out.select("predicted", "actual", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("span_metrics")
def span_metrics(spark, sf_dir):
    docs = V.table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    tags = F.transform(F.split("text", " "), lambda w: F.when(w.rlike("^[A-Z]"), 1).otherwise(0))
    shifted = F.transform(tags, lambda t, i: F.when((i % 7 == 3), 0).otherwise(t))
    return M.span_scores(docs.select(shifted.alias("pred"), tags.alias("gold")))


def _alignment(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select(F.col("id").alias("mention"), F.col("label").cast("bigint").alias("entity"), (F.col("label") < 6).alias("is_known"))


_PARTS = "al AS (SELECT vec_id AS mention, CAST(label AS BIGINT) AS entity, label < 6 AS is_known FROM embeddings), parted AS (SELECT 'all' AS part, mention, entity FROM al UNION ALL SELECT CASE WHEN is_known THEN 'known' ELSE 'unknown' END, mention, entity FROM al)"


@query("evaluation_counts", f"WITH {_PARTS}, g AS (SELECT part, entity, count(*) AS n FROM parted GROUP BY part, entity) SELECT part, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS entities, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairs FROM g GROUP BY part")
def evaluation_counts(spark, sf_dir):
    from sheaf.operators import evaluation as E

    return E.counts(_alignment(spark, sf_dir))


@query("evaluation_parts", f"""WITH {_KNN}, {_PARTS}, p AS (SELECT DISTINCT k.src, CAST(e.label AS BIGINT) AS dst FROM knn k JOIN embeddings e ON e.vec_id = k.dst),
m AS (SELECT x.part, count(*) AS predicted, count(*) FILTER (WHERE p.dst = x.entity) AS correct FROM p JOIN parted x ON x.mention = p.src GROUP BY x.part), a AS (SELECT part, count(*) AS actual FROM parted GROUP BY part)
SELECT a.part, predicted, actual, correct, round(correct / predicted, 6) AS precision, round(correct / actual, 6) AS recall, round(2 * (correct / predicted) * (correct / actual) / (correct / predicted + correct / actual), 6) AS f1 FROM a JOIN m ON m.part = a.part""")
def evaluation_parts(spark, sf_dir):
    from sheaf.operators import evaluation as E

    v = vectors(spark, sf_dir)
    near = L.nearest(v, v, 4)
    named = near.join(v.select(F.col("id").alias("dst"), F.col("label").cast("bigint").alias("entity")), "dst").select("src", F.col("entity").alias("dst"))
    scores = E.mention_scores(named, _alignment(spark, sf_dir))
    return scores.select("part", "predicted", "actual", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("grid_search")
def grid_search(spark, sf_dir):
    from sheaf.operators import evaluation as E

    mm, me, _ = _cluster_input(spark, sf_dir)
    out = E.grid_search(mm, me, _alignment(spark, sf_dir), "majority", {"mm_least": [0.4, 0.5], "share": [0.3]})
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("disambiguated", f"WITH {_MENTIONS} SELECT m.id AS mention, e.id AS idx FROM mentions m JOIN entities e ON m.label = e.label")
def disambiguated(spark, sf_dir):
    from sheaf.operators import evaluation as E

    return E.disambiguate(mentions(spark, sf_dir).select("id", "label").distinct(), entities(spark, sf_dir), "exact", "majority", mm_least=2.0, me_least=0.5)
