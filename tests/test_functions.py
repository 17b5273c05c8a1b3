"""Text functions, parsers and formulas on small inline cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.functions import wikitext as W
from sheaf.operators import axioms, clustering, hierarchy, linkage, listing_rules, mentions, metrics, ontology
from sheaf.operators.components import connected_components
from sheaf.sources import readers, sinks


@pytest.mark.parametrize("text,left", [("Lists of ships by country", "Lists of ships"), ("People by city in France", "People in France"), ("Books written by Anna", "Books written by Anna"), ("by train", "by train"), ("Rivers", "Rivers")])
def test_by_phrase(text, left):
    assert X.split_by_phrase(text)[0] == left


@pytest.mark.parametrize("label,subjects,plural", [("German male writers", ["writer"], True), ("Cities and towns in Peru", ["city", "town"], True), ("History of art", ["history"], False), ("Physics", ["physics"], False), ("", [], False)])
def test_heads(label, subjects, plural):
    got = X.head_parts(label)
    assert got[0] == subjects and got[4] == plural


@pytest.mark.parametrize("plural,singular", [("cities", "city"), ("boxes", "box"), ("Men", "Man"), ("buses", "buse"), ("gas", "ga"), ("news", "news"), ("classes", "class"), ("ships", "ship")])
def test_singular(plural, singular):
    assert X.singular(plural) == singular


def test_column_functions(spark):
    df = spark.createDataFrame([("iPhone dogs ", "Foo  (bar [x]) baz", "ÉCOLE-a the", None)], "a string, b string, c string, d string")
    got = df.select(
        X.capitalize(F.col("a")), X.remove_brackets(F.col("b")), X.remove_brackets(F.col("b"), "["), F.array_join(X.label_tokens(F.col("c")), " "), X.transfer_casing(F.lit("ABc"), F.lit("xyzw")), X.capitalize(F.col("d")),
        X.canonical_label(F.lit("Ships by country: A-C")), X.singularize(F.lit("cats and dogs in France")), X.valid_label(F.lit("12")), X.valid_label(F.lit("12a")), X.same_words(F.lit("A b"), F.lit("B a a")),
    ).first()
    assert tuple(got) == ("IPhone dogs ", "Foo baz", "Foo  (bar ) baz", "a ecole" if "a" not in X.STOPWORDS else "ecole", "XYzw", None, "Ships", "cat or dog in France", False, True, True)


@pytest.mark.parametrize("text,pairs", [
    ("A cat is a small mammal; it was an old town.", {("cat", "small mammal")}), ("Dogs, cats and other animals", {("cats", "animals")}), ("bread or other food in shops", {("bread", "food")}),
    ("European cities including Paris.", {("paris", "european cities")}), ("fruits such as the red apples from Kent", {("red apples", "fruits")}), ("many birds especially herons", {("herons", "many birds")}),
    ("sports particularly\n  rowing", {("rowing", "sports")}), ("colours other than green", {("green", "colours")}), ("Fruits, such as apples", set()), ("They are a band", set()), ("things like it", set()), ("such as", set()), (None, set()), ("", set()),
    ("Lakes are a source and rivers were an origin of water", {("lakes", "source"), ("rivers", "origin")}),
])
def test_hearst(spark, text, pairs):
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(X.hearst_pairs(F.col("t"))).alias("p")).select("p.*").collect()
    assert {tuple(r) for r in rows} == pairs


def test_pages_that_fail_or_take_long_leave_an_error_row(spark, monkeypatch):
    pages = spark.createDataFrame([("Good", MARKUP), ("Slow", "slow"), ("Bad", "bad"), (None, "x"), ("Null", None), ("Long", "x" * 6_000_000 + MARKUP)], "title string, text string")
    parse = W.parse_page

    def stand_in(title, text):
        if text == "slow":
            while True:
                pass
        if text == "bad":
            raise IndexError
        return parse(title, text)

    monkeypatch.setattr(W, "parse_page", stand_in)
    rows = W.parsed_pages(pages, seconds=8).collect()
    assert {(r["page"], r["error"]) for r in rows if r["error"]} == {("Slow", "PageTimeout"), ("Bad", "IndexError")}
    assert sum(r["page"] == "Good" for r in rows) == sum(r["page"] == "Long" for r in rows) == 9
    assert {r["page"] for r in W.useful_pages(spark.createDataFrame([r for r in rows if r["page"] == "Good"], rows[0].asDict() and W.parsed_pages(pages).schema)).collect()} == {"Good"}


def test_templates_are_put_in_by_joins(spark):
    templates = {"a": "<noinclude>doc</noinclude>[{{B|x={{{1|none}}}}}]", "b": "({{{x}}})", "old": "#REDIRECT [[Template:A]]", "self": "s{{Self}}"}
    texts = {"one": "{{a|1}} and {{A}}", "two": "{{Old|2}}{{missing}}{{self}}", "three": "plain", "four": None, "five": "{{a|{{b|x=in}}}} " + "{{b|x=1}}" * 60}
    want = {"one": "[(1)] and [(none)]", "two": "[(2)]s", "three": "plain", "four": None, "five": "[((in))] " + "(1)" * 60}
    got = W.expanded_pages(spark.createDataFrame(list(texts.items()), "title string, text string"), spark.createDataFrame([("B" if k == "b" else k, v) for k, v in templates.items()], "name string, text string"))
    assert {r["title"]: r["text"] for r in got.collect()} == want


MARKUP = """Intro [[Rome|the city]].
== Works ==
* [[Alpha (film)|Alpha]] 1990<ref>x</ref>
* Beta and [[Gamma]]
** Gamma again
== Two ==
* one
* two
=== Table ===
{| class="wikitable"
! Name !! Year
|-
| [[Delta]] || 1999
|-
| [[Epsilon|Eps]] || {{small|2000}}
|-
| Alpha || 2001
|}
== See also ==
* [[A]]
* [[B]]
* [[C]]
"""


def test_page_parser():
    rows = W.parse_page("Alpha_list", MARKUP)
    assert [(r["listing"], r["kind"], r["item"], r["cell"], r["depth"]) for r in rows] == [(0, "enum", 0, 0, 1), (0, "enum", 1, 0, 1), (0, "enum", 2, 0, 2)] + [(1, "table", i, c, 1) for i in range(3) for c in range(2)]
    assert rows[0]["tokens"] == ["Alpha", "1990"] and rows[0]["mentions"] == [{"start": 0, "stop": 1, "target": "Alpha_(film)"}]
    assert rows[2]["mentions"] == [{"start": 0, "stop": 1, "target": "Gamma"}]  # by the page's own labels
    assert rows[3]["section"] == "Table" and rows[3]["top_section"] == "Two" and rows[7]["mentions"][0]["target"] == "Alpha_(film)"


def test_markup_helpers():
    assert W.link_target(":de:foo bar#x") == "Foo_bar" and W.first_link("a [[b|c]]") == "B" and W.first_link("a") is None
    assert W.plain("'''A''' {{x|{{y}}}} [[b|c]] <br> d&amp;e") == "A c d&e"
    t = {"cat": "<noinclude>doc</noinclude>[[Category:{{{1|none}}} {{{k|z}}}]]", "r": "#REDIRECT [[Template:Cat]]", "loop": "a{{loop}}b"}
    assert W.expand_templates("{{cat|X|k=Y}} {{r}} {{loop}}{{gone}}", t) == "[[Category:X Y]] [[Category:none z]] ab"


def test_triple_lines(spark):
    lines = ['<http://x/A%2Cb+c> <http://p/1> <http://x/B> .', '<a> <p> "lit \\"q\\""@en .', '<a> <p> "3"^^<int> .', '<a> <p> "x"@de .', '<a> <p> "" .', "broken", '<a> <p> "plain" .']
    got = {tuple(r) for r in readers.parse_triples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("http://x/A,b+c", "http://p/1", "http://x/B", False), ("a", "p", 'lit \\"q\\"', True), ("a", "p", "3", True), ("a", "p", "plain", True)}


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("http://x/a b(c)é/d%", 'say "hi"\\ \n x')], "r string, l string")
    got = rows.select(sinks.encode_resource("r"), sinks.encode_literal(F.col("l"))).first()
    assert got[0] == "http://x/a b(c)é/d%25" and got[1] == 'say \\"hi\\"\\\\ x'
    triples = spark.createDataFrame([("http://x/A", "http://p", "http://x/B")], "s string, p string, o string")
    sinks.write_lines(triples.select(sinks.object_line(F.col("s"), F.col("p"), F.col("o"))), str(tmp_path / "out.nt.bz2"))
    assert [tuple(r) for r in readers.read_triples(spark, str(tmp_path / "out.nt.bz2")).collect()] == [("http://x/A", "http://p", "http://x/B", False)]


def test_xml_and_caches(spark, tmp_path):
    (tmp_path / "dump.xml").write_text("<mediawiki><page><title>A</title><ns>0</ns><revision><text>one</text></revision></page><page><title>U</title><ns>2</ns><revision><text>no</text></revision></page><page><title>Category:C</title><ns>14</ns><revision><text>[[Category:D e]]</text></revision></page></mediawiki>")
    pages = readers.read_pages(spark, str(tmp_path / "dump.xml"))
    assert {tuple(r) for r in pages.collect()} == {("A", 0, "one"), ("Category:C", 14, "[[Category:D e]]")}
    assert [tuple(r) for r in W.category_parents(readers.split_pages(pages)["categories"]).collect()] == [("Category:C", "Category:D_e")]
    calls = []
    make = lambda: calls.append(1) or spark.range(3).toDF("n")
    for _ in range(2):
        assert readers.read_or_create(spark, str(tmp_path / "cache"), "t", 1, make).count() == 3
    assert len(calls) == 1


def test_gold_readers(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"content": "Ann is", "annotation": [{"label": ["P"], "points": [{"start": 0, "end": 2}]}]}\n')
    assert tuple(readers.read_span_gold(spark, str(tmp_path / "g.jsonl")).first()) == ("Ann is", "P", 0, 3)
    (tmp_path / "m.tsv").write_text("tag\tpage\tx\ty\tz\tlisting\nP\t5\t\t\t\t2\n\t6\t\t\t\t1\n")
    assert [tuple(r) for r in readers.read_mention_gold(spark, str(tmp_path / "m.tsv")).collect()] == [("P", 5, 2)]
    (tmp_path / "v.txt").write_text("a 1 2.5\n")
    assert readers.read_vectors(spark, str(tmp_path / "v.txt")).first()["vector"] == [1.0, 2.5]
    (tmp_path / "n.jsonl").write_text('{"id": "1", "mention": "m", "context": "c", "offset": 0, "length": 1, "wikipedia_page_id": 9, "wikidata_id": "Q1", "nil": true}\n{"id": "2", "mention": "m", "context": "c", "offset": 0, "length": 1, "wikipedia_page_id": 9, "wikidata_id": "Q2", "nil": false}\n')
    pages, ents = spark.createDataFrame([(9, 70)], "page_id long, idx long"), spark.createDataFrame([("Q2", 5)], "wikidata_id string, idx long")
    assert {(r["id"], r["page_idx"], r["entity_idx"]) for r in readers.read_mention_examples(spark, str(tmp_path / "n.jsonl"), pages, ents).collect()} == {("1", 70, 50_000_000), ("2", 70, 5)}


def test_stream_appends(spark, tmp_path):
    from sheaf.streaming.ingest import append_triples, stream_triples

    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.nt").write_text(f"<a{n}> <p{n}> <b> .\n")
        append_triples(stream_triples(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_graphs(spark):
    e = lambda *p: spark.createDataFrame(list(p), "parent string, child string")
    chain = e(("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("x", "x"))
    assert {tuple(r) for r in hierarchy.closure(chain).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "c", 1), ("a", "d", 2), ("b", "d", 2), ("x", "x", 1)}
    assert {tuple(r) for r in hierarchy.transitive_reduction(chain.where("parent <> 'x'")).collect()} == {("a", "b"), ("b", "c"), ("c", "d")}
    cyclic = e(("r", "a"), ("a", "b"), ("b", "a"), ("a", "c"))
    assert {tuple(r) for r in hierarchy.break_cycles(cyclic, "r").collect()} == {("r", "a"), ("a", "b"), ("a", "c")}
    with pytest.raises(ValueError):
        hierarchy.levels(cyclic, 4)
    pairs = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1)], "src int, dst int")
    assert {tuple(r) for r in connected_components(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (5, 5)}
    long = spark.range(60).selectExpr("id AS src", "id + 1 AS dst")
    assert connected_components(long).where("component = 0").count() == 61 and connected_components(pairs.where("false")).count() == 0


def test_listing_formulas(spark):
    rows = [("k", 1, i) for i in range(3)] + [("k", 2, i) for i in range(3, 7)] + [("k", 3, 7), ("k", 3, 8)]  # page 3 is too short
    types = spark.createDataFrame([(i, "T") for i in (0, 1, 2, 3, 4)] + [(7, "T")], "E int, type string")
    rule = listing_rules.type_rules(spark.createDataFrame(rows, "K string, P int, E int"), types, ["K"]).first()
    assert rule["page_count"] == 2 and abs(rule["micro_mean"] - 5 / 7) < 1e-9 and abs(rule["macro_mean"] - 0.75) < 1e-9 and abs(rule["micro_std"] - ((2 / 7) + (3 / 14)) / 2) < 1e-9


def test_medians_pad_with_zero(spark):
    c = spark.createDataFrame([("s", "a", "t", 0.4), ("s", "b", "t", 0.2), ("s", "c", "u", 0.9), ("z", "a", "t", 0.5)], "set_id string, child string, target string, value double")
    n = spark.createDataFrame([("s", 3), ("z", 2)], "set_id string, n int")
    assert {tuple(r) for r in axioms.pattern_medians(c, n).collect()} == {("s", "t", 0.2), ("z", "t", 0.25)}


def test_category_sets(spark):
    rows = [("p", str(i), f"Films by {x}") for i, x in enumerate(["Ann", "Bob", "Cy"])] + [("p", "9", "Cars of Rome")]
    got = {(r["child"], tuple(r["front"]), tuple(r["back"])) for r in axioms.category_sets(spark.createDataFrame(rows, "parent string, child string, label string")).collect()}
    assert got == {(str(i), ("Films", "by"), ()) for i in range(3)}


def test_clusterers(spark):
    p = lambda *rows: spark.createDataFrame(list(rows) or [(0, 0, 0.0)], "src long, dst long, score double")
    mm, me = p((1, 2, 0.9), (2, 3, 0.85), (4, 5, 0.9), (6, 7, 0.5)), p((1, 100, 0.99), (3, 200, 0.99), (4, 100, 0.96))
    ids = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    nasty = {r["mention"]: r["entity"] for r in clustering.nasty(mm, me, ids).collect()}
    assert nasty == {1: 100, 2: 100, 3: 200, 4: 100, 5: 100, 6: None, 7: None}
    up = {r["mention"]: r["entity"] for r in clustering.bottom_up(mm, me, ids).collect()}
    assert up == {1: 100, 2: 100, 3: 200, 4: 100, 5: 100, 6: None, 7: None}
    most = {r["mention"]: r["entity"] for r in clustering.majority(mm, me, ids, share=0.5).collect()}
    assert most == {1: None, 2: None, 3: None, 4: 100, 5: 100, 6: None, 7: None}


def test_scores_of_equal_and_opposite_clusterings(spark):
    lab = lambda rows: spark.createDataFrame(rows, "id long, pred long, gold long")
    same = metrics.clustering_scores(lab([(i, i // 3, i // 3 + 10) for i in range(12)])).first()
    assert all(abs(same[c] - 1) < 1e-9 for c in ("ari", "nmi", "b3_f1", "muc_f1"))
    single = metrics.clustering_scores(lab([(i, i, 0) for i in range(6)])).first()
    assert single["b3_precision"] == 1 and abs(single["b3_recall"] - 1 / 6) < 1e-9 and single["muc_recall"] == 0 and abs(single["ari"]) < 1e-9
    assert abs(metrics.ceaf(lab([(i, i // 3, i // 3) for i in range(9)])).first()["ceaf_f1"] - 1) < 1e-9


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    from itertools import permutations

    for n, m in ((3, 3), (2, 4), (4, 3)):
        for _ in range(20):
            cost = rng.integers(-9, 9, (n, m)).astype(float)
            got = metrics.hungarian(cost)
            small, big = min(n, m), max(n, m)
            want = min(sum(cost[i, j] if n <= m else cost[j, i] for i, j in enumerate(p)) for p in permutations(range(big), small))
            assert len(got) == small and abs(sum(cost[i, j] for i, j in got) - want) < 1e-9


def test_spans(spark):
    cases = [([1, 1, 0], [1, 1, 0]), ([2, 2, 0], [1, 1, 0]), ([1, 0, 0], [1, 1, 0]), ([2, 0, 0], [1, 1, 0]), ([0, 0, 1], [1, 0, 0]), ([0, 0, 0], [0, 0, 1])]
    got = {r["scheme"]: (r["correct"], r["incorrect"], r["partial"], r["missed"], r["spurious"]) for r in metrics.span_scores(spark.createDataFrame(cases, "pred array<int>, gold array<int>")).collect()}
    assert got == {"strict": (1, 3, 0, 2, 1), "exact": (2, 2, 0, 2, 1), "partial": (2, 0, 2, 2, 1), "type": (2, 2, 0, 2, 1)}


def test_lsh_recall(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 400)] + 0.15 * rng.normal(size=(400, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<float>")
    exact = {(r["src"], r["dst"]) for r in linkage.nearest(v, v, 4, block=64).collect()}
    sims = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(sims, -9)
    want = {(i, int(j)) for i in range(400) for j in np.argsort(-sims[i], kind="stable")[:4]}
    assert len(exact & want) >= 0.99 * len(want)
    near = {(r["src"], r["dst"]) for r in linkage.nearest_lsh(v, 4).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_chunks_and_tags(spark):
    items = spark.createDataFrame([("p", 0, i, ["W"] * 10) for i in range(34)] + [("q", 0, i, ["x"]) for i in range(2)], "page string, listing int, item int, tokens array<string>")
    context = spark.createDataFrame([("p", 0, ["c"] * 80)], "page string, listing int, context array<string>")
    got = mentions.chunks(items, context).groupBy("page", "chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [("p", 0, 15), ("p", 1, 15), ("p", 2, 4)]
    rows = spark.createDataFrame([("p", 0, 0, ["a", "Big", "City", "x", "Y"]), ("p", 0, 1, ["none"]), ("p", 0, 2, [])], "page string, listing int, item int, tokens array<string>")
    assert [tuple(r) for r in mentions.decode(mentions.tag(rows)).collect()] == [("p", 0, 0, 1, 3, 1, "Big City")]


def test_coherent_types(spark):
    m = spark.createDataFrame([("n", "A", 0.9), ("n", "B", 0.5), ("n", "C", 0.4), ("m", "A", 0.5), ("m", "B", 0.5)], "node string, type string, score double")
    d = spark.createDataFrame([("A", "B"), ("B", "A")], "a string, b string")
    assert {tuple(r)[:2] for r in ontology.coherent_types(m, d).collect()} == {("n", "A"), ("n", "C")}


def test_sunburst_buckets():
    tree = sinks.sunburst({"T": 1000, "A": 900, "B": 4, "C": 50, "X": 10}, {"T": ["A", "B", "C"], "A": ["X"]}, "T")
    assert [c["name"] for c in tree["children"]] == ["A", "C", "-other-", "..."] and tree["children"][0]["children"][0] == {"name": "-other-", "value": 10}
