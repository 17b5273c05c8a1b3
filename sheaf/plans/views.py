"""Knowledge-graph views over the driver's tables, as DataFrames and as SQL for the oracles.

Resources are named by a letter and a key: R1 region, N1 nation, C1 customer, S1 supplier, O1 order, P1 part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def _rows(df: DataFrame, sub: Column, pred: str, obj: Column, literal: bool) -> DataFrame:
    return df.select(sub.alias("sub"), F.lit(pred).alias("pred"), obj.cast("string").alias("obj"), F.lit(literal).alias("is_literal"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    supplied = t("lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = [
        _rows(t("nation"), _node("N", "n_nationkey"), "inRegion", _node("R", "n_regionkey"), False),
        _rows(t("customer"), _node("C", "c_custkey"), "inNation", _node("N", "c_nationkey"), False),
        _rows(t("supplier"), _node("S", "s_suppkey"), "inNation", _node("N", "s_nationkey"), False),
        _rows(t("orders"), _node("O", "o_orderkey"), "placedBy", _node("C", "o_custkey"), False),
        _rows(supplied, _node("P", "l_partkey"), "suppliedBy", _node("S", "l_suppkey"), False),
        _rows(t("nation"), _node("N", "n_nationkey"), "name", F.col("n_name"), True),
        _rows(t("region"), _node("R", "r_regionkey"), "name", F.col("r_name"), True),
        _rows(t("part"), _node("P", "p_partkey"), "name", F.col("p_name"), True),
        _rows(t("part"), _node("P", "p_partkey"), "brand", F.col("p_brand"), True),
        _rows(t("part"), _node("P", "p_partkey"), "size", F.col("p_size"), True),
        _rows(t("customer"), _node("C", "c_custkey"), "segment", F.col("c_mktsegment"), True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ent, type): direct types."""
    t = lambda name: table(spark, sf_dir, name)
    return (
        t("customer").select(_node("C", "c_custkey").alias("ent"), F.col("c_mktsegment").alias("type"))
        .unionByName(t("part").select(_node("P", "p_partkey").alias("ent"), F.concat("p_type", F.lit("/"), "p_brand").alias("type")))
        .unionByName(t("orders").select(_node("O", "o_orderkey").alias("ent"), F.col("o_orderpriority").alias("type")))
        .unionByName(t("supplier").select(_node("S", "s_suppkey").alias("ent"), F.lit("Supplier").alias("type")))
        .unionByName(t("nation").select(_node("N", "n_nationkey").alias("ent"), F.lit("Nation").alias("type")))
        .unionByName(t("region").select(_node("R", "r_regionkey").alias("ent"), F.lit("Region").alias("type")))
    )


def subclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child): the class hierarchy, rooted at Thing."""
    t = lambda name: table(spark, sf_dir, name)
    fixed = spark.createDataFrame(
        [("Thing", c) for c in ("Agent", "Place", "Product", "Event")] + [("Agent", "Customer"), ("Agent", "Supplier"), ("Place", "Region"), ("Place", "Nation"), ("Event", "Order")],
        "parent string, child string",
    )
    part = t("part")
    return (
        fixed.unionByName(t("customer").select(F.lit("Customer").alias("parent"), F.col("c_mktsegment").alias("child")).distinct())
        .unionByName(t("orders").select(F.lit("Order").alias("parent"), F.col("o_orderpriority").alias("child")).distinct())
        .unionByName(part.select(F.lit("Product").alias("parent"), F.col("p_type").alias("child")).distinct())
        .unionByName(part.select(F.col("p_type").alias("parent"), F.concat("p_type", F.lit("/"), "p_brand").alias("child")).distinct())
    )


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(P, L, TS, S, E, tag, P_type): listing items; pages are suppliers, entities parts."""
    t = lambda name: table(spark, sf_dir, name)
    return (
        t("lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey")
        .join(t("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("l_suppkey").alias("P"), F.col("l_linenumber").alias("L"), F.col("l_returnflag").alias("TS"), F.col("l_linestatus").alias("S"),
            F.col("l_partkey").alias("E"), F.floor(F.col("p_size") / 10).cast("int").alias("tag"), F.col("n_regionkey").alias("P_type"),
        )
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`context` with section entities, of which the first is the part numbered as the page's nation and the second the part numbered as the item's size, where the line has a
    discount; their types; and list pages, those of suppliers in debt (P_type -1)."""
    t = lambda name: table(spark, sf_dir, name)
    part = t("part").select(F.col("p_partkey").alias("k"), "p_type")
    rows = (
        t("lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_discount")
        .join(t("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("l_suppkey").alias("P"), F.col("l_linenumber").alias("L"), F.col("l_returnflag").alias("TS"), F.col("l_linestatus").alias("S"), F.col("l_partkey").alias("E"), F.floor(F.col("p_size") / 10).cast("int").alias("tag"),
            F.when(F.col("s_acctbal") < 0, -1).otherwise(F.col("n_regionkey")).alias("P_type"), (F.col("n_nationkey") + 1).cast("bigint").alias("TS_ent"), F.when(F.col("l_discount") > 0, F.col("p_size")).cast("bigint").alias("S_ent"),
        )
    )
    return rows.join(part.select(F.col("k").alias("TS_ent"), F.col("p_type").alias("TS_enttype")), "TS_ent", "left").join(part.select(F.col("k").alias("S_ent"), F.col("p_type").alias("S_enttype")), "S_ent", "left")


def part_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`relations` and: the part numbered as a supplier's nation 'marks' the parts of its finished lines; parts are 'sizedAs' the part numbered as their size."""
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem").where("l_linestatus = 'F'").select("l_suppkey", "l_partkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    marks = line.select((F.col("s_nationkey") + 1).cast("bigint").alias("sub"), F.lit("marks").alias("pred"), F.col("l_partkey").alias("obj")).distinct()
    sized = t("part").select(F.col("p_partkey").alias("sub"), F.lit("sizedAs").alias("pred"), F.col("p_size").cast("bigint").alias("obj"))
    return relations(spark, sf_dir).unionByName(marks).unionByName(sized)


def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(E, type): transitive types of parts, without the root."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("E"), F.explode(F.array(F.lit("Product"), F.col("p_type"), F.concat("p_type", F.lit("/"), "p_brand"))).alias("type")
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sub, pred, obj): suppliers 'supply' parts of finished lines, and parts are 'stockedBy' suppliers of accepted ones; those of other lines aren't known yet."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linestatus", "l_returnflag")
    supplies = line.where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("sub"), F.lit("supplies").alias("pred"), F.col("l_partkey").alias("obj")).distinct()
    stocked = line.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("sub"), F.lit("stockedBy").alias("pred"), F.col("l_suppkey").alias("obj")).distinct()
    return supplies.unionByName(stocked)


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cat, ent): a part is in the category of its name's last word, of its name, and of its brand."""
    part = table(spark, sf_dir, "part")
    names = F.array(F.element_at(F.split("p_name", " "), -1), F.col("p_name"), F.col("p_brand"))
    return part.select(F.explode(names).alias("cat"), _node("P", "p_partkey").alias("ent")).distinct()


SQL = {
    "kg_triples": """
SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS sub, 'inRegion' AS pred, 'R' || CAST(n_regionkey AS VARCHAR) AS obj, false AS is_literal FROM nation
UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), 'inNation', 'N' || CAST(c_nationkey AS VARCHAR), false FROM customer
UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'inNation', 'N' || CAST(s_nationkey AS VARCHAR), false FROM supplier
UNION ALL SELECT 'O' || CAST(o_orderkey AS VARCHAR), 'placedBy', 'C' || CAST(o_custkey AS VARCHAR), false FROM orders
UNION ALL SELECT * FROM (SELECT DISTINCT 'P' || CAST(l_partkey AS VARCHAR), 'suppliedBy', 'S' || CAST(l_suppkey AS VARCHAR), false FROM lineitem)
UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'name', n_name, true FROM nation
UNION ALL SELECT 'R' || CAST(r_regionkey AS VARCHAR), 'name', r_name, true FROM region
UNION ALL SELECT 'P' || CAST(p_partkey AS VARCHAR), 'name', p_name, true FROM part
UNION ALL SELECT 'P' || CAST(p_partkey AS VARCHAR), 'brand', p_brand, true FROM part
UNION ALL SELECT 'P' || CAST(p_partkey AS VARCHAR), 'size', CAST(p_size AS VARCHAR), true FROM part
UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), 'segment', c_mktsegment, true FROM customer""",
    "kg_types": """
SELECT 'C' || CAST(c_custkey AS VARCHAR) AS ent, c_mktsegment AS type FROM customer
UNION ALL SELECT 'P' || CAST(p_partkey AS VARCHAR), p_type || '/' || p_brand FROM part
UNION ALL SELECT 'O' || CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders
UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'Supplier' FROM supplier
UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'Nation' FROM nation
UNION ALL SELECT 'R' || CAST(r_regionkey AS VARCHAR), 'Region' FROM region""",
    "kg_subclass": """
SELECT * FROM (VALUES ('Thing', 'Agent'), ('Thing', 'Place'), ('Thing', 'Product'), ('Thing', 'Event'), ('Agent', 'Customer'), ('Agent', 'Supplier'),
  ('Place', 'Region'), ('Place', 'Nation'), ('Event', 'Order')) AS v(parent, child)
UNION ALL SELECT DISTINCT 'Customer', c_mktsegment FROM customer
UNION ALL SELECT DISTINCT 'Order', o_orderpriority FROM orders
UNION ALL SELECT DISTINCT 'Product', p_type FROM part
UNION ALL SELECT DISTINCT p_type, p_type || '/' || p_brand FROM part""",
    "kg_closure": """
SELECT ancestor, descendant, min(depth) AS depth FROM (
  WITH RECURSIVE walk(ancestor, descendant, depth) AS (
    SELECT parent, child, 1 FROM kg_subclass UNION ALL SELECT w.ancestor, s.child, w.depth + 1 FROM walk w JOIN kg_subclass s ON s.parent = w.descendant)
  SELECT * FROM walk) GROUP BY ancestor, descendant""",
    "kg_transitive": """
SELECT DISTINCT ent, type FROM kg_types UNION SELECT t.ent, c.ancestor FROM kg_types t JOIN kg_closure c ON c.descendant = t.type WHERE c.ancestor <> 'Thing'""",
    "listing_context": """
SELECT l_suppkey AS P, l_linenumber AS L, l_returnflag AS TS, l_linestatus AS S, l_partkey AS E, CAST(floor(p_size / 10.0) AS INTEGER) AS tag, n_regionkey AS P_type
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "listing_sections": """
SELECT l_suppkey AS P, l_linenumber AS L, l_returnflag AS TS, l_linestatus AS S, l_partkey AS E, CAST(floor(p.p_size / 10.0) AS INTEGER) AS tag, CASE WHEN s_acctbal < 0 THEN -1 ELSE n_regionkey END AS P_type,
CAST(n_nationkey + 1 AS BIGINT) AS TS_ent, CASE WHEN l_discount > 0 THEN CAST(p.p_size AS BIGINT) END AS S_ent, t.p_type AS TS_enttype, CASE WHEN l_discount > 0 THEN u.p_type END AS S_enttype
FROM lineitem JOIN part p ON l_partkey = p.p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN part t ON t.p_partkey = n_nationkey + 1 LEFT JOIN part u ON u.p_partkey = p.p_size""",
    "part_relations": """
SELECT * FROM kg_relations UNION ALL SELECT DISTINCT CAST(s_nationkey + 1 AS BIGINT), 'marks', l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'F'
UNION ALL SELECT p_partkey, 'sizedAs', CAST(p_size AS BIGINT) FROM part""",
    "part_types": """
SELECT p_partkey AS E, 'Product' AS type FROM part UNION ALL SELECT p_partkey, p_type FROM part UNION ALL SELECT p_partkey, p_type || '/' || p_brand FROM part""",
    "kg_relations": """
SELECT DISTINCT l_suppkey AS sub, 'supplies' AS pred, l_partkey AS obj FROM lineitem WHERE l_linestatus = 'F'
UNION ALL SELECT DISTINCT l_partkey, 'stockedBy', l_suppkey FROM lineitem WHERE l_returnflag = 'A'""",
    "kg_categories": """
SELECT DISTINCT cat, ent FROM (
  SELECT split_part(p_name, ' ', -1) AS cat, 'P' || CAST(p_partkey AS VARCHAR) AS ent FROM part
  UNION ALL SELECT p_name, 'P' || CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT p_brand, 'P' || CAST(p_partkey AS VARCHAR) FROM part)""",
}
_NEEDS = {"kg_closure": ("kg_subclass",), "kg_transitive": ("kg_subclass", "kg_closure", "kg_types"), "part_relations": ("kg_relations",)}


def oracle(body: str, *views: str) -> str:
    """``body`` after a WITH clause of the named views and those they need; body may start with further CTEs (``, x AS (...) SELECT``)."""
    names: list[str] = []
    for v in views:
        for n in (*_NEEDS.get(v, ()), v):
            if n not in names:
                names.append(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body
