"""Queries with SQL against DuckDB on the smallest tables; others run and give the same rows twice."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from sheaf.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def _rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(_plain, r)) for r in df.itertuples(index=False)), key=repr)


#: One or two of each module; ``SHEAF_ALL_QUERIES=1`` takes them all.
SOME = """listing_type_rules listing_new_types listing_relation_rules valid_tags triples_scan triples_single_val resource_universe surface_ref_freq functional_predicates popularity
class_closure transitive_reduction name_normalise bracket_removal label_tokens match_exact match_bm25 knn_topk contingency_table rerank_best_entity training_pairs evaluation_parts patterns_median
pattern_matches hypernym_vote page_items html_items tag_decode weak_labels conceptual_graph graph_merge node_type_scores merge_nodes nt_literals nt_typed type_distribution""".split()
SOME_PLAIN = "category_sets chunks cluster_majority hearst_pairs span_metrics nt_ontology".split()
ALL = bool(os.environ.get("SHEAF_ALL_QUERIES"))


@pytest.mark.parametrize("name", sorted(registry.ORACLES) if ALL else SOME)
def test_query_gives_what_sql_gives(spark, duck, name):
    assert _rows(registry.QUERIES[name](spark, SF).toPandas()) == _rows(duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)) if ALL else SOME_PLAIN)
def test_query_without_sql_gives_the_same_rows_twice(spark, name):
    once = registry.QUERIES[name](spark, SF)
    assert once.columns and _rows(once.toPandas()) == _rows(registry.QUERIES[name](spark, SF).toPandas())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
