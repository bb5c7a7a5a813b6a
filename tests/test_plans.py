"""What the physical plans look like: filters and columns reach the scan, no product joins of tables, Python only where meant."""

import re

import pytest

from folioscope.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = catalogue.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "scope_filter")
    assert "PushedFilters: [" in p and "In(source" in p and "GreaterThanOrEqual(doc_id,10)" in p
    assert "text" not in re.search(r"ReadSchema: (\S+)", p)[1]
    p = plan(spark, "pricing_summary")
    assert "LessThanOrEqual(l_shipdate" in p and "l_orderkey" not in re.search(r"ReadSchema: (\S+)", p)[1]


@pytest.mark.parametrize("name", ["bm25_topk", "surface_stats", "cooccurrence_pairs", "adjacent_passages", "section_range_join", "relational_salted_join", "tumbling", "html_to_text"])
def test_stays_in_the_jvm(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


@pytest.mark.parametrize("name", ["surface_stats", "adjacent_passages", "cooccurrence_pairs", "section_range_join", "relational_local_supplier", "history_pairs", "relational_as_of"])
def test_no_product_of_tables(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "relational_topn_per_group")
    assert "TakeOrderedAndProject" in plan(spark, "session_list")
