"""Plan-shape checks: the properties the scale design relies on."""

import re

import pytest

import __spark_entry__ as entry


def plan(spark, name, sf):
    df = entry.queries()[name](spark, sf)
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_shuffles_only_limited_rows(spark, sf_small):
    p = plan(spark, "search_papers", sf_small)
    # two-level top-k: (dataset, task bucket) then dataset, each with a partial limit
    assert p.count("Exchange hashpartitioning(dataset") == 2
    assert p.count("WindowGroupLimit") >= 2 and "Partial" in p
    # the tokenizer runs once per row (not re-inlined into a pushed-down filter)
    assert p.count("split(coalesce(text") == 1


@pytest.mark.parametrize("name", ["term_counts", "tf_l1", "tf_cosine_search"])
def test_term_tables_are_map_only(spark, sf_small, name):
    # at most the round-robin spread of an under-partitioned scan; no keyed shuffle
    p = plan(spark, name, sf_small)
    assert "hashpartitioning" not in p and "rangepartitioning" not in p


def test_point_lookup_pushes_filters(spark, sf_small):
    p = plan(spark, "paper_lookup", sf_small)
    assert re.search(r"PushedFilters: \[.*EqualTo\(source,src3\)", p)
    assert "EqualTo(doc_id,3)" in p


def test_scan_reads_only_needed_columns(spark, sf_small):
    p = plan(spark, "topic_counts", sf_small)
    assert "ReadSchema: struct<lang:string>" in p


def test_only_fixed_list_is_broadcast_explicitly(spark, sf_small):
    assert "BroadcastExchange" in plan(spark, "stopword_antijoin", sf_small)


def test_query_vector_is_a_pushed_scalar_subquery(spark, sf_small):
    p = plan(spark, "semantic_search", sf_small)
    assert "Subquery" in p and "EqualTo(vec_id,0)" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["year_conf_grid", "feed_index", "share_pct", "semantic_topk"])
def test_no_cross_joins(spark, sf_small, name):
    p = plan(spark, name, sf_small)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
