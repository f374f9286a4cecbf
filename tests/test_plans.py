"""Physical plans: pushed filters, pruned columns, and no nested loops where an equi-join will do."""

import pytest

from sparrel.plans import registry


@pytest.fixture(scope="module")
def plan(spark, sf_dir):
    return lambda name: registry.queries()[name](spark, sf_dir)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_filters_and_columns_reach_the_scan(plan):
    text = plan("scan_filter")
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_returnflag), GreaterThan(l_quantity,45.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in text
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan("flagship")


@pytest.mark.parametrize("name", ["range_join", "overlap_join", "lateral_top1", "full_join_using", "semi_exists", "anti_not_exists", "in_subquery", "merge_upsert", "fk_violations", "overlap_violations", "cdc_diff"])
def test_no_nested_loops(plan, name):
    text = plan(name)
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_top_rows_are_not_sorted_as_a_whole(plan):
    assert "TakeOrderedAndProject" in plan("top_k")
    assert "WindowGroupLimit" in plan("lateral_top1") and "WindowGroupLimit" in plan("distinct_on")


@pytest.mark.parametrize("name", ["win_groups", "win_exclude_group", "range_agg", "hypothetical_rank", "string_agg_ordered", "json_agg", "multirange_union", "range_operators", "math_exact", "text_semantics", "age"])
def test_no_python_where_expressions_do(plan, name):
    text = plan(name)
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
