"""Physical-plan properties that must hold at any scale."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL, core

FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
             "CartesianProduct", "BroadcastNestedLoopJoin"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", core(E.queries()))
def test_no_python_udf_no_cross_join(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    for node in FORBIDDEN:
        assert node not in p, (name, node)


def test_report_reads_only_needed_columns_and_aggregates_map_side(spark):
    df = E.queries()["a3_summary_stats"](spark, SF_SMALL)
    p = plan(df)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert set(c.split(":")[0] for c in schema.split(",")) == {"event_id", "user_id", "event_type", "value"}
    assert p.count("HashAggregate") >= 2  # partial + final
    assert "SortMergeJoin" not in p


def test_resume_does_not_shuffle_the_completed_side_whole(spark):
    p = plan(E.queries()["j1_resume_pending"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p and "LeftSemi" in p and "LeftAnti" in p


def test_factor_effect_filters_in_scan_stage(spark):
    p = plan(E.queries()["a12_scheme_effect"](spark, SF_SMALL))
    assert "LeftSemi" not in p and "Filter" in p


def test_last_write_wins_is_an_aggregate(spark):
    p = plan(E.queries()["n3_last_write_wins"](spark, SF_SMALL))
    assert "Window" not in p and "max_by" in p


def test_first_appearance_single_scan(spark):
    p = plan(E.queries()["f10_first_appearance"](spark, SF_SMALL))
    assert p.count("FileScan") == 1 and "Union" not in p
