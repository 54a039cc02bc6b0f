"""Plan checks: no Python UDF in the hot path, filters reach the scan,
no single-partition window over fact rows."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["topic_viral_ranking", "viral_coefficient", "relatability_score",
                                  "ab_battery", "trend_velocity", "tfidf"])
def test_no_python_eval(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_date_filter_pushed_down(spark):
    p = plan(E.queries()["facet_filter"](spark, SF_SMALL))
    assert "PushedFilters" in p and "l_shipdate" in p.split("PushedFilters")[1][:400]


def test_percentile_has_no_global_window_over_rows(spark):
    df = E.queries()["viral_coefficient"](spark, SF_SMALL)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    # the only unpartitioned windows run over bucket totals, never over posts
    for line in p.splitlines():
        if "Window" in line and "partitionBy" not in line and "vc_raw" in line and "sum(cnt" not in line:
            assert "rank" not in line.lower()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_no_nested_loop_join_or_python(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p, f"{name}: {bad}"
