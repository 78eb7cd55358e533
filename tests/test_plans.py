"""Plan-shape checks: no cartesian products, pushed filters and pruned reads,
one aggregate for fused KPIs, one scan per share report, no Python in the plans."""

import re

import pytest

import __spark_entry__ as E

from loanlens.registry import QUERIES

from .conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cartesian_or_python(spark, key):
    plan = _plan(E.queries()[key](spark, SF01))
    for bad in ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas", "MapInPandas"]:
        assert bad not in plan, (key, bad)


def test_cleaner_filters_reach_the_scan(spark):
    plan = _plan(E.queries()["clean_bureau_balance"](spark, SF01))
    assert re.search(r"PushedFilters: \[IsNotNull\(user_id\)\]", plan) or "IsNotNull(user_id)" in plan
    # only the three projected source columns are read
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_default_kpis_is_one_aggregate(spark):
    opt = _optimized(E.queries()["default_kpis"](spark, SF01))
    assert "Union" not in opt
    # one fused aggregate; Catalyst also drops the left joins to the (key-unique)
    # roll-ups, because no roll-up column is read
    assert opt.count("Aggregate [") == 1


def _executed(df):
    """The final plan of a query that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", ["loan_purpose", "top_occupations", "rejection_reasons"])
def test_share_report_reads_input_once(spark, key):
    # the total is a subquery over the grouped rows, and reads their exchange again
    df = E.queries()[key](spark, SF01)
    assert "Window [" not in _optimized(df)
    plan = _executed(df)
    assert plan.count("FileScan parquet") == len(set(re.findall(r"Location: InMemoryFileIndex\([^)]*\)\[([^\]]*)", plan))), plan


def test_median_reads_input_once(spark):
    df = E.queries()["salary_by_profession"](spark, SF01)
    plan = _executed(df)
    assert plan.count("FileScan parquet") == len(set(re.findall(r"Location: InMemoryFileIndex\([^)]*\)\[([^\]]*)", plan))), plan


def test_stage_counts_has_no_join_of_child_tables(spark):
    assert _optimized(E.queries()["stage_counts"](spark, SF01)).count("Relation [l_") == 3


def test_exec_summary_is_one_aggregate(spark):
    opt = _optimized(E.queries()["exec_summary"](spark, SF01))
    assert "Union" not in opt


@pytest.mark.parametrize("key", ["features_bureau", "features_previous", "features_payment", "risk_matrix"])
def test_aggregates_combine_map_side(spark, key):
    # a partial aggregate runs before the exchange: hot keys are pre-combined per task
    plan = _plan(E.queries()[key](spark, SF01))
    assert re.search(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_", plan), key


def test_hot_applicant_rollup_exact(spark):
    from pyspark.sql import functions as F

    from loanlens.plans import reports
    from tests.helpers import lending

    hot = [dict(SK_ID_CURR=1, SK_ID_BUREAU=i, CREDIT_ACTIVE="Active" if i % 2 else "Closed",
                AMT_CREDIT_SUM=float(i), AMT_CREDIT_SUM_DEBT=1.0) for i in range(3000)]
    cold = [dict(SK_ID_CURR=2 + i, SK_ID_BUREAU=10000 + i) for i in range(6000)]
    ctx = lending(spark, app=[dict(SK_ID_CURR=k) for k in range(1, 6002)], bureau=hot + cold)
    f = {r.SK_ID_CURR: r for r in ctx.bureau_features.filter(F.col("SK_ID_CURR") <= 2).collect()}
    assert (f[1].BUREAU_CREDIT_COUNT, f[1].ACTIVE_CREDIT_COUNT, f[1].TOTAL_DEBT) == (3000, 1500, 3000.0)
    assert f[1].AVG_CREDIT_AMOUNT == sum(range(3000)) / 3000
    hist = {r.CREDIT_HISTORY_LEVEL: r.CUSTOMER_COUNT for r in reports.history_impact(ctx).collect()}
    assert hist == {"Very Extensive (10+)": 1, "Limited History (1-2)": 6000}


LIMIT_IS_THE_FEATURE = {"top_occupations", "rejection_reasons", "preview", "preview_bureau", "preview_bureau_balance",
                       "preview_previous", "preview_installments", "preview_first_rows"}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_row_limits_only_where_they_are_the_feature(spark, key):
    opt = _optimized(E.queries()[key](spark, SF01))
    has_limit = "GlobalLimit" in opt or "LocalLimit" in opt
    assert has_limit == (key in LIMIT_IS_THE_FEATURE), key
