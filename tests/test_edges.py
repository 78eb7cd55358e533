"""Edge rows (FIXTURES.md section 3) through the real cleaners, features and reports."""

from pyspark.sql import functions as F

from loanlens.functions import bands as B
from loanlens.plans import reports
from loanlens.plans.risk import FILL_ZERO

from .helpers import lending


def _col(df, name):
    return [r[name] for r in df.collect()]


def test_e1_e2_age_bands_under_18_and_null(spark):
    df = spark.createDataFrame([(16,), (None,)], "age bigint")
    out = df.select(
        B.AGE_DISTRIBUTION(F.col("age")).alias("b1"),
        B.AGE_GROUP_WIDE(F.col("age")).alias("b2"),
        B.AGE_GROUP_SLIM(F.col("age")).alias("b3"),
    ).collect()
    assert tuple(out[0]) == ("65+ (Senior Citizens)", "Young (18-25)", "Senior (60+)")
    assert tuple(out[1]) == ("65+ (Senior Citizens)", "Senior (65+)", "Senior (60+)")


def test_e1_age_from_days(spark):
    ctx = lending(spark, app=[dict(SK_ID_CURR=1, DAYS_BIRTH=-6000), dict(SK_ID_CURR=2, DAYS_BIRTH=None)])
    ages = {r.SK_ID_CURR: r.AGE_YEARS for r in ctx.application.collect()}
    assert ages == {1: 16, 2: None}
    # V1 drops the NULL birth day but counts it in the denominator
    v1 = reports.age_distribution(ctx).collect()
    assert [(r.AGE_GROUP, r.CUSTOMER_COUNT, r.PERCENTAGE) for r in v1] == [("65+ (Senior Citizens)", 1, 50.0)]


def test_e3_income_bounds(spark):
    incomes = [9999.99, 10000.0, 10000000.0, 10000000.01, None]
    ctx = lending(spark, app=[dict(SK_ID_CURR=i, AMT_INCOME_TOTAL=v) for i, v in enumerate(incomes)])
    kept = sorted(_col(ctx.application, "AMT_INCOME_TOTAL"))
    assert kept == [10000.0, 10000000.0]


def test_e4_bureau_credit_sum_bounds_keep_null(spark):
    sums = [None, 0.0, -1.0, 1e8, 1e8 + 1]
    ctx = lending(spark, bureau=[dict(SK_ID_BUREAU=i, AMT_CREDIT_SUM=v) for i, v in enumerate(sums)])
    kept = {r.SK_ID_BUREAU for r in ctx.bureau.collect()}
    assert kept == {0, 1, 3}


def test_e5_employment_years_sentinel(spark):
    days = [365243, -365, -366, None]
    ctx = lending(spark, app=[dict(SK_ID_CURR=i, DAYS_EMPLOYED=v) for i, v in enumerate(days)])
    got = {r.SK_ID_CURR: r.EMPLOYMENT_YEARS for r in ctx.application.collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0}


def test_e6_e7_utilization_ratio(spark):
    ctx = lending(spark, bureau=[
        dict(SK_ID_BUREAU=1, AMT_CREDIT_SUM=100.0, AMT_CREDIT_SUM_DEBT=None),
        dict(SK_ID_BUREAU=2, AMT_CREDIT_SUM=0.0, AMT_CREDIT_SUM_DEBT=5.0),
        dict(SK_ID_BUREAU=3, AMT_CREDIT_SUM=None, AMT_CREDIT_SUM_DEBT=5.0),
        dict(SK_ID_BUREAU=4, AMT_CREDIT_SUM=10.0, AMT_CREDIT_SUM_DEBT=-5.0),
    ])
    got = {r.SK_ID_BUREAU: r.CREDIT_UTILIZATION_RATIO for r in ctx.bureau.collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: -0.5}
    # V13 keeps only sum > 0 and debt >= 0: none of these rows
    assert reports.credit_utilization(ctx).count() == 0


def test_e8_customer_without_child_rows(spark):
    ctx = lending(spark, app=[dict(SK_ID_CURR=7)], bureau=[dict(SK_ID_CURR=1)], previous=[dict(SK_ID_CURR=1)],
                  installments=[dict(SK_ID_CURR=1)])
    row = ctx.wide.collect()[0].asDict()
    assert all(row[c] == 0 for c in FILL_ZERO)
    for c in ["DAYS_LAST_CREDIT", "AVG_PREV_APPLICATION_AMOUNT", "DAYS_LAST_DECISION", "MAX_DAYS_LATE"]:
        assert row[c] is None
    assert row["CREDIT_HISTORY_LEVEL"] == "No Credit History"
    slim = ctx.slim.collect()[0]
    assert (slim.BUREAU_CREDITS, slim.ACTIVE_CREDITS, slim.TOTAL_DEBT, slim.PREV_APPLICATIONS,
            slim.HISTORICAL_APPROVAL_RATE) == (0, 0, 0.0, 0, 0.0)


def test_e9_only_credit_has_null_amounts(spark):
    ctx = lending(spark, app=[{}], bureau=[dict(SK_ID_CURR=1, AMT_CREDIT_SUM=None, AMT_CREDIT_SUM_DEBT=None)])
    row = ctx.wide.collect()[0]
    assert (row.BUREAU_CREDIT_COUNT, row.AVG_CREDIT_AMOUNT, row.TOTAL_DEBT) == (1, 0.0, 0.0)


def test_e10_unknown_entry_day(spark):
    ctx = lending(spark, installments=[dict(SK_ID_PREV=1, DAYS_ENTRY_PAYMENT=None),
                                       dict(SK_ID_PREV=2, DAYS_ENTRY_PAYMENT=-20, DAYS_INSTALMENT=-30)])
    late = {r.SK_ID_PREV: r.DAYS_LATE for r in ctx.installments.collect()}
    assert late == {1: None, 2: 10}
    f = ctx.payment_features.collect()[0]
    assert (f.TOTAL_PAYMENTS, f.LATE_PAYMENTS_COUNT, f.LATE_PAYMENT_RATE) == (2, 1, 50.0)


def test_e11_e12_status_string_order(spark):
    codes = ["C", "0", "1", "2", "X", "3", "4", "5", "Z", None]
    df = spark.createDataFrame([(c,) for c in codes], "s string")
    got = _col(df.select(B.PAYMENT_STATUS(F.col("s")).alias("d")), "d")
    assert got == ["Paid Off (Closed)", "On Time (0 Days)", "Late 1-30 Days", "Late 30+ Days", "Late 30+ Days",
                   "Late 30+ Days", "Late 30+ Days", "Late 30+ Days", "Late 30+ Days", "Other Status"]


def test_e13_children_null(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "c int")
    got = _col(df.select(B.CHILDREN(F.col("c")).alias("d")), "d")
    assert got == ["No Children", "1 Child", "2 Children", "3+ Children", "3+ Children"]


def test_e14_payment_timing_edges(spark):
    lateness = [-5, 0, 5, 15, 30, 31]
    ctx = lending(spark, installments=[dict(SK_ID_PREV=i, DAYS_INSTALMENT=-100, DAYS_ENTRY_PAYMENT=-100 + d)
                                       for i, d in enumerate(lateness)])
    got = [(r.PAYMENT_TIMING, r.PAYMENT_COUNT) for r in reports.payment_timeliness(ctx).collect()]
    assert got == [("Early (5+ days)", 1), ("On Time", 1), ("Slightly Late (1-5 days)", 1), ("Late (6-15 days)", 1),
                   ("Very Late (16-30 days)", 1), ("Severely Late (30+ days)", 1)]


def test_e15_payment_ratio_edges(spark):
    paid = [110.0, 105.0, 95.0, 90.0, 89.0]
    ctx = lending(spark, installments=[dict(SK_ID_PREV=i, AMT_INSTALMENT=100.0, AMT_PAYMENT=p)
                                       for i, p in enumerate(paid)])
    got = sorted((r.ACTUAL_PAYMENT, r.PAYMENT_CATEGORY) for r in reports.payment_variance_rows(ctx).collect())
    assert [c for _, c in got] == ["Significantly Underpaid (10%+)", "Slightly Underpaid (5-10%)", "Paid as Expected",
                                   "Slightly Overpaid (5-10%)", "Overpaid (10%+)"]


def test_e16_first_time_customer_score(spark):
    ctx = lending(spark, app=[dict(SK_ID_CURR=5)])
    row = ctx.scored.collect()[0]
    assert row.PREV_APP_RISK_SCORE == 1
    assert row.TOTAL_RISK_SCORE == sum(row[c] for c in ["AGE_RISK_SCORE", "INCOME_RISK_SCORE",
                                                         "CREDIT_RATIO_RISK_SCORE", "CREDIT_HISTORY_RISK_SCORE",
                                                         "PREV_APP_RISK_SCORE"])


def test_e17_empty_tables(spark):
    ctx = lending(spark)  # no rows anywhere
    assert reports.age_distribution(ctx).count() == 0
    assert reports.risk_score(ctx).count() == 0
    kpis = reports.default_kpis(ctx).collect()
    assert [r.METRIC for r in kpis] == ["OVERALL_DEFAULT_RATE", "AVG_LOAN_AMOUNT", "AVG_INCOME",
                                        "AVG_CREDIT_INCOME_RATIO"]
    assert all(r.VALUE is None and r.TOTAL_CUSTOMERS == 0 for r in kpis)
    summary = {r.METRIC: r.VALUE for r in reports.exec_summary(ctx).collect()}
    assert summary["New vs Existing Split"] is None


def test_e18_format_number_half_even(spark):
    df = spark.createDataFrame([(1234567.5,), (1234568.5,)], "x double")
    got = _col(df.select(F.format_number("x", 0).alias("s")), "s")
    assert got == ["1,234,568", "1,234,568"]


def test_e19_null_and_literal_not_specified_stay_apart(spark):
    ctx = lending(spark, previous=[
        dict(SK_ID_PREV=1, NAME_CONTRACT_STATUS="Refused", CODE_REJECT_REASON=None),
        dict(SK_ID_PREV=2, NAME_CONTRACT_STATUS="Refused", CODE_REJECT_REASON="Not Specified"),
        dict(SK_ID_PREV=3, NAME_CONTRACT_STATUS="Refused", CODE_REJECT_REASON="HC"),
        dict(SK_ID_PREV=4, NAME_CONTRACT_STATUS="Approved", CODE_REJECT_REASON="XAP"),
    ])
    got = sorted((r.REJECTION_REASON, r.REJECTION_COUNT, r.PERCENTAGE_OF_REJECTIONS)
                 for r in reports.rejection_reasons(ctx).collect())
    assert got == [("HC", 1, 33.33), ("Not Specified", 1, 33.33), ("Not Specified", 1, 33.33)]


def test_days_last_is_oldest_event(spark):
    ctx = lending(spark, bureau=[dict(SK_ID_BUREAU=1, DAYS_CREDIT=-10), dict(SK_ID_BUREAU=2, DAYS_CREDIT=-500)])
    assert ctx.bureau_features.collect()[0].DAYS_LAST_CREDIT == 500


def test_slim_ratio_is_rounded_wide_is_not(spark):
    ctx = lending(spark, app=[dict(AMT_INCOME_TOTAL=100000.0, AMT_CREDIT=299500.0)])
    assert ctx.wide.collect()[0].CREDIT_INCOME_RATIO == 2.995
    slim = ctx.slim.collect()[0]
    assert slim.CREDIT_INCOME_RATIO == 3.0
    assert ctx.scored.collect()[0].CREDIT_RATIO_RISK_SCORE == 3
