"""Invariants of the cleaned, rolled-up and reported tables, and equivalence
of the rewrites (KPI fusion, share of total by window, one-aggregate
completeness) with the literal UNION ALL / scalar-subquery form run as Spark
SQL over the registered views."""

import pytest
from pyspark.sql import functions as F

from loanlens import LendingData
from loanlens.plans import quality, reports

from .conftest import SF01


@pytest.fixture(scope="module")
def ctx(spark):
    c = LendingData.from_fixtures(spark, SF01)
    c.register_views("t_")
    return c


def _set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_table_row_counts(ctx):
    n_app = ctx.application.count()
    assert n_app == 14789
    assert ctx.wide.count() == n_app
    assert ctx.slim.count() == ctx.application.filter("AMT_INCOME_TOTAL IS NOT NULL AND AMT_CREDIT IS NOT NULL").count()


def test_rollup_keys_unique(ctx):
    for feat in [ctx.bureau_features, ctx.previous_features, ctx.payment_features]:
        assert feat.count() == feat.select("SK_ID_CURR").distinct().count()


def test_shares_sum_to_100_when_filter_equals_denominator(ctx):
    for fn, col in [(reports.gender_mix, "PERCENTAGE"), (reports.payment_status, "PERCENTAGE"),
                    (reports.payment_timeliness, "PERCENTAGE"), (reports.risk_score, "PERCENTAGE_OF_PORTFOLIO")]:
        total = fn(ctx).agg(F.sum(col)).first()[0]
        assert abs(total - 100.0) <= 0.05, fn.__name__


def test_band_counts_sum_to_filtered_total(ctx):
    app = ctx.application
    assert reports.age_distribution(ctx).agg(F.sum("CUSTOMER_COUNT")).first()[0] == \
        app.filter("DAYS_BIRTH IS NOT NULL").count()
    assert reports.loan_size_distribution(ctx).agg(F.sum("APPLICATION_COUNT")).first()[0] == \
        app.filter("AMT_CREDIT > 0").count()
    assert reports.approval_by_size(ctx).agg(F.sum("APPLICATION_COUNT")).first()[0] == \
        ctx.previous.filter("AMT_APPLICATION IS NOT NULL AND NAME_CONTRACT_STATUS IS NOT NULL").count()


def test_score_range_and_parts(ctx):
    s = ctx.scored
    bad = s.filter((F.col("TOTAL_RISK_SCORE") < 0) | (F.col("TOTAL_RISK_SCORE") > 15) |
                   (F.col("TOTAL_RISK_SCORE") != F.col("AGE_RISK_SCORE") + F.col("INCOME_RISK_SCORE")
                    + F.col("CREDIT_RATIO_RISK_SCORE") + F.col("CREDIT_HISTORY_RISK_SCORE")
                    + F.col("PREV_APP_RISK_SCORE")))
    assert bad.count() == 0


def test_having_threshold_cuts_groups(ctx):
    full = reports.risk_matrix(ctx).count()
    cut = reports.risk_matrix(ctx, min_count=600)
    assert 0 < cut.count() < full
    assert cut.agg(F.min("CUSTOMER_COUNT")).first()[0] >= 600
    assert reports.education_employment(ctx, min_count=600).agg(F.min("CUSTOMER_COUNT")).first()[0] >= 600


def test_kpi_fusion_equals_separate_aggregates(spark):
    from loanlens.operators.aggregate import kpi_long

    df = spark.createDataFrame([(1, 2.0), (3, 6.0), (None, 4.0)], "a int, b double")
    fused = kpi_long(df.agg(F.avg("a").alias("x"), F.sum("b").alias("y")), [("A", F.col("x"), {"U": "%"}), ("B", F.col("y"), {"U": "EUR"})])
    apart = spark.createDataFrame([("A", 2.0, "%"), ("B", 12.0, "EUR")], "METRIC string, VALUE double, U string")
    assert _set(fused) == _set(apart)


def test_share_totals(spark):
    from loanlens.operators.aggregate import ALL_ROWS, share

    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4), ("y", None)], "k string, v int")
    for total in ("scalar", "window"):
        plain = {r.k: (r.COUNT, r.PERCENTAGE) for r in share(df, ["k"], total=total).collect()}
        assert plain == {"x": (2, 40.0), "y": (2, 40.0), None: (1, 20.0)}
        of_all = share(df, ["k"], where=F.col("v") > 1, total_where=ALL_ROWS, total=total)
        assert {r.k: (r.COUNT, r.PERCENTAGE) for r in of_all.collect()} == {"x": (1, 20.0), "y": (1, 20.0), None: (1, 20.0)}
        # a total that does not contain all counted rows
        other = share(df, ["k"], where=F.col("v") > 1, total_where=F.col("v") < 4, total=total)
        assert {r.k: (r.COUNT, r.PERCENTAGE) for r in other.collect()} == {"x": (1, 33.33), "y": (1, 33.33), None: (1, 33.33)}


def test_completeness_equals_per_column_counts(spark, ctx):
    got = {r.FEATURE: (r.NON_NULL_COUNT, r.TOTAL_ROWS) for r in quality.completeness(ctx).collect()}
    total = ctx.wide.count()
    for feature in quality.KEY_FEATURES:
        assert got[feature] == (ctx.wide.filter(F.col(feature).isNotNull()).count(), total)
    opt = quality.completeness(ctx)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in opt


def test_stage_counts_match_frames(ctx):
    got = {r.STAGE: r.ROW_COUNT for r in quality.stage_counts(ctx).collect()}
    assert got["application_train_clean"] == ctx.application.count()
    assert got["master_dataset"] == ctx.wide.count()
    assert got["prev_app_features"] == ctx.previous_features.count()


def test_sql_on_registered_views_matches_reports(spark, ctx):
    ctx.register_views("v_", master="wide")
    by_age = spark.sql("""SELECT AGE_GROUP, COUNT(*) AS CUSTOMER_COUNT, ROUND(AVG(TARGET) * 100, 2) AS DEFAULT_RATE
                          FROM v_master_risk_data GROUP BY AGE_GROUP""")
    assert _set(by_age) == _set(reports.demo_by_age(ctx))
    ctx.register_views("v_", master="slim")
    matrix = spark.sql("""SELECT AGE_GROUP, INCOME_CATEGORY, COUNT(*) AS CUSTOMER_COUNT,
                                 ROUND(AVG(TARGET) * 100, 2) AS DEFAULT_RATE, ROUND(AVG(AMT_CREDIT), 0) AS AVG_LOAN_SIZE,
                                 CAST(ROUND(AVG(CREDIT_INCOME_RATIO), 2) AS DOUBLE) AS AVG_CREDIT_RATIO
                          FROM v_master_risk_data GROUP BY AGE_GROUP, INCOME_CATEGORY HAVING COUNT(*) >= 100""")
    assert _set(matrix) == _set(reports.risk_matrix(ctx))
