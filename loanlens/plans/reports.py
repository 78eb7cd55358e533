"""The named portfolio reports, by chapter.  Each takes a ``LendingData`` and
returns a lazy DataFrame; nothing is collected.

Plan shape shared by the grouped reports: a pruned scan (or the derived table),
the band computed once as a column, a partial + final hash aggregate on the
band/category keys, and - for shares - a window sum over the handful of grouped
rows.  Only ``ORDER BY`` adds a (tiny) range exchange over the grouped rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions.bands import label_rank
from ..functions.columns import avg_where, count_where, not_null, rate, ratio_at_most, sum_where, thousands, \
    with_unit, years_from_days
from ..operators.aggregate import ALL_ROWS, kpi_long, share, share_within, top_k
from ..operators.filters import min_group
from ..operators.median import median, rank_within
from .context import LendingData

col = F.col


def _round_avg(c: str, digits: int = 0):
    return F.round(F.avg(col(c)), digits)


# ---------------------------------------------------------------------------
# Sample queries on the wide table
# ---------------------------------------------------------------------------

def demo_by_age(ctx: LendingData) -> DataFrame:
    """Customers and default rate by AGE_GROUP of the wide table."""
    return (ctx.wide.groupBy("AGE_GROUP")
            .agg(F.count(F.lit(1)).alias("CUSTOMER_COUNT"), rate("TARGET").alias("DEFAULT_RATE"))
            .orderBy(col("DEFAULT_RATE").desc()))


def risk_by_income(ctx: LendingData) -> DataFrame:
    """Customers, default rate and average loan by INCOME_LEVEL."""
    return (ctx.wide.groupBy("INCOME_LEVEL")
            .agg(F.count(F.lit(1)).alias("CUSTOMER_COUNT"), rate("TARGET").alias("DEFAULT_RATE"),
                 _round_avg("AMT_CREDIT").alias("AVG_LOAN_SIZE"))
            .orderBy(col("DEFAULT_RATE").desc()))


# ---------------------------------------------------------------------------
# Chapter 1 - who are the customers
# ---------------------------------------------------------------------------

def age_distribution(ctx: LendingData) -> DataFrame:
    """V1: customers per age band; share of *all* cleaned applications."""
    app = ctx.application
    age = years_from_days("DAYS_BIRTH")
    grouped = share(
        app.withColumn("__age", age), [B.AGE_DISTRIBUTION(col("__age")).alias("AGE_GROUP")],
        where=col("DAYS_BIRTH").isNotNull(), total_where=ALL_ROWS, count_name="CUSTOMER_COUNT",
        aggs=lambda only: [F.min(only(col("__age"))).alias("__min_age")],
    )
    return grouped.orderBy("__min_age").select("AGE_GROUP", "CUSTOMER_COUNT", "PERCENTAGE")


def gender_mix(ctx: LendingData) -> DataFrame:
    """V2: customers per gender code (M, F only)."""
    grouped = share(ctx.application, ["CODE_GENDER"], where=col("CODE_GENDER").isin("M", "F"),
                    count_name="CUSTOMER_COUNT")
    return (grouped.select(B.GENDER(col("CODE_GENDER")).alias("GENDER"), "CUSTOMER_COUNT", "PERCENTAGE")
            .orderBy(col("CUSTOMER_COUNT").desc()))


def income_distribution(ctx: LendingData) -> DataFrame:
    """V3: customers and average income per income bracket; share of rows with a known income."""
    inc = col("AMT_INCOME_TOTAL")
    grouped = share(
        ctx.application, [B.INCOME_LEVEL(inc).alias("INCOME_BRACKET")],
        where=inc.isNotNull() & (inc > 0), total_where=inc.isNotNull(), count_name="CUSTOMER_COUNT",
        aggs=lambda only: [F.round(F.avg(only(inc)), 0).alias("AVG_INCOME")],
    )
    return grouped.select("INCOME_BRACKET", "CUSTOMER_COUNT", "AVG_INCOME", "PERCENTAGE").orderBy("AVG_INCOME")


def education_employment(ctx: LendingData, min_count: int = 100) -> DataFrame:
    """V4: customers and average income per education x income type (groups >= min_count)."""
    grouped = (ctx.application.filter(not_null("NAME_EDUCATION_TYPE", "NAME_INCOME_TYPE", "AMT_INCOME_TOTAL"))
               .groupBy(col("NAME_EDUCATION_TYPE").alias("EDUCATION_LEVEL"),
                        col("NAME_INCOME_TYPE").alias("EMPLOYMENT_TYPE"))
               .agg(F.count(F.lit(1)).alias("CUSTOMER_COUNT"), _round_avg("AMT_INCOME_TOTAL").alias("AVG_INCOME")))
    return min_group(grouped, "CUSTOMER_COUNT", min_count).orderBy("EDUCATION_LEVEL", col("AVG_INCOME").desc())


def top_occupations(ctx: LendingData, k: int = 15) -> DataFrame:
    """V5: the k most frequent occupations (ties broken by name)."""
    grouped = share(
        ctx.application, [col("OCCUPATION_TYPE").alias("JOB_CATEGORY")],
        where=col("OCCUPATION_TYPE").isNotNull(), count_name="CUSTOMER_COUNT",
        aggs=lambda only: [F.round(F.avg(only(col("AMT_INCOME_TOTAL"))), 0).alias("AVG_INCOME")],
    )
    return top_k(grouped.select("JOB_CATEGORY", "CUSTOMER_COUNT", "PERCENTAGE", "AVG_INCOME"),
                 [col("CUSTOMER_COUNT").desc(), col("JOB_CATEGORY").asc()], k)


def _salaries(ctx: LendingData) -> DataFrame:
    inc = col("AMT_INCOME_TOTAL")
    return (ctx.application.filter(col("OCCUPATION_TYPE").isNotNull() & inc.isNotNull() & (inc > 0))
            .select(col("OCCUPATION_TYPE").alias("PROFESSION"), "AMT_INCOME_TOTAL"))


def salary_by_profession(ctx: LendingData, min_count: int = 100, approx: float | None = None) -> DataFrame:
    """V6: count, average, min, max and median income per occupation.

    One exact-median pass also yields the count, sum, min and max of each group
    (read off its first-level histogram), so the input is not aggregated twice.
    With ``approx`` the median comes from a quantile sketch of that rank error
    (a share of the group): one aggregate, for groups that need no exact middle."""
    med = median(_salaries(ctx), ["PROFESSION"], "AMT_INCOME_TOTAL", "__median",
                 stats={"EMPLOYEE_COUNT": "count", "__avg": "avg", "__min": "min", "__max": "max"}, approx=approx)
    return (min_group(med, "EMPLOYEE_COUNT", min_count)
            .select("PROFESSION", "EMPLOYEE_COUNT",
                    F.round(col("__avg"), 0).alias("AVERAGE_SALARY"),
                    F.round(col("__min"), 0).alias("MIN_SALARY"),
                    F.round(col("__max"), 0).alias("MAX_SALARY"),
                    F.round(col("__median"), 0).alias("MEDIAN_SALARY"))
            .orderBy(col("AVERAGE_SALARY").desc()))


def salary_approx_check(ctx: LendingData, min_count: int = 100, approx: float = 0.001) -> DataFrame:
    """V6 with sketched medians, held against the data: PROFESSION, EMPLOYEE_COUNT, MIN_SALARY, MAX_SALARY and
    WITHIN_RANK_ERROR, whether the unrounded sketched median stands as near the middle as ``approx`` promises."""
    rows = _salaries(ctx)
    med = median(rows, ["PROFESSION"], "AMT_INCOME_TOTAL", "__median",
                 stats={"EMPLOYEE_COUNT": "count", "__min": "min", "__max": "max"}, approx=approx)
    checked = rank_within(rows, ["PROFESSION"], "AMT_INCOME_TOTAL", med, "__median", approx)
    return (min_group(med, "EMPLOYEE_COUNT", min_count).join(checked, "PROFESSION")
            .select("PROFESSION", "EMPLOYEE_COUNT", F.round(col("__min"), 0).alias("MIN_SALARY"),
                    F.round(col("__max"), 0).alias("MAX_SALARY"), "WITHIN_RANK_ERROR"))


# ---------------------------------------------------------------------------
# Chapter 2 - what do customers want
# ---------------------------------------------------------------------------

def loan_size_distribution(ctx: LendingData) -> DataFrame:
    """V7: applications and average loan per loan-size band; share of rows with a known credit."""
    cred = col("AMT_CREDIT")
    grouped = share(
        ctx.application, [B.CREDIT_SIZE(cred).alias("LOAN_SIZE_CATEGORY")],
        where=cred.isNotNull() & (cred > 0), total_where=cred.isNotNull(), count_name="APPLICATION_COUNT",
        aggs=lambda only: [F.round(F.avg(only(cred)), 0).alias("AVG_LOAN_AMOUNT")],
    )
    return (grouped.select("LOAN_SIZE_CATEGORY", "APPLICATION_COUNT", "AVG_LOAN_AMOUNT", "PERCENTAGE")
            .orderBy("AVG_LOAN_AMOUNT"))


def loan_purpose(ctx: LendingData) -> DataFrame:
    """Applications and average loan per contract type; share of all applications."""
    grouped = share(
        ctx.application, [col("NAME_CONTRACT_TYPE").alias("LOAN_TYPE")],
        where=col("NAME_CONTRACT_TYPE").isNotNull(), total_where=ALL_ROWS, count_name="APPLICATION_COUNT",
        aggs=lambda only: [F.round(F.avg(only(col("AMT_CREDIT"))), 0).alias("AVG_LOAN_AMOUNT")],
    )
    return (grouped.select("LOAN_TYPE", "APPLICATION_COUNT", "AVG_LOAN_AMOUNT", "PERCENTAGE")
            .orderBy(col("APPLICATION_COUNT").desc()))


def credit_to_income_rows(ctx: LendingData) -> DataFrame:
    """Row level income, credit, rounded ratio and risk appetite (ratio <= 10)."""
    inc, cred = col("AMT_INCOME_TOTAL"), col("AMT_CREDIT")
    ratio = F.try_divide(cred, inc)
    return (ctx.application
            .filter(inc.isNotNull() & cred.isNotNull() & (inc > 0) & (cred > 0) & ratio_at_most(cred, inc, 10))
            .select(inc.alias("ANNUAL_INCOME"), cred.alias("CREDIT_REQUESTED"),
                    F.round(ratio, 2).alias("CREDIT_TO_INCOME_RATIO"),
                    B.CREDIT_RISK_LEVEL(ratio).alias("RISK_APPETITE")))


# ---------------------------------------------------------------------------
# Chapter 3 - how are decisions made
# ---------------------------------------------------------------------------

def application_outcomes(ctx: LendingData) -> DataFrame:
    """Earlier applications per contract status; share of all earlier applications."""
    grouped = share(
        ctx.previous, [col("NAME_CONTRACT_STATUS").alias("APPLICATION_STATUS")],
        where=col("NAME_CONTRACT_STATUS").isNotNull(), total_where=ALL_ROWS, count_name="APPLICATION_COUNT",
        aggs=lambda only: [F.round(F.avg(only(col("AMT_APPLICATION"))), 0).alias("AVG_REQUESTED_AMOUNT"),
                           F.round(F.avg(only(col("AMT_CREDIT"))), 0).alias("AVG_APPROVED_AMOUNT")],
    )
    return (grouped.select("APPLICATION_STATUS", "APPLICATION_COUNT", "PERCENTAGE", "AVG_REQUESTED_AMOUNT",
                           "AVG_APPROVED_AMOUNT")
            .orderBy(col("APPLICATION_COUNT").desc()))


def rejection_reasons(ctx: LendingData, k: int = 10) -> DataFrame:
    """The k most frequent reject reasons of refused applications.

    Grouped on the raw code, so a NULL code and a literal 'Not Specified' code
    stay two rows; ties are broken by label, then raw code."""
    grouped = share(
        ctx.previous, ["CODE_REJECT_REASON"], where=col("NAME_CONTRACT_STATUS") == "Refused",
        count_name="REJECTION_COUNT", pct_name="PERCENTAGE_OF_REJECTIONS",
        aggs=lambda only: [F.round(F.avg(only(col("AMT_APPLICATION"))), 0).alias("AVG_REQUESTED_AMOUNT")],
    )
    labelled = grouped.withColumn("REJECTION_REASON", F.coalesce(col("CODE_REJECT_REASON"), F.lit("Not Specified")))
    return top_k(labelled, [col("REJECTION_COUNT").desc(), col("REJECTION_REASON").asc(),
                            col("CODE_REJECT_REASON").asc_nulls_first()], k) \
        .select("REJECTION_REASON", "REJECTION_COUNT", "PERCENTAGE_OF_REJECTIONS", "AVG_REQUESTED_AMOUNT")


def approval_by_size(ctx: LendingData) -> DataFrame:
    """Earlier applications per size band x status; percent within the size band."""
    amt = col("AMT_APPLICATION")
    grouped = (ctx.previous.filter(amt.isNotNull() & col("NAME_CONTRACT_STATUS").isNotNull())
               .groupBy(B.APPLICATION_SIZE(amt).alias("APPLICATION_SIZE"),
                        col("NAME_CONTRACT_STATUS").alias("STATUS"))
               .agg(F.count(F.lit(1)).alias("APPLICATION_COUNT")))
    return share_within(grouped, ["APPLICATION_SIZE"], "APPLICATION_COUNT").orderBy("APPLICATION_SIZE", "STATUS")


# ---------------------------------------------------------------------------
# Chapter 4 - credit history
# ---------------------------------------------------------------------------

def credit_portfolio(ctx: LendingData) -> DataFrame:
    """Bureau credits per product type x status; share of all bureau credits."""
    grouped = share(
        ctx.bureau, [col("CREDIT_TYPE").alias("CREDIT_PRODUCT_TYPE"), col("CREDIT_ACTIVE").alias("STATUS")],
        where=col("CREDIT_TYPE").isNotNull() & col("CREDIT_ACTIVE").isNotNull(), total_where=ALL_ROWS,
        count_name="CREDIT_COUNT",
        aggs=lambda only: [F.round(F.avg(only(col("AMT_CREDIT_SUM"))), 0).alias("AVG_CREDIT_AMOUNT")],
    )
    return (grouped.select("CREDIT_PRODUCT_TYPE", "STATUS", "CREDIT_COUNT", "AVG_CREDIT_AMOUNT", "PERCENTAGE")
            .orderBy("CREDIT_PRODUCT_TYPE", col("CREDIT_COUNT").desc()))


def payment_status(ctx: LendingData) -> DataFrame:
    """Monthly bureau balance rows per STATUS with a description."""
    grouped = share(ctx.bureau_balance, [col("STATUS").alias("PAYMENT_STATUS")],
                    where=col("STATUS").isNotNull(), count_name="OCCURRENCE_COUNT")
    return (grouped.select("PAYMENT_STATUS", "OCCURRENCE_COUNT", "PERCENTAGE",
                           B.PAYMENT_STATUS(col("PAYMENT_STATUS")).alias("PAYMENT_DESCRIPTION"))
            .orderBy(col("OCCURRENCE_COUNT").desc()))


def credit_utilization(ctx: LendingData) -> DataFrame:
    """Bureau credits per utilization band (credit sum > 0, debt >= 0)."""
    debt, total = col("AMT_CREDIT_SUM_DEBT"), col("AMT_CREDIT_SUM")
    ratio = F.try_divide(debt, total)
    level = (F.when(debt.isNull() | total.isNull() | (total == 0), F.lit(B.UTILIZATION_NO_DATA))
             .otherwise(B.UTILIZATION(ratio)))
    return (ctx.bureau.filter((total > 0) & (debt >= 0))
            .groupBy(level.alias("UTILIZATION_LEVEL"))
            .agg(F.count(F.lit(1)).alias("CUSTOMER_COUNT"),
                 F.round(F.avg(ratio) * 100, 2).alias("AVG_UTILIZATION_PCT"))
            .orderBy("AVG_UTILIZATION_PCT"))


# ---------------------------------------------------------------------------
# Chapter 5 - how do customers pay
# ---------------------------------------------------------------------------

def payment_timeliness(ctx: LendingData) -> DataFrame:
    """Payments per timing band (entry day minus due day), in band order."""
    lateness = col("DAYS_ENTRY_PAYMENT") - col("DAYS_INSTALMENT")
    grouped = share(
        ctx.installments, [B.PAYMENT_TIMING(lateness).alias("PAYMENT_TIMING")],
        where=col("DAYS_ENTRY_PAYMENT").isNotNull() & col("DAYS_INSTALMENT").isNotNull(),
        count_name="PAYMENT_COUNT",
        aggs=lambda only: [F.round(F.avg(only(col("AMT_PAYMENT"))), 0).alias("AVG_PAYMENT_AMOUNT")],
    )
    return (grouped.select("PAYMENT_TIMING", "PAYMENT_COUNT", "PERCENTAGE", "AVG_PAYMENT_AMOUNT")
            .orderBy(label_rank(col("PAYMENT_TIMING"), B.PAYMENT_TIMING.labels[:-1])))


def payment_variance_rows(ctx: LendingData) -> DataFrame:
    """Row level expected vs actual payment, variance percent and category."""
    due, paid = col("AMT_INSTALMENT"), col("AMT_PAYMENT")
    return (ctx.installments
            .filter(due.isNotNull() & paid.isNotNull() & (due > 0) & (paid > 0) & (due <= 100000))
            .select(due.alias("EXPECTED_PAYMENT"), paid.alias("ACTUAL_PAYMENT"),
                    F.round(F.try_divide(paid - due, due) * 100, 2).alias("PAYMENT_VARIANCE_PCT"),
                    B.PAYMENT_CATEGORY(F.try_divide(paid, due)).alias("PAYMENT_CATEGORY")))


# ---------------------------------------------------------------------------
# Chapter 6 - who defaults (slim table)
# ---------------------------------------------------------------------------

def default_kpis(ctx: LendingData) -> DataFrame:
    """Four headline metrics in long form (METRIC, VALUE, UNIT, TOTAL_CUSTOMERS),
    computed by one aggregate over the slim table."""
    row = ctx.slim.agg(
        F.count(F.lit(1)).alias("n"),
        rate("TARGET").alias("rate"),
        _round_avg("AMT_CREDIT").alias("loan"),
        _round_avg("AMT_INCOME_TOTAL").alias("income"),
        _round_avg("CREDIT_INCOME_RATIO", 2).alias("ratio"),
    )
    total = {"UNIT": None, "TOTAL_CUSTOMERS": col("n")}
    return kpi_long(row, [
        ("OVERALL_DEFAULT_RATE", col("rate"), {**total, "UNIT": "%"}),
        ("AVG_LOAN_AMOUNT", col("loan"), {**total, "UNIT": "USD"}),
        ("AVG_INCOME", col("income"), {**total, "UNIT": "USD"}),
        ("AVG_CREDIT_INCOME_RATIO", col("ratio"), {**total, "UNIT": "X"}),
    ])


def risk_matrix(ctx: LendingData, min_count: int = 100) -> DataFrame:
    """Default rate per age group x income category (groups >= min_count)."""
    grouped = ctx.slim.groupBy("AGE_GROUP", "INCOME_CATEGORY").agg(
        F.count(F.lit(1)).alias("CUSTOMER_COUNT"),
        rate("TARGET").alias("DEFAULT_RATE"),
        _round_avg("AMT_CREDIT").alias("AVG_LOAN_SIZE"),
        _round_avg("CREDIT_INCOME_RATIO", 2).alias("AVG_CREDIT_RATIO"),
    )
    return min_group(grouped, "CUSTOMER_COUNT", min_count).orderBy(col("DEFAULT_RATE").desc())


def history_impact(ctx: LendingData) -> DataFrame:
    """Default rate per depth of bureau history."""
    return (ctx.slim.groupBy(B.CREDIT_HISTORY(col("BUREAU_CREDITS")).alias("CREDIT_HISTORY_LEVEL"))
            .agg(rate("TARGET").alias("DEFAULT_RATE"), F.count(F.lit(1)).alias("CUSTOMER_COUNT"),
                 _round_avg("AMT_CREDIT").alias("AVG_LOAN_AMOUNT"),
                 _round_avg("ACTIVE_CREDITS", 1).alias("AVG_ACTIVE_CREDITS"))
            .orderBy(col("DEFAULT_RATE").desc()))


def ratio_by_history(ctx: LendingData, min_count: int = 50) -> DataFrame:
    """Default rate by credit/income ratio (1 digit) split by history depth."""
    n_credits, target = col("BUREAU_CREDITS"), col("TARGET")
    grouped = (ctx.slim.filter(col("CREDIT_INCOME_RATIO").between(0.5, 5.0))
               .groupBy(F.round(col("CREDIT_INCOME_RATIO"), 1).alias("CREDIT_TO_INCOME_RATIO"))
               .agg(F.round(avg_where(n_credits == 0, target) * 100, 2).alias("NO_HISTORY_DEFAULT_RATE"),
                    F.round(avg_where(n_credits.between(1, 5), target) * 100, 2).alias("SOME_HISTORY_DEFAULT_RATE"),
                    F.round(avg_where(n_credits > 5, target) * 100, 2).alias("EXTENSIVE_HISTORY_DEFAULT_RATE"),
                    F.count(F.lit(1)).alias("TOTAL_CUSTOMERS")))
    return min_group(grouped, "TOTAL_CUSTOMERS", min_count).orderBy("CREDIT_TO_INCOME_RATIO")


def education_employment_risk(ctx: LendingData, min_count: int = 100) -> DataFrame:
    """Default rate, income and loan per education x income type (groups >= min_count)."""
    grouped = (ctx.slim.filter(not_null("NAME_EDUCATION_TYPE", "NAME_INCOME_TYPE"))
               .groupBy(col("NAME_EDUCATION_TYPE").alias("EDUCATION"), col("NAME_INCOME_TYPE").alias("EMPLOYMENT"))
               .agg(F.count(F.lit(1)).alias("CUSTOMER_COUNT"), rate("TARGET").alias("DEFAULT_RATE"),
                    _round_avg("AMT_INCOME_TOTAL").alias("AVG_INCOME"),
                    _round_avg("AMT_CREDIT").alias("AVG_LOAN_SIZE")))
    return min_group(grouped, "CUSTOMER_COUNT", min_count).orderBy(col("DEFAULT_RATE").desc())


def family_risk(ctx: LendingData, min_count: int = 50) -> DataFrame:
    """Default rate per family status x number of children (groups >= min_count)."""
    grouped = (ctx.slim.filter(col("NAME_FAMILY_STATUS").isNotNull())
               .groupBy(col("NAME_FAMILY_STATUS").alias("FAMILY_STATUS"),
                        B.CHILDREN(col("CNT_CHILDREN")).alias("CHILDREN_CATEGORY"))
               .agg(F.count(F.lit(1)).alias("CUSTOMER_COUNT"), rate("TARGET").alias("DEFAULT_RATE"),
                    _round_avg("AMT_INCOME_TOTAL").alias("AVG_INCOME"),
                    _round_avg("CREDIT_INCOME_RATIO", 2).alias("AVG_CREDIT_RATIO")))
    return min_group(grouped, "CUSTOMER_COUNT", min_count).orderBy("FAMILY_STATUS", col("DEFAULT_RATE").desc())


def prior_application_risk(ctx: LendingData, min_count: int = 100) -> DataFrame:
    """Default rate per number of earlier applications (groups >= min_count)."""
    grouped = (ctx.slim.groupBy(B.PRIOR_APPLICATIONS(col("PREV_APPLICATIONS")).alias("APPLICATION_HISTORY"))
               .agg(rate("TARGET").alias("DEFAULT_RATE"),
                    _round_avg("HISTORICAL_APPROVAL_RATE", 2).alias("AVG_HISTORICAL_APPROVAL_RATE"),
                    F.count(F.lit(1)).alias("CUSTOMER_COUNT"),
                    _round_avg("AMT_CREDIT").alias("AVG_CURRENT_LOAN"),
                    F.avg("PREV_APPLICATIONS").alias("__avg_prev")))
    return (min_group(grouped, "CUSTOMER_COUNT", min_count).orderBy("__avg_prev")
            .select("APPLICATION_HISTORY", "DEFAULT_RATE", "AVG_HISTORICAL_APPROVAL_RATE", "CUSTOMER_COUNT",
                    "AVG_CURRENT_LOAN"))


def risk_score(ctx: LendingData) -> DataFrame:
    """Customers, actual default rate, portfolio share and mean score per risk category."""
    grouped = share(
        ctx.scored, ["RISK_CATEGORY"], total_where=ALL_ROWS, count_name="CUSTOMER_COUNT",
        pct_name="PERCENTAGE_OF_PORTFOLIO",
        aggs=lambda only: [rate(only(col("TARGET"))).alias("ACTUAL_DEFAULT_RATE"),
                           F.round(F.avg(only(col("TOTAL_RISK_SCORE"))), 1).alias("AVG_RISK_SCORE")],
    )
    return (grouped.select("RISK_CATEGORY", "CUSTOMER_COUNT", "ACTUAL_DEFAULT_RATE", "PERCENTAGE_OF_PORTFOLIO",
                           "AVG_RISK_SCORE")
            .orderBy("AVG_RISK_SCORE"))


def risk_score_rows(ctx: LendingData) -> DataFrame:
    """V23 rows: the scored slim table (id, target, five scores, total, category)."""
    return ctx.scored


# ---------------------------------------------------------------------------
# Executive summary
# ---------------------------------------------------------------------------

def exec_summary(ctx: LendingData) -> DataFrame:
    """Four business metrics as text (METRIC, VALUE, DESCRIPTION) from one aggregate."""
    target, credits = col("TARGET"), col("BUREAU_CREDITS")
    m = ctx.slim.agg(
        F.sum("AMT_CREDIT").alias("total_credit"),
        sum_where(target == 1, col("AMT_CREDIT"), 0).alias("credit_at_risk"),
        F.avg(target).alias("default_rate"),
        count_where(credits == 0).alias("new_customers"),
        count_where(credits > 0).alias("existing_customers"),
    )
    new_share = F.round(F.try_divide(col("new_customers") * 100.0,
                                     col("new_customers") + col("existing_customers")), 1)
    rows = [
        ("Total Portfolio Value", thousands(col("total_credit"), 0), "Credit issued to all customers"),
        ("Credit at Risk", thousands(col("credit_at_risk"), 0), "Credit issued to customers who defaulted"),
        ("Overall Default Rate", with_unit(F.round(col("default_rate") * 100, 2), "%"),
         "Percentage of customers who defaulted"),
        ("New vs Existing Split", with_unit(new_share, "% New"),
         "First-time customers vs customers with credit history"),
    ]
    structs = [F.struct(F.lit(a).alias("METRIC"), v.alias("VALUE"), F.lit(d).alias("DESCRIPTION"))
               for a, v, d in rows]
    return m.select(F.inline(F.array(*structs)))


REPORTS = {
    "demo_by_age": demo_by_age,
    "risk_by_income": risk_by_income,
    "age_distribution": age_distribution,
    "gender_mix": gender_mix,
    "income_distribution": income_distribution,
    "education_employment": education_employment,
    "top_occupations": top_occupations,
    "salary_by_profession": salary_by_profession,
    "loan_size_distribution": loan_size_distribution,
    "loan_purpose": loan_purpose,
    "credit_to_income_rows": credit_to_income_rows,
    "application_outcomes": application_outcomes,
    "rejection_reasons": rejection_reasons,
    "approval_by_size": approval_by_size,
    "credit_portfolio": credit_portfolio,
    "payment_status": payment_status,
    "credit_utilization": credit_utilization,
    "payment_timeliness": payment_timeliness,
    "payment_variance_rows": payment_variance_rows,
    "default_kpis": default_kpis,
    "risk_matrix": risk_matrix,
    "history_impact": history_impact,
    "ratio_by_history": ratio_by_history,
    "education_employment_risk": education_employment_risk,
    "family_risk": family_risk,
    "prior_application_risk": prior_application_risk,
    "risk_score": risk_score,
    "risk_score_rows": risk_score_rows,
    "exec_summary": exec_summary,
}
