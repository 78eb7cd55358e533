"""Data-quality summaries: portfolio averages, feature completeness, stage counts.

The notebook printed these with one action per number (16 counts, 11 filtered
counts, 5 single-value aggregates).  Here each is a single plan: one aggregate
(``portfolio_summary``, ``completeness``) or one aggregate per table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import completeness as completeness_op
from .context import LendingData

# FIXED VALUES - the ten columns whose completeness is reported.
KEY_FEATURES = [
    "TARGET", "CODE_GENDER", "AGE_YEARS", "AMT_INCOME_TOTAL", "AMT_CREDIT",
    "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS", "BUREAU_CREDIT_COUNT",
    "TOTAL_PREV_APPLICATIONS", "CREDIT_INCOME_RATIO",
]


def portfolio_summary(ctx: LendingData) -> DataFrame:
    """One row: CUSTOMER_COUNT, DEFAULT_RATE (%), AVG_AGE, AVG_INCOME, AVG_CREDIT."""
    return ctx.wide.agg(
        F.count(F.lit(1)).alias("CUSTOMER_COUNT"),
        F.round(F.avg("TARGET") * 100, 2).alias("DEFAULT_RATE"),
        F.round(F.avg("AGE_YEARS"), 1).alias("AVG_AGE"),
        F.round(F.avg("AMT_INCOME_TOTAL"), 0).alias("AVG_INCOME"),
        F.round(F.avg("AMT_CREDIT"), 0).alias("AVG_CREDIT"),
    )


def completeness(ctx: LendingData, columns: list[str] | None = None) -> DataFrame:
    """Per key feature of the wide table: FEATURE, NON_NULL_COUNT, TOTAL_ROWS, COMPLETENESS_PCT."""
    return completeness_op(ctx.wide, columns or KEY_FEATURES)


def stage_counts(ctx: LendingData) -> DataFrame:
    """Row count after each cleaning and feature step: STAGE, ROW_COUNT.

    One aggregate per table: a child table's rows are counted per applicant, and
    the sum of the counts is the cleaned table's size, their number the roll-up's.
    ``master_dataset`` is the count of the joined table itself.  The joins are left
    out of its plan only where a roll-up is grouped by the key in the same plan, and
    so can't repeat it; a roll-up that comes from elsewhere is joined and counted.
    """
    n = F.count(F.lit(1))

    def rows(counted: DataFrame, stages: dict[str, str]) -> DataFrame:
        return counted.select(F.inline(F.array(*[F.struct(F.lit(s).alias("STAGE"), F.col(c).alias("ROW_COUNT")) for s, c in stages.items()])))

    def child(df: DataFrame, cleaned: str, rolled: str) -> DataFrame:
        per_key = df.groupBy("SK_ID_CURR").agg(n.alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), n.alias("keys"))
        return rows(per_key, {cleaned: "rows", rolled: "keys"})

    parts = [
        rows(ctx.application.agg(n.alias("rows")), {"application_train_clean": "rows"}),
        rows(ctx.wide.agg(n.alias("rows")), {"master_dataset": "rows"}),
        child(ctx.bureau, "bureau_clean", "bureau_features"),
        child(ctx.previous, "previous_application_clean", "prev_app_features"),
        child(ctx.installments, "installments_payments_clean", "payment_features"),
        rows(ctx.bureau_balance.agg(n.alias("rows")), {"bureau_balance_clean": "rows"}),
    ]
    return reduce(DataFrame.unionByName, parts)
