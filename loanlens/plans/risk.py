"""Gold layer: the wide and slim risk tables and the additive scorecard.

The two tables differ on purpose (different age/income bands; ratio unrounded
in ``risk_wide``, rounded to 2 digits in ``risk_slim``; payment features only in
the wide one), so they are kept as two separate frames.

Both are the application table left-joined to customer-grain roll-ups on
SK_ID_CURR.  The roll-ups leave their aggregate hash-partitioned on that key, so
the join chain shuffles the application side once and reuses the roll-ups'
partitioning; the slim table reuses the wide table's roll-ups (Catalyst prunes
the aggregates it does not read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions.columns import sum_cols, years_from_days
from ..operators.joins import attach_features

KEY = "SK_ID_CURR"

# Feature columns filled with 0 after the joins (the other four stay NULL:
# DAYS_LAST_CREDIT, AVG_PREV_APPLICATION_AMOUNT, DAYS_LAST_DECISION, MAX_DAYS_LATE).
FILL_ZERO = [
    "BUREAU_CREDIT_COUNT", "ACTIVE_CREDIT_COUNT", "CLOSED_CREDIT_COUNT",
    "AVG_CREDIT_AMOUNT", "TOTAL_DEBT", "AVG_CREDIT_UTILIZATION",
    "TOTAL_PREV_APPLICATIONS", "APPROVED_APPLICATIONS", "REFUSED_APPLICATIONS",
    "CANCELED_APPLICATIONS", "APPROVAL_RATE", "TOTAL_PAYMENTS",
    "AVG_PAYMENT_DIFFERENCE", "AVG_DAYS_LATE", "LATE_PAYMENTS_COUNT",
    "LATE_PAYMENT_RATE",
]


def risk_wide(app_clean: DataFrame, bureau_feat: DataFrame, previous_feat: DataFrame,
              payment_feat: DataFrame) -> DataFrame:
    """All cleaned application columns + the three roll-ups + five band columns."""
    joined = attach_features(app_clean, KEY, [bureau_feat, previous_feat, payment_feat],
                             {c: 0 for c in FILL_ZERO})
    return joined.withColumns({
        "AGE_GROUP": B.AGE_GROUP_WIDE(F.col("AGE_YEARS")),
        "INCOME_LEVEL": B.INCOME_LEVEL(F.col("AMT_INCOME_TOTAL")),
        "CREDIT_SIZE_CATEGORY": B.CREDIT_SIZE(F.col("AMT_CREDIT")),
        "CREDIT_RISK_LEVEL": B.CREDIT_RISK_LEVEL(F.col("CREDIT_INCOME_RATIO")),
        "CREDIT_HISTORY_LEVEL": B.CREDIT_HISTORY(F.col("BUREAU_CREDIT_COUNT")),
    })


def slim_bureau(bureau_feat: DataFrame) -> DataFrame:
    """The three bureau columns the slim table keeps (debt sum coalesced to 0)."""
    return bureau_feat.select(
        KEY,
        F.col("BUREAU_CREDIT_COUNT").alias("TOTAL_BUREAU_CREDITS"),
        F.col("ACTIVE_CREDIT_COUNT").alias("ACTIVE_CREDITS"),
        F.coalesce(F.col("TOTAL_DEBT"), F.lit(0.0)).alias("TOTAL_DEBT"),
    )


def slim_previous(previous_feat: DataFrame) -> DataFrame:
    """Earlier-application count and approval rate rounded to 2 digits."""
    n = F.col("TOTAL_PREV_APPLICATIONS")
    approved = F.col("APPROVED_APPLICATIONS")
    rate = F.when(n == 0, F.lit(0.0)).otherwise(F.round(approved * 100.0 / n, 2))
    return previous_feat.select(KEY, n.alias("TOTAL_PREV_APPLICATIONS"), rate.alias("APPROVAL_RATE"))


def risk_slim(app_clean: DataFrame, bureau_feat: DataFrame, previous_feat: DataFrame) -> DataFrame:
    """Exactly 20 columns: 15 application columns + 5 history columns."""
    age = years_from_days("DAYS_BIRTH")
    inc, cred = F.col("AMT_INCOME_TOTAL"), F.col("AMT_CREDIT")
    base = app_clean.filter(inc.isNotNull() & cred.isNotNull()).select(
        KEY, "TARGET", "CODE_GENDER",
        age.alias("AGE"),
        B.AGE_GROUP_SLIM(age).alias("AGE_GROUP"),
        "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE",
        "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS", "CNT_CHILDREN",
        F.round(F.try_divide(cred, inc), 2).alias("CREDIT_INCOME_RATIO"),
        B.INCOME_CATEGORY(inc).alias("INCOME_CATEGORY"),
    )
    b = slim_bureau(bureau_feat)
    p = slim_previous(previous_feat)
    joined = base.join(b, KEY, "left").join(p, KEY, "left")
    return joined.select(
        *base.columns,
        F.coalesce(F.col("TOTAL_BUREAU_CREDITS"), F.lit(0)).alias("BUREAU_CREDITS"),
        F.coalesce(F.col("ACTIVE_CREDITS"), F.lit(0)).alias("ACTIVE_CREDITS"),
        F.coalesce(F.col("TOTAL_DEBT"), F.lit(0.0)).alias("TOTAL_DEBT"),
        F.coalesce(F.col("TOTAL_PREV_APPLICATIONS"), F.lit(0)).alias("PREV_APPLICATIONS"),
        F.coalesce(F.col("APPROVAL_RATE"), F.lit(0.0)).alias("HISTORICAL_APPROVAL_RATE"),
    )


SCORE_COLUMNS = ["AGE_RISK_SCORE", "INCOME_RISK_SCORE", "CREDIT_RATIO_RISK_SCORE",
                 "CREDIT_HISTORY_RISK_SCORE", "PREV_APP_RISK_SCORE"]


def risk_scored(slim: DataFrame) -> DataFrame:
    """Row-level scorecard over the slim table: SK_ID_CURR, TARGET, five scores,
    TOTAL_RISK_SCORE (0..15) and RISK_CATEGORY."""
    prev_app = (F.when(F.col("PREV_APPLICATIONS") == 0, F.lit(B.PREV_APP_RISK_FIRST_TIME))
                .otherwise(B.PREV_APP_RISK_BY_APPROVAL(F.col("HISTORICAL_APPROVAL_RATE"))))
    scored = slim.select(
        KEY, "TARGET",
        B.AGE_RISK(F.col("AGE")).alias("AGE_RISK_SCORE"),
        B.INCOME_RISK(F.col("AMT_INCOME_TOTAL")).alias("INCOME_RISK_SCORE"),
        B.CREDIT_RATIO_RISK(F.col("CREDIT_INCOME_RATIO")).alias("CREDIT_RATIO_RISK_SCORE"),
        B.CREDIT_HISTORY_RISK(F.col("BUREAU_CREDITS")).alias("CREDIT_HISTORY_RISK_SCORE"),
        prev_app.alias("PREV_APP_RISK_SCORE"),
    )
    total = sum_cols(*SCORE_COLUMNS)
    return scored.withColumns({
        "TOTAL_RISK_SCORE": total,
        "RISK_CATEGORY": B.RISK_CATEGORY(total),
    })
