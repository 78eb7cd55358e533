"""Silver layer: the five cleaners (bronze DataFrame -> cleaned DataFrame).

Each is a short chain of filters and one projection.  The filters are simple
comparisons on input columns, so on saved raw tables Catalyst pushes them into
the parquet scans (on the test fixtures, which compute those columns, only their
null tests get there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import EMPLOYMENT_SENTINEL_DAYS
from ..functions.columns import safe_ratio, years_from_days
from ..operators.filters import drop_null, keep_range

# FIXED VALUES - outlier bounds of the cleaning rules (inclusive).
INCOME_RANGE = (10000, 10000000)
CREDIT_RANGE = (10000, 50000000)
BUREAU_CREDIT_SUM_RANGE = (0, 100000000)
PREVIOUS_APPLICATION_RANGE = (0, 50000000)


def clean_application(df: DataFrame) -> DataFrame:
    """Known TARGET, income and credit within bounds; day counts made positive;
    AGE_YEARS, CREDIT_INCOME_RATIO and EMPLOYMENT_YEARS added."""
    out = drop_null(df, "TARGET")
    out = keep_range(out, "AMT_INCOME_TOTAL", *INCOME_RANGE)
    out = keep_range(out, "AMT_CREDIT", *CREDIT_RANGE)
    out = out.withColumns({"DAYS_BIRTH": F.abs("DAYS_BIRTH"), "DAYS_EMPLOYED": F.abs("DAYS_EMPLOYED")})
    return out.withColumns({
        "AGE_YEARS": years_from_days("DAYS_BIRTH"),
        "CREDIT_INCOME_RATIO": safe_ratio("AMT_CREDIT", "AMT_INCOME_TOTAL", 0),
        "EMPLOYMENT_YEARS": years_from_days("DAYS_EMPLOYED", sentinel=EMPLOYMENT_SENTINEL_DAYS),
    })


def clean_bureau(df: DataFrame) -> DataFrame:
    """Known applicant; credit sum NULL or within bounds; DAYS_CREDIT made
    positive; CREDIT_UTILIZATION_RATIO = debt / sum when both known and sum > 0, else 0."""
    out = drop_null(df, "SK_ID_CURR")
    out = keep_range(out, "AMT_CREDIT_SUM", *BUREAU_CREDIT_SUM_RANGE, nulls="keep")
    return out.withColumns({
        "DAYS_CREDIT": F.abs("DAYS_CREDIT"),
        "CREDIT_UTILIZATION_RATIO": safe_ratio("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM", 0, require_not_null=True),
    })


def clean_previous(df: DataFrame) -> DataFrame:
    """Known applicant; application amount NULL or within bounds; DAYS_DECISION made positive."""
    out = drop_null(df, "SK_ID_CURR")
    out = keep_range(out, "AMT_APPLICATION", *PREVIOUS_APPLICATION_RANGE, nulls="keep")
    return out.withColumn("DAYS_DECISION", F.abs("DAYS_DECISION"))


def clean_installments(df: DataFrame) -> DataFrame:
    """Known applicant, payment and instalment; PAYMENT_DIFFERENCE and DAYS_LATE added
    (DAYS_LATE is NULL when either day is unknown)."""
    out = drop_null(df, "SK_ID_CURR")
    out = drop_null(out, "AMT_PAYMENT", "AMT_INSTALMENT")
    return out.withColumns({
        "PAYMENT_DIFFERENCE": F.col("AMT_PAYMENT") - F.col("AMT_INSTALMENT"),
        "DAYS_LATE": F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT"),
    })


def clean_bureau_balance(df: DataFrame) -> DataFrame:
    """Known bureau credit id."""
    return drop_null(df, "SK_ID_BUREAU")
