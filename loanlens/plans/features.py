"""Customer-grain feature roll-ups (one row per SK_ID_CURR).

Each is a single ``groupBy(SK_ID_CURR).agg(...)``: a partial aggregate on every
mapper, one exchange hash-partitioned by the key, a final aggregate.  A key that
owns a huge share of the child rows is combined map-side before the shuffle, so
no task receives more than one partial row per mapper for it.  The output stays
hash-partitioned on SK_ID_CURR, which the later joins on the same key reuse.

Note kept from the source: DAYS_LAST_* is the MAX of already-absolute day counts,
i.e. the *oldest* event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_where, pct
from ..operators.aggregate import rollup_by

KEY = "SK_ID_CURR"


def bureau_features(bureau_clean: DataFrame) -> DataFrame:
    """BUREAU_CREDIT_COUNT, ACTIVE_/CLOSED_CREDIT_COUNT, AVG_CREDIT_AMOUNT, TOTAL_DEBT,
    AVG_CREDIT_UTILIZATION, DAYS_LAST_CREDIT."""
    status = F.col("CREDIT_ACTIVE")
    return rollup_by(bureau_clean, KEY, [
        F.count("SK_ID_BUREAU").alias("BUREAU_CREDIT_COUNT"),
        count_where(status == "Active").alias("ACTIVE_CREDIT_COUNT"),
        count_where(status == "Closed").alias("CLOSED_CREDIT_COUNT"),
        F.avg("AMT_CREDIT_SUM").alias("AVG_CREDIT_AMOUNT"),
        F.sum("AMT_CREDIT_SUM_DEBT").alias("TOTAL_DEBT"),
        F.avg("CREDIT_UTILIZATION_RATIO").alias("AVG_CREDIT_UTILIZATION"),
        F.max("DAYS_CREDIT").alias("DAYS_LAST_CREDIT"),
    ])


def previous_features(previous_clean: DataFrame) -> DataFrame:
    """TOTAL_PREV_APPLICATIONS, APPROVED_/REFUSED_/CANCELED_APPLICATIONS,
    AVG_PREV_APPLICATION_AMOUNT, DAYS_LAST_DECISION, APPROVAL_RATE (percent, unrounded)."""
    status = F.col("NAME_CONTRACT_STATUS")
    agg = rollup_by(previous_clean, KEY, [
        F.count("SK_ID_PREV").alias("TOTAL_PREV_APPLICATIONS"),
        count_where(status == "Approved").alias("APPROVED_APPLICATIONS"),
        count_where(status == "Refused").alias("REFUSED_APPLICATIONS"),
        count_where(status == "Canceled").alias("CANCELED_APPLICATIONS"),
        F.avg("AMT_APPLICATION").alias("AVG_PREV_APPLICATION_AMOUNT"),
        F.max("DAYS_DECISION").alias("DAYS_LAST_DECISION"),
    ])
    return agg.withColumn("APPROVAL_RATE", pct("APPROVED_APPLICATIONS", "TOTAL_PREV_APPLICATIONS", 0))


def payment_features(installments_clean: DataFrame) -> DataFrame:
    """TOTAL_PAYMENTS, AVG_PAYMENT_DIFFERENCE, AVG_DAYS_LATE, LATE_PAYMENTS_COUNT,
    MAX_DAYS_LATE, LATE_PAYMENT_RATE (percent, unrounded)."""
    late = F.col("DAYS_LATE")
    agg = rollup_by(installments_clean, KEY, [
        F.count("SK_ID_PREV").alias("TOTAL_PAYMENTS"),
        F.avg("PAYMENT_DIFFERENCE").alias("AVG_PAYMENT_DIFFERENCE"),
        F.avg(late).alias("AVG_DAYS_LATE"),
        count_where(late > 0).alias("LATE_PAYMENTS_COUNT"),
        F.max(late).alias("MAX_DAYS_LATE"),
    ])
    return agg.withColumn("LATE_PAYMENT_RATE", pct("LATE_PAYMENTS_COUNT", "TOTAL_PAYMENTS", 0))
