"""Explicit schemas of the lending tables.

Reading CSV with an explicit schema avoids the extra pass that ``inferSchema``
launches over every file; inference stays available as an option.  Types are
declared by column name, for the columns that the analytics use; a file's other
columns are kept as text.  Day counts are doubles: files write them both as
``-1180`` and as ``-1180.0``.  The three profiled-only tables have no declared
columns and are read with inference.
"""

from __future__ import annotations

from pyspark.sql import types as T

# FIXED VALUES - the eight input table names and their CSV file names.
TABLE_FILES = {
    "application_train": "application_train.csv",
    "application_test": "application_test.csv",
    "bureau": "bureau.csv",
    "bureau_balance": "bureau_balance.csv",
    "previous_application": "previous_application.csv",
    "pos_cash_balance": "POS_CASH_balance.csv",
    "installments_payments": "installments_payments.csv",
    "credit_card_balance": "credit_card_balance.csv",
}
TABLES = list(TABLE_FILES)

# FIXED VALUES - the column that identifies rows in each table's content checksum.
CHECKSUM_KEYS = {
    "application_train": "SK_ID_CURR", "application_test": "SK_ID_CURR", "bureau": "SK_ID_BUREAU",
    "bureau_balance": "SK_ID_BUREAU", "previous_application": "SK_ID_PREV", "pos_cash_balance": "p_partkey",
    "installments_payments": "SK_ID_PREV", "credit_card_balance": "s_suppkey", "master_dataset": "SK_ID_CURR",
}


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

APPLICATION_TRAIN = _schema(
    ("SK_ID_CURR", L), ("TARGET", I), ("CODE_GENDER", S), ("DAYS_BIRTH", D), ("DAYS_EMPLOYED", D),
    ("AMT_INCOME_TOTAL", D), ("AMT_CREDIT", D), ("AMT_ANNUITY", D), ("NAME_CONTRACT_TYPE", S),
    ("NAME_INCOME_TYPE", S), ("NAME_EDUCATION_TYPE", S), ("NAME_FAMILY_STATUS", S),
    ("OCCUPATION_TYPE", S), ("CNT_CHILDREN", I),
)
APPLICATION_TEST = T.StructType([f for f in APPLICATION_TRAIN.fields if f.name != "TARGET"])
BUREAU = _schema(
    ("SK_ID_CURR", L), ("SK_ID_BUREAU", L), ("CREDIT_ACTIVE", S), ("CREDIT_TYPE", S),
    ("AMT_CREDIT_SUM", D), ("AMT_CREDIT_SUM_DEBT", D), ("DAYS_CREDIT", D),
)
BUREAU_BALANCE = _schema(("SK_ID_BUREAU", L), ("MONTHS_BALANCE", I), ("STATUS", S))
PREVIOUS_APPLICATION = _schema(
    ("SK_ID_CURR", L), ("SK_ID_PREV", L), ("NAME_CONTRACT_STATUS", S), ("CODE_REJECT_REASON", S),
    ("AMT_APPLICATION", D), ("AMT_CREDIT", D), ("DAYS_DECISION", D),
)
INSTALLMENTS_PAYMENTS = _schema(
    ("SK_ID_CURR", L), ("SK_ID_PREV", L), ("AMT_INSTALMENT", D), ("AMT_PAYMENT", D),
    ("DAYS_INSTALMENT", D), ("DAYS_ENTRY_PAYMENT", D),
)

SCHEMAS: dict[str, T.StructType | None] = {
    "application_train": APPLICATION_TRAIN,
    "application_test": APPLICATION_TEST,
    "bureau": BUREAU,
    "bureau_balance": BUREAU_BALANCE,
    "previous_application": PREVIOUS_APPLICATION,
    "pos_cash_balance": None,
    "installments_payments": INSTALLMENTS_PAYMENTS,
    "credit_card_balance": None,
}
