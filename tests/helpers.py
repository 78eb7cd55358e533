"""Hand-made lending tables for edge-case tests."""

from __future__ import annotations

from loanlens.plans.context import LendingData
from loanlens.sources import schemas as S

APP_DEFAULT = dict(
    SK_ID_CURR=1, TARGET=0, CODE_GENDER="F", DAYS_BIRTH=-12000, DAYS_EMPLOYED=-1000,
    AMT_INCOME_TOTAL=150000.0, AMT_CREDIT=300000.0, AMT_ANNUITY=15000.0, NAME_CONTRACT_TYPE="Cash loans",
    NAME_INCOME_TYPE="Working", NAME_EDUCATION_TYPE="Higher", NAME_FAMILY_STATUS="Married",
    OCCUPATION_TYPE="Laborers", CNT_CHILDREN=0,
)


def rows(schema, defaults, overrides):
    out = []
    for o in overrides:
        r = {**defaults, **o}
        out.append(tuple(float(r[f.name]) if f.dataType.typeName() == "double" and r.get(f.name) is not None else r.get(f.name) for f in schema.fields))
    return out


def frame(spark, schema, defaults, overrides):
    return spark.createDataFrame(rows(schema, defaults, overrides), schema)


def lending(spark, app=(), bureau=(), previous=(), installments=(), bureau_balance=()):
    """A LendingData over hand-made rows (each argument: list of override dicts)."""
    raw = {
        "application_train": frame(spark, S.APPLICATION_TRAIN, APP_DEFAULT, app),
        "bureau": frame(spark, S.BUREAU, dict(SK_ID_CURR=1, SK_ID_BUREAU=10, CREDIT_ACTIVE="Active",
                                               CREDIT_TYPE="Consumer credit", AMT_CREDIT_SUM=1000.0,
                                               AMT_CREDIT_SUM_DEBT=100.0, DAYS_CREDIT=-100), bureau),
        "previous_application": frame(spark, S.PREVIOUS_APPLICATION,
                                      dict(SK_ID_CURR=1, SK_ID_PREV=100, NAME_CONTRACT_STATUS="Approved",
                                           CODE_REJECT_REASON="XAP", AMT_APPLICATION=1000.0, AMT_CREDIT=900.0,
                                           DAYS_DECISION=-10), previous),
        "installments_payments": frame(spark, S.INSTALLMENTS_PAYMENTS,
                                       dict(SK_ID_CURR=1, SK_ID_PREV=100, AMT_INSTALMENT=100.0, AMT_PAYMENT=100.0,
                                            DAYS_INSTALMENT=-30, DAYS_ENTRY_PAYMENT=-30), installments),
        "bureau_balance": frame(spark, S.BUREAU_BALANCE, dict(SK_ID_BUREAU=10, MONTHS_BALANCE=0, STATUS="C"),
                                bureau_balance),
    }
    return LendingData(spark, raw)
