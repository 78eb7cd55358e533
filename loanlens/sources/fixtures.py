"""Lending tables derived from the benchmark's TPC-H-like parquet tables.

The test data holds orders, customers, line items and events, not lending
records, so each lending table is a deterministic projection of them (the
mapping is fixed by FIXTURES.md section 2 and mirrored, as SQL, in
``loanlens.oracles``).  Everything is lazy DataFrame code: projections are
pruned into the parquet scans and the joins are planned by Catalyst.

* application_train  <- orders x customer x nation x region (one row per order)
* bureau             <- lineitem (one row per line)
* previous_application <- lineitem (one row per line; one order in ten has none)
* installments_payments <- lineitem
* bureau_balance     <- events
* application_test   <- application_train without TARGET
* pos_cash_balance / credit_card_balance <- part / supplier (profiled only)
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _mod(c: Column, m: int) -> Column:
    # SQL "%" (sign follows the dividend), not pmod
    return c % F.lit(m)


def application_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    k = F.col("o_orderkey")
    return j.select(
        k.alias("SK_ID_CURR"),
        F.when(_mod(k, 211) == 0, F.lit(None).cast("int"))
        .when(_mod(k * 7919, 100) < 8, F.lit(1)).otherwise(F.lit(0)).alias("TARGET"),
        F.when(F.col("c_nationkey") == 0, F.lit("XNA"))
        .when(_mod(F.col("c_nationkey"), 3) == 1, F.lit("M")).otherwise(F.lit("F")).alias("CODE_GENDER"),
        (-(F.lit(6575) + _mod(k * 37, 19000))).cast("int").alias("DAYS_BIRTH"),
        F.when(_mod(k, 6) == 0, F.lit(365243)).otherwise(-_mod(k * 13, 15000)).cast("int").alias("DAYS_EMPLOYED"),
        ((F.col("c_acctbal") + 1000.0) * 120.0).alias("AMT_INCOME_TOTAL"),
        (F.col("o_totalprice") * 5.0).alias("AMT_CREDIT"),
        (F.col("o_totalprice") * 0.25).alias("AMT_ANNUITY"),
        F.when(_mod(k, 10) == 0, F.lit("Revolving loans")).otherwise(F.lit("Cash loans")).alias("NAME_CONTRACT_TYPE"),
        F.col("c_mktsegment").alias("NAME_INCOME_TYPE"),
        F.col("o_orderpriority").alias("NAME_EDUCATION_TYPE"),
        F.col("r_name").alias("NAME_FAMILY_STATUS"),
        F.when(_mod(k, 3) == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("OCCUPATION_TYPE"),
        _mod(k, 5).cast("int").alias("CNT_CHILDREN"),
    )


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    ext10 = F.col("l_extendedprice") * 10.0
    return li.select(
        F.col("l_orderkey").alias("SK_ID_CURR"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("SK_ID_BUREAU"),
        F.when(F.col("l_returnflag") == "A", "Active").when(F.col("l_returnflag") == "N", "Closed")
        .otherwise("Sold").alias("CREDIT_ACTIVE"),
        F.when(F.col("l_linestatus") == "F", "Consumer credit").otherwise("Credit card").alias("CREDIT_TYPE"),
        F.when(q == 50.0, F.lit(None).cast("double")).when(q == 49.0, F.lit(0.0)).otherwise(ext10)
        .alias("AMT_CREDIT_SUM"),
        F.when(q == 48.0, F.lit(None).cast("double")).otherwise(ext10 * F.col("l_discount") * 10.0)
        .alias("AMT_CREDIT_SUM_DEBT"),
        (-_mod(F.col("l_partkey") * 7 + F.col("l_linenumber"), 2900)).cast("int").alias("DAYS_CREDIT"),
    )


def previous_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").where(_mod(F.col("l_orderkey"), 10) != 0)
    pk, line, price = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_extendedprice")
    kind = _mod(pk + line, 20)
    return li.select(
        F.col("l_orderkey").alias("SK_ID_CURR"),
        (F.col("l_orderkey") * 100 + line).alias("SK_ID_PREV"),
        F.when(kind < 12, "Approved").when(kind < 16, "Refused").when(kind < 19, "Canceled").otherwise("Unused offer")
        .alias("NAME_CONTRACT_STATUS"),
        F.when(_mod(pk, 4) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("R"), _mod(F.col("l_suppkey"), 13).cast("string"))).alias("CODE_REJECT_REASON"),
        F.when(_mod(pk, 97) == 0, F.lit(None).cast("double")).otherwise(price * 15.0).alias("AMT_APPLICATION"),
        (price * 13.5).alias("AMT_CREDIT"),
        (-_mod(pk * 3 + line, 2922)).cast("int").alias("DAYS_DECISION"),
    )


def installments_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    pk = F.col("l_partkey")
    return li.select(
        F.col("l_orderkey").alias("SK_ID_CURR"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("SK_ID_PREV"),
        F.col("l_extendedprice").alias("AMT_INSTALMENT"),
        F.when(_mod(pk, 61) == 0, F.lit(None).cast("double"))
        .otherwise(F.col("l_extendedprice") * (F.lit(1.0) + F.lit(2.0) * F.col("l_tax") - F.lit(2.0) * F.col("l_discount")))
        .alias("AMT_PAYMENT"),
        (-_mod(pk, 2900)).cast("int").alias("DAYS_INSTALMENT"),
        F.when(_mod(pk, 50) == 0, F.lit(None).cast("double"))
        .otherwise(-_mod(pk, 2900) + F.col("l_quantity") - 12.0).cast("int").alias("DAYS_ENTRY_PAYMENT"),
    )


def bureau_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events")
    e9 = _mod(F.col("event_id"), 9)
    status = F.when(e9 == 0, "C")
    for code, label in [(1, "X"), (2, "0"), (3, "1"), (4, "2"), (5, "3"), (6, "4"), (7, "5")]:
        status = status.when(e9 == code, label)
    return ev.select(
        F.col("user_id").alias("SK_ID_BUREAU"),
        (-_mod(F.col("event_id"), 97)).cast("int").alias("MONTHS_BALANCE"),
        status.otherwise(F.lit(None).cast("string")).alias("STATUS"),
    )


FIXTURE_LOADERS = {
    "application_train": application_train,
    "bureau": bureau,
    "bureau_balance": bureau_balance,
    "previous_application": previous_application,
    "pos_cash_balance": lambda spark, sf_dir: _read(spark, sf_dir, "part"),
    "installments_payments": installments_payments,
    "credit_card_balance": lambda spark, sf_dir: _read(spark, sf_dir, "supplier"),
}


def load_fixture_tables(spark: SparkSession, sf_dir: str) -> "LazyTables":
    """All eight lending tables derived from ``sf_dir``; each is built on first use
    (application_test reuses the application_train plan without TARGET)."""
    loaders = {name: (lambda fn=fn: fn(spark, sf_dir)) for name, fn in FIXTURE_LOADERS.items()}
    loaders = {"application_train": loaders.pop("application_train"),
               "application_test": lambda: tables["application_train"].drop("TARGET"), **loaders}
    tables = LazyTables(loaders)  # the lambda above resolves ``tables`` when first called
    return tables


class LazyTables(Mapping):
    """Read-only mapping name -> DataFrame whose plans are built on first access
    (building a plan resolves files and schemas on the driver; a report that
    needs one table should not pay for eight)."""

    def __init__(self, loaders: dict):
        self._loaders = dict(loaders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._loaders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._loaders)

    def __len__(self) -> int:
        return len(self._loaders)
