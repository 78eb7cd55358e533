"""Registered queries: key -> ``callable(spark, sf_dir) -> DataFrame``.

Every query reads the benchmark tables in ``sf_dir`` through the fixture
mapping (so its work grows with them) and returns a lazy DataFrame.  Unrounded
aggregated doubles of the table-level queries (feature roll-ups, wide and slim
tables) are presented rounded to 6 decimals, on both the Spark side and the
SQL-oracle side, so that summation order across engines cannot flip a
comparison; the library functions themselves return full precision.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import gold, quality, reports, risk
from .plans.context import LendingData
from .plans.reports import REPORTS
from .sources import catalog, csv, sinks
from .sources.schemas import CHECKSUM_KEYS, TABLE_FILES

Query = Callable[[SparkSession, str], DataFrame]

R6 = 6
BUREAU_FEATURE_DOUBLES = ["AVG_CREDIT_AMOUNT", "TOTAL_DEBT", "AVG_CREDIT_UTILIZATION"]
PREVIOUS_FEATURE_DOUBLES = ["AVG_PREV_APPLICATION_AMOUNT", "APPROVAL_RATE"]
PAYMENT_FEATURE_DOUBLES = ["AVG_PAYMENT_DIFFERENCE", "AVG_DAYS_LATE", "LATE_PAYMENT_RATE"]
WIDE_DOUBLES = BUREAU_FEATURE_DOUBLES + PREVIOUS_FEATURE_DOUBLES + PAYMENT_FEATURE_DOUBLES


def _rounded(df: DataFrame, cols: list[str], digits: int = R6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def ctx_for(spark: SparkSession, sf_dir: str) -> LendingData:
    """The session's ``LendingData`` for ``sf_dir``, built once per session and kept on it.

    Only lazy plan objects are kept (like tables registered once per session);
    no data is cached, every query still reads the parquet files."""
    kept = spark.__dict__.setdefault("_loanlens_contexts", {})
    if sf_dir not in kept:
        kept[sf_dir] = LendingData.from_fixtures(spark, sf_dir)
    return kept[sf_dir]


def load_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV source round trip of all eight tables: written as headed CSV with the columns in
    another order and one more than declared, read back by name, and profiled, with a checksum
    of each column's contents."""
    folder = _as_csv(spark, sf_dir, "load_tables")
    return catalog.column_profile(csv.read_tables(spark, folder), keys=CHECKSUM_KEYS).drop("POSITION", "DATA_TYPE")


def infer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second read mode: the eight headed CSV files read with inferred types; name, type and non-null count
    of every column."""
    return catalog.schema_listing(csv.read_tables(spark, _as_csv(spark, sf_dir, "infer_tables"), infer=True)).drop("POSITION")


def _as_csv(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Write the raw tables as headed CSV, columns in reverse and one more than declared; returns the folder."""
    folder = sinks.scratch_path(spark, name)
    for name, df in ctx_for(spark, sf_dir).raw.items():
        columns = [F.col(c) for c in reversed(df.columns)]
        noted = df.select(*columns[:1], F.lit('kept, "as is"').alias("SOURCE_NOTE"), *columns[1:])
        noted.write.mode("overwrite").option("header", "true").option("escape", '"').csv(os.path.join(folder, TABLE_FILES[name]))
    return folder


def footer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the stored tables that the lending tables come from, from their Parquet footers."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    return catalog.footer_profile(spark, {n: os.path.join(sf_dir, f"{n}.parquet") for n in names}).drop("POSITION", "DATA_TYPE")


def preview_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered previews of the five raw tables: rows shown, and how many of them are rows of the table."""
    raw = ctx_for(spark, sf_dir).raw
    return catalog.preview_check({k: raw[k] for k in gold.SILVER_TABLES})


def profile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.profile(ctx_for(spark, sf_dir).raw)


def schema_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.schema_listing(ctx_for(spark, sf_dir).raw)


def _preview(table: str, *keys: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return catalog.preview(ctx_for(spark, sf_dir).raw[table], keys, 20)
    return run


def _database(spark: SparkSession, name: str) -> str:
    """A database whose tables lie in this application's own scratch folder: a folder that an earlier application
    left under the warehouse, unknown to this one's catalog, is not in the way."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{sinks.scratch_path(spark, name)}'")
    return name


def save_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sink round trip: the five cleaned tables and the wide table are written as tables
    (overwriting those of the last run), read back from the catalog, and profiled, with a checksum
    of each column's contents."""
    names = gold.build_tables(ctx_for(spark, sf_dir), _database(spark, "loanlens_gold"))
    return catalog.column_profile({k: spark.table(v) for k, v in names.items()}, keys=CHECKSUM_KEYS).drop("POSITION", "DATA_TYPE")


def risk_wide_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table joined from the saved application and the saved roll-ups, all bucketed by the join key, in buckets
    that grow in number with the applicants, not in size."""
    ctx = ctx_for(spark, sf_dir)
    gold.build_tables(ctx, _database(spark, "loanlens_bucketed"), buckets=gold.buckets_for(ctx.application), rollups=True, include_master=False)
    saved = gold.from_tables(spark, "loanlens_bucketed")
    return _rounded(risk.risk_wide(saved.application, saved.bureau_features, saved.previous_features, saved.payment_features), WIDE_DOUBLES)


def rebuild_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables built, and built again from themselves into the same database by staging and swapping: rows and columns of each."""
    gold.build_tables(ctx_for(spark, sf_dir), _database(spark, "loanlens_rebuilt"), staged=True)
    names = gold.build_tables(gold.from_tables(spark, "loanlens_rebuilt"), "loanlens_rebuilt", staged=True)
    return catalog.profile({k: spark.table(v) for k, v in names.items()})


def risk_score_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V23 over the scored rows written once to the shared folder."""
    ctx = LendingData.from_fixtures(spark, sf_dir)
    ctx.persist_scored()
    return reports.risk_score(ctx)


def master_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL on the views: customers and default rate by age group of ``master_risk_data``,
    first as the wide table, then as the slim one."""
    parts = []
    for master in ("wide", "slim"):
        ctx_for(spark, sf_dir).register_views(master=master)
        parts.append(spark.sql(f"""
            SELECT '{master}' AS MASTER, AGE_GROUP, COUNT(*) AS CUSTOMER_COUNT, ROUND(AVG(TARGET) * 100, 2) AS DEFAULT_RATE
            FROM master_risk_data GROUP BY AGE_GROUP"""))
    return parts[0].unionByName(parts[1])


def _from_ctx(fn: Callable[[LendingData], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ctx_for(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Query] = {
    "load_tables": load_tables,
    "infer_tables": infer_tables,
    "profile_tables": profile_tables,
    "footer_profile": footer_profile,
    "preview_first_rows": preview_first_rows,
    "schema_listing": schema_listing,
    "preview": _preview("application_train", "SK_ID_CURR"),
    "preview_bureau": _preview("bureau", "SK_ID_BUREAU"),
    "preview_bureau_balance": _preview("bureau_balance", "SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"),
    "preview_previous": _preview("previous_application", "SK_ID_PREV"),
    "preview_installments": _preview("installments_payments", "SK_ID_PREV"),
    "save_gold": save_gold,
    "risk_wide_bucketed": risk_wide_bucketed,
    "rebuild_gold": rebuild_gold,
    "risk_score_saved": risk_score_saved,
    "salary_approx_check": _from_ctx(reports.salary_approx_check),
    "master_views": master_views,
    "clean_application": _from_ctx(lambda c: c.application),
    "clean_bureau": _from_ctx(lambda c: c.bureau),
    "clean_previous": _from_ctx(lambda c: c.previous),
    "clean_installments": _from_ctx(lambda c: c.installments),
    "clean_bureau_balance": _from_ctx(lambda c: c.bureau_balance),
    "features_bureau": _from_ctx(lambda c: _rounded(c.bureau_features, BUREAU_FEATURE_DOUBLES)),
    "features_previous": _from_ctx(lambda c: _rounded(c.previous_features, PREVIOUS_FEATURE_DOUBLES)),
    "features_payment": _from_ctx(lambda c: _rounded(c.payment_features, PAYMENT_FEATURE_DOUBLES)),
    "risk_wide": _from_ctx(lambda c: _rounded(c.wide, WIDE_DOUBLES)),
    "risk_slim": _from_ctx(lambda c: _rounded(c.slim, ["TOTAL_DEBT"])),
    "stage_counts": _from_ctx(quality.stage_counts),
    "portfolio_summary": _from_ctx(quality.portfolio_summary),
    "completeness": _from_ctx(quality.completeness),
    **{name: _from_ctx(fn) for name, fn in REPORTS.items()},
}
