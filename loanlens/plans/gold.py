"""Bronze -> silver -> gold build: write the cleaned tables and the wide master
table, and read them back as a ``LendingData`` for the reports.

With ``buckets=n`` the tables with one row per SK_ID_CURR (the application, the
master table and, with ``rollups=True``, the three roll-ups) are written bucketed
and sorted by it, so a join on the key never shuffles them: with saved roll-ups the
wide and the slim table are joined without any exchange.  The child tables are not: an applicant may hold any share
of their rows, a bucket is read by one task, and unbucketed they are combined
on every mapper before the exchange.  This is the Spark counterpart of indexing
the tables on SK_ID_CURR.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import STAGED, restore, save, swap
from .context import LendingData

# FIXED VALUES - saved table names.
SILVER_TABLES = {
    "application_train": "application_train",
    "bureau": "bureau",
    "bureau_balance": "bureau_balance",
    "previous_application": "previous_application",
    "installments_payments": "installments_payments",
}
MASTER_TABLE = "master_dataset"
# Saved roll-ups: table name -> attribute of LendingData.
ROLLUP_TABLES = {"bureau_features": "bureau_features", "prev_app_features": "previous_features",
                 "payment_features": "payment_features"}
ONE_ROW_PER_APPLICANT = {"application_train", MASTER_TABLE, *ROLLUP_TABLES}
#: Applicants in a bucket, about: one task sorts and joins a bucket of the application and of every roll-up.
ROWS_PER_BUCKET, FEWEST_BUCKETS = 1 << 18, 4


def buckets_for(application: DataFrame) -> int:
    """Number of buckets that gives a task about ROWS_PER_BUCKET applicants, however many there are."""
    return max(FEWEST_BUCKETS, -(-application.count() // ROWS_PER_BUCKET))


def build_tables(ctx: LendingData, database: str, fmt: str = "parquet", buckets: int | None = None,
                 include_master: bool = True, row_counts: dict[str, int] | None = None, rollups: bool = False,
                 staged: bool = False) -> dict[str, str]:
    """Write the five cleaned tables, then the wide master table computed from the
    *written* cleaned tables (the lineage is cut there: the master does not redo
    the cleaning, and a lost executor only recomputes from the saved tables).
    With ``rollups`` the three roll-ups are written in between, and the master table
    is joined from them.  Returns name -> qualified table.

    With ``staged`` every table is written beside the old one, and all are swapped by
    name once the last is written: ``ctx`` may read the very tables that are rebuilt,
    and a build that fails leaves the old ones as they were.

    Pass a dict as ``row_counts`` to receive the row count of every written table.
    The counts are ``observe`` metrics gathered by the write jobs themselves, so
    no extra count job runs."""
    out = {}
    observed: dict[str, Observation] = {}

    def write(key: str, df: DataFrame, table: str) -> DataFrame:
        if row_counts is not None:
            observed[key] = Observation(f"rows_{key}")
            df = df.observe(observed[key], F.count(F.lit(1)).alias("rows"))
        bucket = (buckets, "SK_ID_CURR") if buckets and key in ONE_ROW_PER_APPLICANT else None
        out[key] = save(df, table + suffix, fmt=fmt, database=database, bucket_by=bucket)
        return ctx.spark.table(out[key])

    suffix = STAGED if staged else ""
    saved = from_silver(ctx.spark, {key: write(key, df, SILVER_TABLES[key]) for key, df in ctx.silver().items()})
    if rollups:
        for table, attribute in ROLLUP_TABLES.items():
            saved.__dict__[attribute] = write(table, getattr(saved, attribute), table)
    if include_master:
        write(MASTER_TABLE, saved.wide, MASTER_TABLE)
    if staged:
        out = {key: swap(ctx.spark, database, SILVER_TABLES.get(key, key)) for key in out}
    if row_counts is not None:
        row_counts.update({k: o.get["rows"] for k, o in observed.items()})
    return out


def from_silver(spark: SparkSession, silver: Mapping[str, DataFrame]) -> LendingData:
    """A ``LendingData`` whose cleaned frames are ``silver`` (already cleaned)."""
    ctx = LendingData(spark, {})
    attr = {"application_train": "application", "bureau": "bureau", "bureau_balance": "bureau_balance",
            "previous_application": "previous", "installments_payments": "installments"}
    for key, df in silver.items():
        ctx.__dict__[attr[key]] = df
    return ctx


def _saved_silver(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    return {k: spark.table(f"`{database}`.`{v}`") for k, v in SILVER_TABLES.items()}


def from_tables(spark: SparkSession, database: str) -> LendingData:
    """Reports over the saved tables of ``database``: the silver ones, and the roll-ups and the wide table if they
    were saved.  Swaps of a rebuild that was cut short are settled first."""
    for name in (*SILVER_TABLES.values(), *ROLLUP_TABLES, MASTER_TABLE):
        restore(spark, database, name)
    ctx = from_silver(spark, _saved_silver(spark, database))
    for table, attribute in ROLLUP_TABLES.items():
        if spark.catalog.tableExists(f"`{database}`.`{table}`"):
            ctx.__dict__[attribute] = spark.table(f"`{database}`.`{table}`")
    if spark.catalog.tableExists(f"`{database}`.`{MASTER_TABLE}`"):
        ctx.__dict__["wide"] = spark.table(f"`{database}`.`{MASTER_TABLE}`")
    return ctx
