"""Sinks: overwrite managed tables, resolve the shared checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


#: Compression of saved Parquet tables: smaller files than Spark's default, for the same rows.
CODEC = "zstd"


def save(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "overwrite", database: str | None = None,
         path: str | None = None, bucket_by: tuple[int, str] | None = None, codec: str = CODEC) -> str:
    """Write ``df`` as a table and return its qualified name.

    ``fmt`` is any format on the classpath (parquet by default; ``delta`` when
    its package is installed, which then also honours ``overwriteSchema``).
    ``bucket_by=(n, key)`` buckets and sorts the table by ``key`` so later joins
    on that key read it co-partitioned, without an exchange.  The rows are dealt to
    ``n`` tasks by the key first, so that each bucket is one file.  A bucket is read
    by one task: bucket only tables with one row per key.  ``codec`` compresses
    Parquet tables.
    """
    spark = df.sparkSession
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    qualified = f"`{database}`.`{name}`" if database else f"`{name}`"
    if bucket_by:
        df = df.repartition(bucket_by[0], bucket_by[1])
    writer = df.write.format(fmt).mode(mode)
    if fmt == "delta":
        writer = writer.option("overwriteSchema", "true")
    if fmt == "parquet":
        writer = writer.option("compression", codec)
    if path:
        writer = writer.option("path", path)
    if bucket_by:
        n, key = bucket_by
        writer = writer.bucketBy(n, key).sortBy(key)
    writer.saveAsTable(qualified)
    return qualified


#: Names of a table that is being rebuilt, and of the one that it replaces.
STAGED, REPLACED = "__staged", "__replaced"


def swap(spark: SparkSession, database: str, name: str) -> str:
    """Put the finished table ``name__staged`` in the place of ``name`` and return the qualified name.

    Only names change, so the old table can be read until then, also by the job that wrote the new
    one.  A swap that was cut short is finished by the next one, or undone by ``restore``.
    """
    restore(spark, database, name)
    table = lambda suffix="": f"`{database}`.`{name}{suffix}`"
    if spark.catalog.tableExists(table()):
        spark.sql(f"ALTER TABLE {table()} RENAME TO {table(REPLACED)}")
    spark.sql(f"ALTER TABLE {table(STAGED)} RENAME TO {table()}")
    spark.sql(f"DROP TABLE IF EXISTS {table(REPLACED)}")
    spark.catalog.refreshTable(table())
    return table()


def restore(spark: SparkSession, database: str, name: str) -> None:
    """After a swap that was cut short: the old table gets its name back if the new one has not taken it, or goes."""
    table = lambda suffix="": f"`{database}`.`{name}{suffix}`"
    if spark.catalog.tableExists(table(REPLACED)):
        if spark.catalog.tableExists(table()):
            spark.sql(f"DROP TABLE {table(REPLACED)}")
        else:
            spark.sql(f"ALTER TABLE {table(REPLACED)} RENAME TO {table()}")


def location(spark: SparkSession, table: str) -> str:
    """The folder that a saved table's files lie in."""
    rows = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").select("data_type").collect()
    return rows[0][0]


def buckets_for(table_bytes: int, target: int = 512 << 20) -> int:
    """Number of buckets that gives files of about ``target`` bytes."""
    return max(1, -(-table_bytes // target))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    It is read from the session; only where the session names none, and runs on
    one machine, it is a folder under the warehouse.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the configured folder for written intermediates; the same one each time, to be overwritten."""
    checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints")
    return os.path.join(base, "loanlens", spark.sparkContext.applicationId, *parts)
