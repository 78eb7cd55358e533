"""Incremental bronze -> silver refresh with Structured Streaming.

The five cleaners are row-level filters and projections (no state), so the very
same functions run on a streaming DataFrame: new raw files landing in a folder
are cleaned and appended to the silver table exactly once (the checkpoint in the
shared folder records which files were processed, so a restarted job - or one
that lost executors - resumes without duplicates).  ``trigger="available_now"``
processes what is there and stops, which suits a scheduled refresh; a
processing-time trigger keeps the query running.

The roll-ups and risk tables aggregate over all history, so they stay batch jobs
over the silver tables (``loanlens.plans``), rebuilt after a refresh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import clean
from ..sources.csv import by_header
from ..sources.schemas import SCHEMAS

CLEANERS = {
    "application_train": clean.clean_application,
    "bureau": clean.clean_bureau,
    "previous_application": clean.clean_previous,
    "installments_payments": clean.clean_installments,
    "bureau_balance": clean.clean_bureau_balance,
}


def cleaned_stream(spark: SparkSession, table: str, source_dir: str, fmt: str = "csv",
                   max_files_per_trigger: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Streaming DataFrame of the cleaned rows of new ``table`` files in ``source_dir``.

    CSV types are taken by name from the header of the files already there; a file
    with another header, or a value that does not fit, stops the query (``mode``).
    """
    schema = by_header(spark, source_dir, SCHEMAS[table]) if fmt == "csv" else SCHEMAS[table]
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false").option("mode", mode)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return CLEANERS[table](reader.load(source_dir))


def start_silver_refresh(spark: SparkSession, table: str, source_dir: str, target_dir: str, checkpoint: str,
                         fmt: str = "csv", trigger: str = "available_now",
                         interval: str = "1 minute") -> StreamingQuery:
    """Start appending cleaned ``table`` rows from ``source_dir`` to parquet at ``target_dir``.

    ``checkpoint`` must be a folder all executors and the driver share."""
    writer = (cleaned_stream(spark, table, source_dir, fmt).writeStream.format("parquet")
              .option("path", target_dir).option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger == "available_now":
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=interval)
    return writer.start()
