"""Headed-CSV reader for the raw (bronze) lending tables."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .schemas import SCHEMAS, TABLE_FILES


def by_header(spark: SparkSession, path: str, declared: T.StructType) -> T.StructType:
    """The columns of the file's header, in its order: declared types by name, all others text.

    A declared column that the header lacks is an error.
    """
    header = spark.read.option("header", "true").csv(path).columns
    missing = [f.name for f in declared.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(header)}")
    types = {f.name: f.dataType for f in declared.fields}
    return T.StructType([T.StructField(name, types.get(name, T.StringType()), True) for name in header])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, infer: bool = False,
               mode: str = "FAILFAST") -> DataFrame:
    """Read one headed CSV file (or folder of part files).

    ``schema`` declares types by column name; columns it does not name are kept as
    text, in the file's order.  Part files whose header differs from the first
    one's are an error, and so is a value that does not fit its declared type;
    ``mode="PERMISSIVE"`` makes such values NULL instead.  Without ``schema``,
    ``infer=True`` asks Spark to infer types (an extra pass over the data) and
    ``infer=False`` leaves every column text.
    """
    reader = spark.read.option("header", "true").option("escape", '"')
    if schema is not None:
        reader = reader.schema(by_header(spark, path, schema)).option("enforceSchema", "false").option("mode", mode)
    elif infer:
        reader = reader.option("inferSchema", "true")
    return reader.csv(path)


def read_tables(spark: SparkSession, directory: str, infer: bool = False, names: list[str] | None = None,
                mode: str = "FAILFAST") -> Mapping[str, DataFrame]:
    """Read the lending tables from ``directory`` (file names as in ``TABLE_FILES``).

    Tables with a declared schema use it unless ``infer`` is set; the others are
    always inferred.
    """
    from .fixtures import LazyTables

    def loader(name):
        schema = None if infer else SCHEMAS.get(name)
        return lambda: read_table(spark, os.path.join(directory, TABLE_FILES[name]), schema=schema,
                                  infer=schema is None, mode=mode)

    return LazyTables({name: loader(name) for name in names or list(TABLE_FILES)})
