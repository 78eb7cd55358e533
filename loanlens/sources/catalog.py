"""Inspection of loaded tables: row/column profile, schema listing, preview."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: TABLE_NAME, ROW_COUNT, COLUMN_COUNT.

    A single plan (union of one global count per table) instead of one count
    action per table; each branch is a pruned scan with a partial count.
    """
    parts = [
        df.agg(F.count(F.lit(1)).alias("ROW_COUNT")).select(
            F.lit(name).alias("TABLE_NAME"), "ROW_COUNT", F.lit(len(df.columns)).cast("bigint").alias("COLUMN_COUNT"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


#: Checksums: a value counts as a whole number below the first, times its row's key below the second (and one).
_VALUE, _KEY = (1 << 31) - 1, 1 << 20
#: Numbers are taken in thousandths; the offset keeps round values away from the steps of the floor.
_THOUSANDTHS, _OFFSET = 1000.0, 0.3183098861837907
_NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal")


def checksum(value: str, data_type: str, key: str) -> Column:
    """Order-free checksum of a column, as decimal digits: the sum of (value as a whole number) x (row's key).

    A changed, swapped, lost or repeated value changes it.  Numbers count by thousandths, all else by
    the MD5 of its text; NULL values add nothing, and NULL keys count as one.  Tasks add up their rows, so one
    number a column is shuffled.
    """
    c = F.col(f"`{value}`")
    if data_type not in _NUMBERS:
        number = F.conv(F.substring(F.md5(c.cast("string")), 1, 7), 16, 10).cast("long")
    else:
        number = F.pmod(F.floor(c.cast("double") * _THOUSANDTHS + _OFFSET), F.lit(_VALUE))
    row = F.coalesce(F.pmod(F.col(f"`{key}`").cast("long"), F.lit(_KEY)), F.lit(0)) + 1
    return F.coalesce(F.sum((number * row).cast("decimal(18,0)")).cast("string"), F.lit("0"))


def column_profile(tables: Mapping[str, DataFrame], digits: int = 6, keys: Mapping[str, str] | None = None) -> DataFrame:
    """One row per (table, column): TABLE_NAME, POSITION, COLUMN_NAME, DATA_TYPE, NON_NULL_COUNT and the
    least and greatest value (MIN_NUMBER, MAX_NUMBER, rounded to ``digits``, or MIN_TEXT, MAX_TEXT); with
    ``keys`` (table -> its identifying column) also CHECKSUM, of the column's contents row by row.

    One aggregate per table, turned into rows; nothing is gathered on the driver.
    """
    def one(name: str, df: DataFrame) -> DataFrame:
        aggs, rows = [], []
        for i, f in enumerate(df.schema.fields):
            c, text = F.col(f"`{f.name}`"), f.dataType.typeName() == "string"
            aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
            sums = [checksum(f.name, f.dataType.typeName(), keys[name]).alias(f"sum{i}")] if keys else []
            aggs += sums
            number = lambda x: F.lit(None).cast("double") if text else F.round(F.col(x).cast("double"), digits)  # noqa: E731, B023
            word = lambda x: F.col(x) if text else F.lit(None).cast("string")  # noqa: E731, B023
            rows.append(F.struct(
                F.lit(i + 1).alias("POSITION"), F.lit(f.name).alias("COLUMN_NAME"), F.lit(f.dataType.simpleString()).alias("DATA_TYPE"),
                F.col(f"n{i}").alias("NON_NULL_COUNT"), number(f"lo{i}").alias("MIN_NUMBER"), number(f"hi{i}").alias("MAX_NUMBER"),
                word(f"lo{i}").alias("MIN_TEXT"), word(f"hi{i}").alias("MAX_TEXT"),
                *[F.col(f"sum{i}").alias("CHECKSUM") for _ in sums]))
        return df.agg(*aggs).select(F.lit(name).alias("TABLE_NAME"), F.inline(F.array(*rows)))

    return reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items()])


def schema_listing(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per (table, column): TABLE_NAME, POSITION, COLUMN_NAME, DATA_TYPE, NON_NULL_COUNT."""
    return column_profile(tables).select("TABLE_NAME", "POSITION", "COLUMN_NAME", "DATA_TYPE", "NON_NULL_COUNT")


def footer_profile(spark: SparkSession, paths: Mapping[str, str], digits: int = 6) -> DataFrame:
    """Profile of stored Parquet tables from their footers: TABLE_NAME, POSITION, COLUMN_NAME, DATA_TYPE, ROW_COUNT,
    NON_NULL_COUNT, MIN_NUMBER, MAX_NUMBER (numbers only, rounded to ``digits``).

    Counts and extrema are pushed into the readers, which take them from each file's footer and
    decode no data page, so the cost is the number of files, not of rows.  A table with a file whose
    footer lacks an extremum is scanned for the extrema.  Nested columns have no counts.  Ready when it returns: one row a table comes to the driver.
    """
    own = spark.newSession()  # settings of this reader alone
    kept = [x for x in own.conf.get("spark.sql.sources.useV1SourceList").split(",") if x.strip() != "parquet"]
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(kept))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    rows = []
    for name, path in paths.items():
        df = own.read.parquet(path)
        counts, extrema = footer_aggregates(df)
        try:
            r = df.agg(*counts, *extrema).first().asDict()
        except (PySparkException, Py4JJavaError):
            # some file has a column of NULLs alone, or was written without extrema: those come from a scan
            # (which fails too where the files themselves can't be read)
            r = df.agg(*counts).first().asDict() | spark.read.parquet(path).agg(*extrema).first().asDict()
        for i, f in enumerate(df.schema.fields):
            low, high = r.get(f"lo{i}"), r.get(f"hi{i}")
            rows.append((name, i + 1, f.name, f.dataType.simpleString(), r["rows"] or 0, r[f"n{i}"] or 0 if f"n{i}" in r else None,
                         None if low is None else float(low), None if high is None else float(high)))
    schema = "TABLE_NAME string, POSITION int, COLUMN_NAME string, DATA_TYPE string, ROW_COUNT long, NON_NULL_COUNT long, MIN_NUMBER double, MAX_NUMBER double"
    out = spark.createDataFrame(rows, schema)
    return out.withColumns({c: F.round(c, digits) for c in ("MIN_NUMBER", "MAX_NUMBER")})


def footer_aggregates(df: DataFrame) -> tuple[list[Column], list[Column]]:
    """The aggregates that Parquet footers can answer: all counts; least and greatest numbers."""
    counts, extrema = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind not in ("array", "map", "struct"):
            counts.append(F.count(c).alias(f"n{i}"))
        if kind in ("byte", "short", "integer", "long", "float", "double"):
            extrema += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    return counts, extrema


def preview(df: DataFrame, keys: Sequence[str] | None = None, n: int = 20) -> DataFrame:
    """``n`` rows of ``df``: those with the smallest ``keys`` (each task keeps only its ``n`` best), or without keys
    any, read from the first splits that hold so many and no further."""
    return (df.orderBy(*keys) if keys else df).limit(n)


def preview_check(tables: Mapping[str, DataFrame], n: int = 20) -> DataFrame:
    """TABLE_NAME, SHOWN (rows of an unordered preview) and FOUND (rows of a preview that are rows of the table)."""
    def one(name: str, df: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")  # fields that are NULL on both sides agree
        shown = preview(df, None, n).select(row)
        count = lambda rows, shown, found: rows.agg(F.count(F.lit(1)).alias("c")).select(
            F.lit(name).alias("TABLE_NAME"), (F.col("c") * shown).alias("SHOWN"), (F.col("c") * found).alias("FOUND"))
        return count(shown, 1, 0).unionByName(count(shown.join(df.select(row), "row", "left_semi"), 0, 1))

    parts = reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items()])
    return parts.groupBy("TABLE_NAME").agg(F.sum("SHOWN").alias("SHOWN"), F.sum("FOUND").alias("FOUND"))
