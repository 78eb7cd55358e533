"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate):
same row count, same column names, same order-insensitive values."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

from loanlens.registry import QUERIES as REPORTS

from .conftest import SF01

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF01, t + '.parquet')}')")
    yield c
    c.close()


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_registered_has_oracle_or_is_catalog():
    """Every query of the lending reports; the optional llm queries have SQL where it can say them."""
    assert set(REPORTS) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(REPORTS))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF01)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[key])
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _canon(df.columns, s_rows) == _canon(d_cols, d_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["RISK_CATEGORY", "CUSTOMER_COUNT", "ACTUAL_DEFAULT_RATE", "PERCENTAGE_OF_PORTFOLIO",
                          "AVG_RISK_SCORE"]
    assert df.count() > 0
