"""Operator-level tests: share of total, exact median, KPI fusion, completeness, filters, bands."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.functions import Ladder, band, label_rank
from loanlens.operators import (ALL_ROWS, attach_features, completeness, drop_null, exact_median, keep_range,
                                kpi_long, min_group, share, share_within, top_k)


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", 1.0, True), ("a", 2.0, False), ("b", 3.0, True), ("b", None, True), ("c", 5.0, False),
            (None, 6.0, True)]
    return spark.createDataFrame(rows, "k string, v double, f boolean")


def _as_dict(df, key, val):
    return {r[key]: r[val] for r in df.collect()}


def test_share_same_filter(small):
    out = share(small, ["k"], where=F.col("f"), count_name="N")
    assert _as_dict(out, "k", "N") == {"a": 1, "b": 2, None: 1}
    assert _as_dict(out, "k", "PERCENTAGE") == {"a": 25.0, "b": 50.0, None: 25.0}


def test_share_all_rows_denominator(small):
    out = share(small, ["k"], where=F.col("f"), total_where=ALL_ROWS, count_name="N",
                aggs=lambda only: [F.sum(only(F.col("v"))).alias("S")])
    got = {r.k: (r.N, r.PERCENTAGE, r.S) for r in out.collect()}
    # 'c' has no kept row: dropped, but its row still counts in the total of 6
    assert got == {"a": (1, 16.67, 1.0), "b": (2, 33.33, 3.0), None: (1, 16.67, 6.0)}


def test_share_wider_denominator_and_window_total_agree(small):
    kw = dict(where=F.col("f") & F.col("v").isNotNull(), total_where=F.col("v").isNotNull(), count_name="N")
    a = {tuple(r) for r in share(small, ["k"], **kw).collect()}
    b = {tuple(r) for r in share(small, ["k"], total="window", **kw).collect()}
    assert a == b
    assert {r[0]: r[2] for r in a} == {"a": 20.0, "b": 20.0, None: 20.0}


def test_share_within_partition(spark):
    df = spark.createDataFrame([("x", "p", 1), ("x", "q", 3), ("y", "p", 2)], "band string, s string, n long")
    out = {(r.band, r.s): r.PERCENTAGE for r in share_within(df, ["band"], "n").collect()}
    assert out == {("x", "p"): 25.0, ("x", "q"): 75.0, ("y", "p"): 100.0}


def _percentile_cont(values):
    return float(np.percentile(np.asarray(values, dtype=float), 50, method="linear"))


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_median_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    # a hot group holding most rows, a third of them one value; small odd/even groups; NULL values
    for i in range(30000):
        rows.append(("hot", 250.0 if i % 3 == 0 else float(rng.integers(0, 500))))
    for g, n in [("one", 1), ("two", 2), ("odd", 7), ("even", 10)]:
        rows += [(g, float(x)) for x in rng.normal(100, 20, n)]
    rows.append(("two", None))
    df = spark.createDataFrame(rows, "g string, v double")
    got = _as_dict(exact_median(df, ["g"], "v", "m"), "g", "m")
    by_group = {}
    for g, v in rows:
        if v is not None:
            by_group.setdefault(g, []).append(v)
    want = {g: _percentile_cont(vs) for g, vs in by_group.items()}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-9), g


def test_exact_median_signs_zeros_extremes_and_null_key(spark):
    vals = {"neg": [-5.5, -1e-300, -0.0, 0.0, 2.0, 3.0], "tiny": [5e-324, 1e-310, 2.2250738585072014e-308],
            "big": [1e308, -1e308, 7.0], None: [1.0, 2.0, 3.0, 4.0]}
    rows = [(g, x) for g, xs in vals.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = _as_dict(exact_median(df, ["g"], "v"), "g", "MEDIAN")
    want = {g: _percentile_cont(xs) for g, xs in vals.items()}
    assert got == want


def test_exact_median_nan_and_infinity_as_the_engine(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(g, x) for g, xs in {"a": [1.0, nan, 2.0], "b": [nan, nan, 1.0], "c": [inf, inf], "d": [-inf, 3.0, inf]}.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (repr(r.M), r.N) for r in exact_median(df, ["g"], "v", "M", stats={"N": "count"}).collect()}
    want = {r.g: (repr(r.M), r.N) for r in df.groupBy("g").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY v)").alias("M"), F.count("v").alias("N")).collect()}
    assert got == want


def test_exact_median_group_stats(spark):
    rows = [("a", 1.0), ("a", 4.0), ("a", 10.0), ("b", -2.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r.g: tuple(r)[1:] for r in exact_median(
        df, ["g"], "v", "M", stats={"N": "count", "S": "sum", "LO": "min", "HI": "max", "A": "avg"}).collect()}
    assert out == {"a": (4.0, 3, 15.0, 1.0, 10.0, 5.0), "b": (-2.0, 1, -2.0, -2.0, -2.0, -2.0)}


def test_exact_median_all_null_group_absent(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    assert _as_dict(exact_median(df, ["g"], "v"), "g", "MEDIAN") == {"b": 1.0}


def test_top_k_tiebreak(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 7), ("d", 1)], "name string, n long")
    out = [r.name for r in top_k(df, [F.col("n").desc(), F.col("name")], 3).collect()]
    assert out == ["c", "a", "b"]


def test_kpi_long_single_aggregate(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "x double, y double")
    row = df.agg(F.avg("x").alias("ax"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n"))
    out = kpi_long(row, [("AX", F.col("ax"), {"UNIT": "u", "N": F.col("n")}),
                         ("SY", F.col("sy"), {"UNIT": "v", "N": F.col("n")})])
    assert [tuple(r) for r in out.collect()] == [("AX", 2.0, "u", 2), ("SY", 6.0, "v", 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


def test_completeness(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    out = {r.FEATURE: (r.NON_NULL_COUNT, r.TOTAL_ROWS, r.COMPLETENESS_PCT)
           for r in completeness(df, ["a", "b"]).collect()}
    assert out == {"a": (2, 3, 66.7), "b": (1, 3, 33.3)}


def test_filters(spark):
    df = spark.createDataFrame([(1, 5.0), (None, 7.0), (3, None), (4, 11.0)], "k int, x double")
    assert drop_null(df, "k").count() == 3
    assert keep_range(df, "x", 5, 10).count() == 2
    assert keep_range(df, "x", 5, 10, nulls="keep").count() == 3
    g = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert min_group(g, "n", 2).count() == 0


def test_band_first_match_and_rank(spark):
    lad = Ladder([("<=", 1, "low"), ("between", (0, 5), "mid"), ("==", 9, "nine")], "other")
    df = spark.createDataFrame([(0,), (3,), (9,), (None,)], "x int")
    out = [r.b for r in df.select(lad(F.col("x")).alias("b")).collect()]
    assert out == ["low", "mid", "nine", "other"]
    ranks = [r.r for r in df.select(label_rank(lad(F.col("x")), lad.labels).alias("r")).collect()]
    assert ranks == [1, 2, 3, 4]
    assert band(F.col("x"), [], "z") is not None


def test_attach_features_keeps_rows_and_fills(spark):
    base = spark.createDataFrame([(1,), (2,)], "id long")
    feat = spark.createDataFrame([(1, 5, 2.5)], "id long, n long, a double")
    out = {r.id: (r.n, r.a) for r in attach_features(base, "id", [feat], {"n": 0}).collect()}
    assert out == {1: (5, 2.5), 2: (0, None)}
