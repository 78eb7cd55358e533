"""Property-based tests (hypothesis): ladders against a pure-Python first-match
rule, and the exact median against numpy on generated groups."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loanlens.functions import bands as B
from loanlens.operators import exact_median

NUMERIC_LADDERS = {
    "AGE_DISTRIBUTION": B.AGE_DISTRIBUTION, "AGE_GROUP_WIDE": B.AGE_GROUP_WIDE, "AGE_GROUP_SLIM": B.AGE_GROUP_SLIM,
    "INCOME_LEVEL": B.INCOME_LEVEL, "INCOME_CATEGORY": B.INCOME_CATEGORY, "CREDIT_SIZE": B.CREDIT_SIZE,
    "APPLICATION_SIZE": B.APPLICATION_SIZE, "CREDIT_RISK_LEVEL": B.CREDIT_RISK_LEVEL,
    "CREDIT_HISTORY": B.CREDIT_HISTORY, "UTILIZATION": B.UTILIZATION, "PAYMENT_TIMING": B.PAYMENT_TIMING,
    "PAYMENT_CATEGORY": B.PAYMENT_CATEGORY, "CHILDREN": B.CHILDREN, "PRIOR_APPLICATIONS": B.PRIOR_APPLICATIONS,
    "RISK_CATEGORY": B.RISK_CATEGORY, "AGE_RISK": B.AGE_RISK, "INCOME_RISK": B.INCOME_RISK,
    "CREDIT_RATIO_RISK": B.CREDIT_RATIO_RISK, "CREDIT_HISTORY_RISK": B.CREDIT_HISTORY_RISK,
}


def first_match(ladder, x):
    """Independent reading of a ladder: first rule that holds wins; NULL -> otherwise."""
    if x is None:
        return ladder.otherwise
    for op, bound, label in ladder.rules:
        ok = {"<=": lambda: x <= bound, "<": lambda: x < bound, ">=": lambda: x >= bound,
              ">": lambda: x > bound, "==": lambda: x == bound,
              "between": lambda: bound[0] <= x <= bound[1]}[op]()
        if ok:
            return label
    return ladder.otherwise


# values around every threshold used by the ladders, plus wide random values
EDGES = sorted({float(b) + d for lad in NUMERIC_LADDERS.values() for _, bound, _ in lad.rules
                for b in (bound if isinstance(bound, tuple) else (bound,)) for d in (-1, -0.5, 0, 0.5, 1)})
values = st.lists(st.one_of(st.none(), st.sampled_from(EDGES), st.floats(-1e7, 1e7, allow_nan=False),
                            st.integers(-100, 100).map(float)), min_size=1, max_size=300)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(xs=values)
def test_ladders_match_first_match_rule(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    out = df.select("i", *[lad(F.col("x")).cast("string").alias(name) for name, lad in NUMERIC_LADDERS.items()])
    for row in out.collect():
        x = xs[row.i]
        for name, lad in NUMERIC_LADDERS.items():
            assert row[name] == str(first_match(lad, x)), (name, x)


groups = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", None]),
              st.one_of(st.none(), st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False,
                                                                               allow_infinity=False))),
    min_size=1, max_size=400)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=groups)
def test_exact_median_matches_numpy(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.M for r in exact_median(df, ["g"], "v", "M").collect()}
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    want = {g: float(np.percentile(np.asarray(vs), 50, method="linear")) for g, vs in by.items()}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-9), g
