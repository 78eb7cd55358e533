"""Exact per-group median (``PERCENTILE_CONT(0.5)``) without gathering a group.

Spark's exact ``percentile`` aggregate keeps a value -> count map per group and
merges it in one task, so a group holding a third of all rows (with many
distinct values) would be collected whole.  This operator is a radix select:

* the rows are first counted by (group, value), combined before the shuffle, so
  that a value shared by any number of rows is one row from then on; all later
  steps read that one exchange;
* every value is mapped to its order-preserving 64-bit key (IEEE-754 bits,
  computed with built-in column arithmetic, no UDF);
* the two middle ranks ``floor((n-1)/2)`` and ``ceil((n-1)/2)`` are located one
  digit at a time (digits of 22, 21 and 21 bits): a level adds up the counts per
  (group, target, next digit) among the values whose leading bits match the
  target's prefix found so far, then a running count over at most 2**22 digit
  values picks the digit that holds the remaining rank;
* after three levels the whole key - hence the value - is known.

There is one path for all sizes, the result is deterministic when tasks are
recomputed, and no task orders more than 2**22 histogram rows of one group,
whatever the group's size.  The levels are one Spark SQL statement: the plan is
analysed once instead of once per DataFrame call.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DIGITS = (22, 21, 21)  # bits per level, most significant first; sums to 64
_TWO52 = float(2 ** 52)
_MIN_NORMAL = 2.0 ** -1022


def sortable_key(v: Column) -> Column:
    """Signed 64-bit key whose order equals the engine's order of doubles
    (+0.0 and -0.0 share key 0; +/-inf past every finite value, NaN past all)."""
    a = F.abs(v)
    e0 = F.floor(F.log2(a))
    # correct the float log2 by at most one in either direction
    e1 = F.when(F.pow(F.lit(2.0), e0) > a, e0 - 1).otherwise(e0)
    e = F.when(F.pow(F.lit(2.0), e1 + 1) <= a, e1 + 1).otherwise(e1)
    mant = ((a / F.pow(F.lit(2.0), e) - 1.0) * _TWO52).cast("long")  # exact: scaling by powers of two
    normal_bits = F.shiftleft((e + 1023).cast("long"), 52).bitwiseOR(mant)
    subnormal_bits = (a * (2.0 ** 1022) * _TWO52).cast("long")
    inf_bits = F.lit(2047 << 52).cast("long")
    bits = (F.when(a == 0, F.lit(0).cast("long"))
            .when(F.isnan(a), inf_bits + 1)
            .when(a == float("inf"), inf_bits)
            .when(a < _MIN_NORMAL, subnormal_bits)
            .otherwise(normal_bits))
    return F.when(v < 0, -bits).otherwise(bits)


def median(df: DataFrame, keys: Sequence[str], value: str, out_name: str = "MEDIAN",
           stats: dict[str, str] | None = None, approx: float | None = None) -> DataFrame:
    """Median of ``value`` per group: exact, or with ``approx`` from a sketch whose rank error is at most that share."""
    if approx is None:
        return exact_median(df, keys, value, out_name, stats)
    return approx_median(df, keys, value, approx, out_name, stats)


def approx_median(df: DataFrame, keys: Sequence[str], value: str, rank_error: float, out_name: str = "MEDIAN",
                  stats: dict[str, str] | None = None) -> DataFrame:
    """One row per group: a value of the group whose rank is within ``rank_error * n`` (and one) of the middle.

    A mergeable quantile sketch per task and group, merged after the shuffle: one pass, one
    exchange of sketches of about ``1 / rank_error`` values each, whatever the group's size.
    NULL values are ignored; NaN ranks and comes out as infinity; groups without values are
    absent.  ``stats`` as in ``exact_median``, over the same values."""
    if not 0 < rank_error < 1:
        raise ValueError("rank_error is a share between 0 and 1")
    v = F.col(value).cast("double")
    rows = df.select(*keys, F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v).alias("__v")).filter(F.col("__v").isNotNull())
    pick = {"count": F.count("__v"), "sum": F.sum("__v"), "min": F.min("__v"), "max": F.max("__v"), "avg": F.avg("__v")}
    return rows.groupBy(*keys).agg(F.percentile_approx("__v", 0.5, math.ceil(1 / rank_error)).alias(out_name),
                                   *[pick[kind].alias(name) for name, kind in (stats or {}).items()])


def rank_within(df: DataFrame, keys: Sequence[str], value: str, medians: DataFrame, median_name: str, rank_error: float,
                out_name: str = "WITHIN_RANK_ERROR") -> DataFrame:
    """Per group: whether ``median_name`` of ``medians`` (one row per group) stands within ``rank_error * n`` ranks
    (and one) of the middle of the group's values."""
    m = medians.select(*[F.col(k).alias(f"__m_{k}") for k in keys], F.col(median_name).alias("__m"))
    same = [F.col(k).eqNullSafe(F.col(f"__m_{k}")) for k in keys]
    v = F.col(value).cast("double")
    counted = df.filter(v.isNotNull()).join(m, same).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.count(F.when(v < F.col("__m"), 1)).alias("__below"), F.count(F.when(v <= F.col("__m"), 1)).alias("__upto"))
    near = F.col("__n") * rank_error + 1
    half = F.col("__n") / 2
    return counted.select(*keys, ((F.col("__below") <= half + near) & (F.col("__upto") >= half - near)).alias(out_name))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out_name: str = "MEDIAN",
                 stats: dict[str, str] | None = None) -> DataFrame:
    """One row per group of ``keys``: ``out_name`` = exact median of ``value``
    (linear interpolation of the two middle values, like PERCENTILE_CONT(0.5)).
    NULL values are ignored, NaN counts as the largest value as in the engine's
    own aggregates; groups without values are absent.

    ``stats`` optionally adds group statistics of the same values, read off the
    counts at no extra pass: ``{"N": "count", "S": "sum", "LO": "min",
    "HI": "max", "MEAN": "avg"}`` (any subset, any names)."""
    keys = list(keys)
    stats = dict(stats or {})
    counted = (df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
               .groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
               # flip the sign bit: unsigned order of __u == order of the values
               .withColumn("__u", sortable_key(F.col("__v")).bitwiseXOR(F.lit(-(1 << 63)))))
    out = df.sparkSession.sql(_radix_sql(keys), counted=counted)
    a, b = F.col("__a"), F.col("__b")
    middle = F.when((F.col("__n") % 2 == 1) | (a == b), a).otherwise(a + (b - a) * 0.5)
    pick = {"count": F.col("__n"), "sum": F.col("__stats.sum"), "min": F.col("__stats.min"),
            "max": F.col("__stats.max"), "avg": F.col("__stats.sum") / F.col("__n")}
    return out.select(*keys, middle.alias(out_name), *[pick[kind].alias(name) for name, kind in stats.items()])


def _radix_sql(keys: Sequence[str]) -> str:
    d1, d2, d3 = _DIGITS
    k = ", ".join(f"`{c}`" for c in keys)
    bk = ", ".join(f"b.`{c}`" for c in keys)
    on = " AND ".join(f"b.`{c}` <=> c.`{c}`" for c in keys)
    run = f"sum(__c) OVER (PARTITION BY {k}, __t ORDER BY __d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    hit = "__cum - __c < __r AND __r <= __cum"
    return f"""
WITH h1 AS (
  SELECT {k}, shiftrightunsigned(__u, {d2 + d3}) AS __d, sum(__c) AS __c,
         sum(__v * __c) AS __s, min(__v) AS __lo, max(__v) AS __hi
  FROM {{counted}} GROUP BY {k}, shiftrightunsigned(__u, {d2 + d3})
),
h1n AS (
  SELECT h1.*, sum(__c) OVER (PARTITION BY {k}) AS __n,
         named_struct('sum', sum(__s) OVER (PARTITION BY {k}), 'min', min(__lo) OVER (PARTITION BY {k}),
                      'max', max(__hi) OVER (PARTITION BY {k})) AS __stats
  FROM h1
),
h1t AS (
  SELECT h1n.*, tr.t AS __t, tr.r AS __r FROM h1n
  LATERAL VIEW explode(array(named_struct('t', 1, 'r', floor((__n - 1) / 2) + 1),
                             named_struct('t', 2, 'r', ceil((__n - 1) / 2) + 1))) x AS tr
),
c1 AS (
  SELECT {k}, __n, __stats, __t, __d AS __p, __r - (__cum - __c) AS __r
  FROM (SELECT h1t.*, {run} AS __cum FROM h1t) WHERE {hit}
),
l2 AS (
  SELECT {bk}, c.__n, c.__stats, c.__t, c.__p, c.__r,
         shiftrightunsigned(b.__u, {d3}) & {(1 << d2) - 1} AS __d, sum(b.__c) AS __c
  FROM {{counted}} b JOIN c1 c ON {on} AND shiftrightunsigned(b.__u, {d2 + d3}) <=> c.__p
  GROUP BY {bk}, c.__n, c.__stats, c.__t, c.__p, c.__r, shiftrightunsigned(b.__u, {d3}) & {(1 << d2) - 1}
),
c2 AS (
  SELECT {k}, __n, __stats, __t, shiftleft(__p, {d2}) | __d AS __p, __r - (__cum - __c) AS __r
  FROM (SELECT l2.*, {run} AS __cum FROM l2) WHERE {hit}
),
l3 AS (
  SELECT {bk}, c.__n, c.__stats, c.__t, c.__r, b.__u AS __d, sum(b.__c) AS __c, min(b.__v) AS __val
  FROM {{counted}} b JOIN c2 c ON {on} AND shiftrightunsigned(b.__u, {d3}) <=> c.__p
  GROUP BY {bk}, c.__n, c.__stats, c.__t, c.__r, b.__u
),
vals AS (SELECT {k}, __n, __stats, __t, __val FROM (SELECT l3.*, {run} AS __cum FROM l3) WHERE {hit})
SELECT {k}, max(CASE WHEN __t = 1 THEN __val END) AS __a, max(CASE WHEN __t = 2 THEN __val END) AS __b,
       first(__n) AS __n, first(__stats) AS __stats
FROM vals GROUP BY {k}
"""
