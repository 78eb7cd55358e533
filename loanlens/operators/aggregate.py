"""Aggregation operators: roll-ups, share of total, window shares, top-k,
long-form KPI rows and column completeness.

Design notes for scale
----------------------
* Every grouping here is a plain ``groupBy().agg()`` so Spark runs a partial
  (map-side) HashAggregate before the exchange: a key that holds a third of all
  rows is pre-combined on every mapper and never reaches one task whole.
* Shares of total take the total from the *grouped* rows, as a scalar subquery
  over their sum: it reads the same exchange as the report itself, so the input
  is scanned once, and no task holds all groups, however many there are.
  ``total="window"`` computes it with an unpartitioned window instead (one task
  sees every group: for a handful of bands only).
* Several metrics over one table are one aggregate followed by ``inline`` of an
  array of structs (one scan, one exchange) instead of a UNION ALL of k
  aggregates (k scans, k exchanges).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import share_pct

SAME = "same"  # denominator predicate equals the outer filter
ALL_ROWS = None  # denominator counts every row

AggBuilder = Callable[[Callable[[Column], Column]], list[Column]]


def rollup_by(df: DataFrame, key: str | Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """One row per key: ``groupBy(key).agg(*aggs)``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(*aggs)


def _identity(c: Column) -> Column:
    return c


def share(
    df: DataFrame,
    keys: Sequence[str | Column],
    *,
    where: Column | None = None,
    total_where: Column | str | None = SAME,
    count_name: str = "COUNT",
    pct_name: str = "PERCENTAGE",
    aggs: AggBuilder | None = None,
    digits: int = 2,
    total: str = "scalar",
) -> DataFrame:
    """Group, count and express each group's count as a percent of a total.

    ``where`` is the outer filter: only those rows are counted and aggregated.
    ``total_where`` is the predicate of the denominator: ``SAME`` (default) =
    ``where``; ``ALL_ROWS`` (``None``) = every row of ``df``; or any Column.

    ``aggs`` builds the other aggregates; it receives ``only`` and must wrap each
    aggregated input in it (``F.avg(only(F.col("x")))``) so that, when the
    denominator is wider than the outer filter, rows outside ``where`` do not
    leak into them.

    Result columns: the keys, ``count_name``, ``pct_name`` and the ``aggs``.
    """
    build = aggs or (lambda only: [])
    same = isinstance(total_where, str) and total_where == SAME
    if same or (where is None and total_where is None):
        base = df if where is None else df.filter(where)
        grouped = base.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name), *build(_identity))
        all_col = count_name
    else:
        kept = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        in_total = F.lit(True) if total_where is None else F.coalesce(total_where, F.lit(False))
        base = df if total_where is None or where is None else df.filter(kept | in_total)

        def only(c: Column) -> Column:
            return F.when(kept, c)

        grouped = base.groupBy(*keys).agg(
            F.count_if(kept).alias(count_name),
            F.count_if(in_total).alias("__all"),
            *build(only),
        )
        all_col = "__all"

    if total == "window":
        tot = F.sum(all_col).over(Window.partitionBy())
    elif total == "scalar":
        tot = grouped.select(F.sum(all_col)).scalar()
    else:
        raise ValueError("total must be 'scalar' or 'window'")
    out = grouped.withColumn(pct_name, share_pct(F.col(count_name), tot, digits))
    if all_col != count_name:
        out = out.filter(F.col(count_name) > 0).drop(all_col)
    return out


def share_within(df: DataFrame, partition: Sequence[str], count_col: str, pct_name: str = "PERCENTAGE",
                 digits: int = 2) -> DataFrame:
    """Percent of ``count_col`` within each ``partition`` group (a window sum
    over already aggregated rows, e.g. ``SUM(COUNT(*)) OVER (PARTITION BY band)``)."""
    w = Window.partitionBy(*partition)
    return df.withColumn(pct_name, share_pct(F.col(count_col), F.sum(count_col).over(w), digits))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``ORDER BY ... LIMIT k``; planned as TakeOrderedAndProject (each task keeps
    only its k best rows).  Give a full tiebreak in ``order`` so the cut is stable."""
    return df.orderBy(*order).limit(k)


def kpi_long(row: DataFrame, metrics: Sequence[tuple[str, Column, dict]], name_col: str = "METRIC",
             value_col: str = "VALUE") -> DataFrame:
    """Turn one aggregate row into long form, one output row per metric.

    ``metrics`` holds ``(metric_name, value_expr, extra_columns)``; ``value_expr``
    and Column extras are evaluated over the aggregate row, other extras are literals.  Planned as Generate(inline) over a
    single aggregate: one scan and one exchange for all metrics.
    """
    structs = []
    for name, value, extra in metrics:
        fields = [F.lit(name).alias(name_col), value.alias(value_col)]
        fields += [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in extra.items()]
        structs.append(F.struct(*fields))
    return row.select(F.inline(F.array(*structs)))


def completeness(df: DataFrame, columns: Sequence[str], digits: int = 1) -> DataFrame:
    """Non-NULL count and percent per named column, from one aggregate.

    Columns: FEATURE, NON_NULL_COUNT, TOTAL_ROWS, COMPLETENESS_PCT.
    """
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(F.col(c)).alias(f"__c{i}") for i, c in enumerate(columns)]
    row = df.agg(*aggs)
    structs = [
        F.struct(
            F.lit(c).alias("FEATURE"),
            F.col(f"__c{i}").alias("NON_NULL_COUNT"),
            F.col("__n").alias("TOTAL_ROWS"),
            share_pct(F.col(f"__c{i}"), F.col("__n"), digits).alias("COMPLETENESS_PCT"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*structs)))
