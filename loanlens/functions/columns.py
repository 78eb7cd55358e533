"""Column-level helpers (all built-in, JVM-side expressions, no UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bands import DAYS_PER_YEAR


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def years_from_days(days: Column | str, sentinel: int | None = None, sentinel_value=0) -> Column:
    """Whole years in a day count: ``floor(|days| / 365.25)`` as bigint.

    With ``sentinel``, a day count ``>= sentinel`` or NULL yields ``sentinel_value``
    (the EMPLOYMENT_YEARS rule); without it NULL stays NULL (the AGE rule).
    """
    d = _c(days)
    years = F.floor(F.abs(d) / F.lit(DAYS_PER_YEAR))
    if sentinel is None:
        return years
    return F.when(d < sentinel, years).otherwise(F.lit(sentinel_value))


def safe_ratio(num: Column | str, den: Column | str, default=0, *, require_not_null: bool = False) -> Column:
    """``num / den`` when ``den > 0`` (and, optionally, ``num`` known), else ``default``."""
    n, d = _c(num), _c(den)
    cond = d > 0
    if require_not_null:
        cond = d.isNotNull() & cond & n.isNotNull()
    return F.when(cond, n / d).otherwise(F.lit(default))


def pct(part: Column | str, whole: Column | str, default=0) -> Column:
    """``part / whole * 100`` when ``whole > 0`` else ``default`` (unrounded)."""
    p, w = _c(part), _c(whole)
    return F.when(w > 0, p / w * 100).otherwise(F.lit(default))


def rate(flag: Column | str, digits: int = 2) -> Column:
    """Aggregate: ``round(avg(flag) * 100, digits)`` - a default rate in percent."""
    return F.round(F.avg(_c(flag)) * 100, digits)


def count_where(pred: Column) -> Column:
    """Aggregate: number of rows where ``pred`` is true (bigint)."""
    return F.count_if(pred)


def sum_where(pred: Column, value: Column | str, otherwise=0) -> Column:
    """Aggregate: ``sum(CASE WHEN pred THEN value ELSE otherwise END)``."""
    return F.sum(F.when(pred, _c(value)).otherwise(F.lit(otherwise)))


def avg_where(pred: Column, value: Column | str) -> Column:
    """Aggregate: average of ``value`` over rows where ``pred``; NULL if none."""
    return F.avg(F.when(pred, _c(value)))


def share_pct(part: Column | str, total: Column | str, digits: int = 2) -> Column:
    """``round(part * 100 / total, digits)``; NULL (not an error) when total is 0."""
    return F.round(F.try_divide(_c(part) * F.lit(100.0), _c(total)), digits)


def sum_cols(*cols: Column | str) -> Column:
    """Row-wise sum of several columns."""
    return reduce(lambda a, b: a + b, [_c(c) for c in cols])


def all_of(*preds: Column) -> Column:
    """Conjunction of predicates (``TRUE`` when none given)."""
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def not_null(*cols: str) -> Column:
    """All named columns are non-NULL."""
    return all_of(*[F.col(c).isNotNull() for c in cols])


def ratio_at_most(num: Column | str, den: Column | str, limit) -> Column:
    """``den > 0 AND num / den <= limit``; the division can never raise."""
    n, d = _c(num), _c(den)
    return (d > 0) & (F.try_divide(n, d) <= limit)


def thousands(value: Column | str, digits: int = 0) -> Column:
    """Thousands-separated text (``format_number``; half-even rounding)."""
    return F.format_number(_c(value), digits)


def with_unit(value: Column, unit: str) -> Column:
    """Number rendered as text followed by a unit suffix, e.g. ``8.07%``."""
    return F.concat(value.cast("string"), F.lit(unit))
