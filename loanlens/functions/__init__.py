"""Column expressions: banding ladders, guarded ratios, conditional aggregates."""

from . import bands
from .bands import Ladder, band, label_rank
from .columns import (
    all_of,
    avg_where,
    count_where,
    not_null,
    pct,
    rate,
    ratio_at_most,
    safe_ratio,
    share_pct,
    sum_cols,
    sum_where,
    thousands,
    with_unit,
    years_from_days,
)

__all__ = [
    "bands", "Ladder", "band", "label_rank", "all_of", "avg_where", "count_where",
    "not_null", "pct", "rate", "ratio_at_most", "safe_ratio", "share_pct", "sum_cols",
    "sum_where", "thousands", "with_unit", "years_from_days",
]
