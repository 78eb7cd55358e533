"""DataFrame -> DataFrame operators; all lazy, all planned by Catalyst."""

from .aggregate import ALL_ROWS, SAME, completeness, kpi_long, rollup_by, share, share_within, top_k
from .filters import drop_null, in_range, keep_range, min_group
from .joins import attach_features
from .median import approx_median, exact_median, median, rank_within

__all__ = [
    "ALL_ROWS", "SAME", "completeness", "kpi_long", "rollup_by", "share", "share_within", "top_k",
    "drop_null", "in_range", "keep_range", "min_group", "attach_features", "exact_median",
    "approx_median", "median", "rank_within",
]
