"""Attach customer-grain feature tables to the application table.

Every feature table has one row per key, so a left outer equi-join keeps the
application row count.  No join hint: the roll-ups come out of their aggregate
already hash-partitioned by the key, so the sort-merge joins reuse that layout
and only the application side is shuffled once; AQE switches a side to a
broadcast at run time when its measured size is under the threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def attach_features(base: DataFrame, key: str, features: Sequence[DataFrame],
                    defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Left-join each feature frame on ``key`` (USING form: one key column kept),
    then fill NULLs (and NaN) in the ``defaults`` columns with their values."""
    out = base
    for feat in features:
        out = out.join(feat, key, "left")
    if defaults:
        out = out.fillna(dict(defaults))
    return out
