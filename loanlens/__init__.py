"""loanlens - lending-risk portfolio analytics as Spark DataFrame plans.

Layers: ``sources`` (CSV / fixture tables, sinks), ``functions`` (band ladders,
guarded ratios), ``operators`` (share of total, roll-ups, exact median, ...),
``plans`` (cleaners, features, risk tables, reports) and ``streaming``
(incremental bronze-to-silver cleaning).
"""

from .plans.context import LendingData

__all__ = ["LendingData"]
__version__ = "0.1.0"
