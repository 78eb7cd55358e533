"""Pipeline plans: cleaners, feature roll-ups, risk tables, reports, quality checks."""

from . import clean, features, quality, reports, risk
from .context import LendingData

__all__ = ["clean", "features", "quality", "reports", "risk", "LendingData"]
