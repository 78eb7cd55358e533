"""Banding ladders and score ladders, declared once as data.

A ladder is an ordered list of ``(op, bound, label)`` rules plus an ``otherwise``
label.  :func:`band` turns it into one chained ``CASE WHEN`` column: the first
matching rule wins, and a NULL input (every comparison is NULL) falls through to
``otherwise`` - exactly the SQL ``CASE ... ELSE`` semantics.

Supported ops: ``"<="``, ``"<"``, ``">="``, ``">"``, ``"=="`` and ``"between"``
(``bound`` is a ``(lo, hi)`` pair, both ends inclusive).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Any, Any]


def _predicate(value: Column, op: str, bound: Any) -> Column:
    if op == "<=":
        return value <= bound
    if op == "<":
        return value < bound
    if op == ">=":
        return value >= bound
    if op == ">":
        return value > bound
    if op == "==":
        return value == bound
    if op == "between":
        lo, hi = bound
        return value.between(lo, hi)
    raise ValueError(f"unknown band op {op!r}")


def band(value: Column, rules: Sequence[Rule], otherwise: Any) -> Column:
    """First-match ladder over ``value``; NULL input lands in ``otherwise``."""
    if not rules:
        return F.lit(otherwise)
    expr = None
    for op, bound, label in rules:
        pred = _predicate(value, op, bound)
        expr = F.when(pred, F.lit(label)) if expr is None else expr.when(pred, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def label_rank(label_col: Column, labels: Sequence[str]) -> Column:
    """Sort key for labels in declared order; unknown labels sort last."""
    return band(label_col, [("==", lab, i + 1) for i, lab in enumerate(labels)], len(labels) + 1)


def labels_of(ladder: "Ladder") -> list[str]:
    return [lab for _, _, lab in ladder.rules] + [ladder.otherwise]


class Ladder:
    """A named ladder: ``rules`` then ``otherwise``."""

    def __init__(self, rules: Sequence[Rule], otherwise: Any):
        self.rules = list(rules)
        self.otherwise = otherwise

    def __call__(self, value: Column) -> Column:
        return band(value, self.rules, self.otherwise)

    @property
    def labels(self) -> list:
        return labels_of(self)


# ---------------------------------------------------------------------------
# FIXED VALUES - thresholds and labels must equal the source dashboard's byte for
# byte (labels contain the character "≤").  Stated plainly, in rule order.
# ---------------------------------------------------------------------------

# B1 age distribution (whole years, inclusive ranges; under 18 falls to the last label)
AGE_DISTRIBUTION = Ladder(
    [
        ("between", (18, 25), "18-25 (Young Adults)"),
        ("between", (26, 35), "26-35 (Young Professionals)"),
        ("between", (36, 45), "36-45 (Established Adults)"),
        ("between", (46, 55), "46-55 (Middle-aged)"),
        ("between", (56, 65), "56-65 (Pre-retirement)"),
    ],
    "65+ (Senior Citizens)",
)

# B2 age group of the wide risk table
AGE_GROUP_WIDE = Ladder(
    [
        ("<=", 25, "Young (18-25)"),
        ("<=", 35, "Young Professional (26-35)"),
        ("<=", 45, "Established Adult (36-45)"),
        ("<=", 55, "Middle-aged (46-55)"),
        ("<=", 65, "Pre-retirement (56-65)"),
    ],
    "Senior (65+)",
)

# B3 age group of the slim risk table
AGE_GROUP_SLIM = Ladder(
    [
        ("between", (18, 30), "Young (18-30)"),
        ("between", (31, 45), "Prime (31-45)"),
        ("between", (46, 60), "Mature (46-60)"),
    ],
    "Senior (60+)",
)

# B4 income level / income bracket
INCOME_LEVEL = Ladder(
    [
        ("<=", 100000, "Low Income (≤100K)"),
        ("<=", 200000, "Lower Middle (100K-200K)"),
        ("<=", 300000, "Middle Income (200K-300K)"),
        ("<=", 500000, "Upper Middle (300K-500K)"),
        ("<=", 1000000, "High Income (500K-1M)"),
    ],
    "Very High Income (1M+)",
)

# B5 income category of the slim risk table
INCOME_CATEGORY = Ladder(
    [
        ("<=", 150000, "Low Income"),
        ("<=", 300000, "Middle Income"),
    ],
    "High Income",
)

# B6 loan (credit) size
CREDIT_SIZE = Ladder(
    [
        ("<=", 200000, "Small Loans (≤200K)"),
        ("<=", 500000, "Medium Loans (200K-500K)"),
        ("<=", 1000000, "Large Loans (500K-1M)"),
        ("<=", 2000000, "Very Large Loans (1M-2M)"),
    ],
    "Jumbo Loans (2M+)",
)

# B7 size of an earlier application
APPLICATION_SIZE = Ladder(
    [
        ("<=", 200000, "Small (≤200K)"),
        ("<=", 500000, "Medium (200K-500K)"),
        ("<=", 1000000, "Large (500K-1M)"),
    ],
    "Very Large (1M+)",
)

# B8 credit to income ratio
CREDIT_RISK_LEVEL = Ladder(
    [
        ("<=", 1, "Conservative (≤1x Income)"),
        ("<=", 2, "Moderate (1-2x Income)"),
        ("<=", 3, "Aggressive (2-3x Income)"),
    ],
    "Very Aggressive (3x+ Income)",
)

# B9 depth of bureau credit history
CREDIT_HISTORY = Ladder(
    [
        ("==", 0, "No Credit History"),
        ("<=", 2, "Limited History (1-2)"),
        ("<=", 5, "Moderate History (3-5)"),
        ("<=", 10, "Extensive History (6-10)"),
    ],
    "Very Extensive (10+)",
)

# B10 bureau balance STATUS (string comparisons; ">= '2'" also catches 'X',
# so the three branches after it never fire - kept as written)
PAYMENT_STATUS = Ladder(
    [
        ("==", "C", "Paid Off (Closed)"),
        ("==", "0", "On Time (0 Days)"),
        ("==", "1", "Late 1-30 Days"),
        (">=", "2", "Late 30+ Days"),
        ("==", "3", "Late 61-90 Days"),
        ("==", "4", "Late 91-120 Days"),
        ("==", "5", "Late 120+ Days"),
    ],
    "Other Status",
)

# B11 credit utilization (debt / credit sum); "No Data" precedes the ladder
UTILIZATION_NO_DATA = "No Data"
UTILIZATION = Ladder(
    [
        ("<=", 0.1, "Very Low (0-10%)"),
        ("<=", 0.3, "Low (10-30%)"),
        ("<=", 0.5, "Moderate (30-50%)"),
        ("<=", 0.7, "High (50-70%)"),
        ("<=", 0.9, "Very High (70-90%)"),
    ],
    "Maxed Out (90%+)",
)

# B12 payment timing (entry day minus instalment day)
PAYMENT_TIMING = Ladder(
    [
        ("<=", -5, "Early (5+ days)"),
        ("<=", 0, "On Time"),
        ("<=", 5, "Slightly Late (1-5 days)"),
        ("<=", 15, "Late (6-15 days)"),
        ("<=", 30, "Very Late (16-30 days)"),
    ],
    "Severely Late (30+ days)",
)

# B13 payment ratio (paid / due)
PAYMENT_CATEGORY = Ladder(
    [
        (">=", 1.1, "Overpaid (10%+)"),
        (">=", 1.05, "Slightly Overpaid (5-10%)"),
        (">=", 0.95, "Paid as Expected"),
        (">=", 0.9, "Slightly Underpaid (5-10%)"),
    ],
    "Significantly Underpaid (10%+)",
)

# B14 number of children
CHILDREN = Ladder(
    [
        ("==", 0, "No Children"),
        ("==", 1, "1 Child"),
        ("==", 2, "2 Children"),
    ],
    "3+ Children",
)

# B15 number of earlier applications
PRIOR_APPLICATIONS = Ladder(
    [
        ("==", 0, "First Time Customer"),
        ("==", 1, "1 Previous Application"),
        ("between", (2, 3), "2-3 Previous Applications"),
        ("between", (4, 6), "4-6 Previous Applications"),
    ],
    "7+ Previous Applications",
)

# B16 gender code
GENDER = Ladder(
    [
        ("==", "M", "Male"),
        ("==", "F", "Female"),
    ],
    "Not Specified",
)

# B17 total risk score
RISK_CATEGORY = Ladder(
    [
        ("<=", 3, "Low Risk"),
        ("<=", 6, "Medium Risk"),
        ("<=", 9, "High Risk"),
    ],
    "Very High Risk",
)

# R1..R5 additive scorecard (integer points, 0 when no rule matches)
AGE_RISK = Ladder([("<=", 25, 3), ("<=", 35, 2), ("<=", 50, 1)], 0)
INCOME_RISK = Ladder([("<=", 100000, 3), ("<=", 200000, 2), ("<=", 400000, 1)], 0)
CREDIT_RATIO_RISK = Ladder([(">=", 3, 3), (">=", 2, 2), (">=", 1.5, 1)], 0)
CREDIT_HISTORY_RISK = Ladder([("==", 0, 3), ("<=", 2, 2), ("<=", 5, 1)], 0)
# R5 reads two columns: no earlier application -> 1, else by approval rate
PREV_APP_RISK_FIRST_TIME = 1
PREV_APP_RISK_BY_APPROVAL = Ladder([("<", 50, 3), ("<", 80, 2)], 0)

# Other fixed values
EMPLOYMENT_SENTINEL_DAYS = 365243  # DAYS_EMPLOYED value meaning "not employed"
DAYS_PER_YEAR = 365.25
