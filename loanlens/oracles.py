"""Independent SQL oracle (DuckDB dialect) for every registered query.

The lending tables are derived from the benchmark views with the mapping of FIXTURES.md
section 2, and cleaned and rolled up in common table expressions.  The reports are built from
their specification by a few helpers: count by key, share of a total, rate by group.  The
bands are stated once, as plain ladders, and apart from ``functions/bands.py``, so that a wrong
threshold on one side shows up as a mismatch.

Types follow Spark: counts are BIGINT, ratios and averages DOUBLE, whole years BIGINT.  Row
order is not part of a result unless the report cuts rows.  ``+ 0.0`` after a round turns
DuckDB's -0.0 into the 0.0 that Spark returns.
"""

from __future__ import annotations

import re

R6 = 6  # digits kept of unrounded doubles in table-level checks

# ---------------------------------------------------------------------------
# FIXED VALUES - bands and scores: (bound, label) in order, and the label of the rest.
# ---------------------------------------------------------------------------

WIDE_AGE = [(25, "Young (18-25)"), (35, "Young Professional (26-35)"), (45, "Established Adult (36-45)"),
            (55, "Middle-aged (46-55)"), (65, "Pre-retirement (56-65)")], "Senior (65+)"
AGE_DISTRIBUTION = [((18, 25), "18-25 (Young Adults)"), ((26, 35), "26-35 (Young Professionals)"),
                    ((36, 45), "36-45 (Established Adults)"), ((46, 55), "46-55 (Middle-aged)"),
                    ((56, 65), "56-65 (Pre-retirement)")], "65+ (Senior Citizens)"
SLIM_AGE = [((18, 30), "Young (18-30)"), ((31, 45), "Prime (31-45)"), ((46, 60), "Mature (46-60)")], "Senior (60+)"
INCOME = [(100000, "Low Income (≤100K)"), (200000, "Lower Middle (100K-200K)"), (300000, "Middle Income (200K-300K)"),
          (500000, "Upper Middle (300K-500K)"), (1000000, "High Income (500K-1M)")], "Very High Income (1M+)"
SLIM_INCOME = [(150000, "Low Income"), (300000, "Middle Income")], "High Income"
CREDIT_SIZE = [(200000, "Small Loans (≤200K)"), (500000, "Medium Loans (200K-500K)"), (1000000, "Large Loans (500K-1M)"),
               (2000000, "Very Large Loans (1M-2M)")], "Jumbo Loans (2M+)"
APPLICATION_SIZE = [(200000, "Small (≤200K)"), (500000, "Medium (200K-500K)"), (1000000, "Large (500K-1M)")], "Very Large (1M+)"
CREDIT_TO_INCOME = [(1, "Conservative (≤1x Income)"), (2, "Moderate (1-2x Income)"), (3, "Aggressive (2-3x Income)")], "Very Aggressive (3x+ Income)"
HISTORY = [(0, "No Credit History"), (2, "Limited History (1-2)"), (5, "Moderate History (3-5)"), (10, "Extensive History (6-10)")], "Very Extensive (10+)"
UTILIZATION = [(0.1, "Very Low (0-10%)"), (0.3, "Low (10-30%)"), (0.5, "Moderate (30-50%)"), (0.7, "High (50-70%)"),
               (0.9, "Very High (70-90%)")], "Maxed Out (90%+)"
TIMING = [(-5, "Early (5+ days)"), (0, "On Time"), (5, "Slightly Late (1-5 days)"), (15, "Late (6-15 days)"),
          (30, "Very Late (16-30 days)")], "Severely Late (30+ days)"
VARIANCE = [(1.1, "Overpaid (10%+)"), (1.05, "Slightly Overpaid (5-10%)"), (0.95, "Paid as Expected"),
            (0.9, "Slightly Underpaid (5-10%)")], "Significantly Underpaid (10%+)"
PRIOR = [((0, 0), "First Time Customer"), ((1, 1), "1 Previous Application"), ((2, 3), "2-3 Previous Applications"),
         ((4, 6), "4-6 Previous Applications")], "7+ Previous Applications"
CHILDREN = [((0, 0), "No Children"), ((1, 1), "1 Child"), ((2, 2), "2 Children")], "3+ Children"
GENDER = [(("M", "M"), "Male"), (("F", "F"), "Female")], "Not Specified"
AGE_SCORE = [(25, 3), (35, 2), (50, 1)], 0
INCOME_SCORE = [(100000, 3), (200000, 2), (400000, 1)], 0
RATIO_SCORE = [(3, 3), (2, 2), (1.5, 1)], 0
HISTORY_SCORE = [(0, 3), (2, 2), (5, 1)], 0
RISK_CATEGORY = [(3, "Low Risk"), (6, "Medium Risk"), (9, "High Risk")], "Very High Risk"
# a later status also passes the text test >= '2', so the labels of 3, 4 and 5 never show
STATUS = [("= 'C'", "Paid Off (Closed)"), ("= '0'", "On Time (0 Days)"), ("= '1'", "Late 1-30 Days"), (">= '2'", "Late 30+ Days"),
          ("= '3'", "Late 61-90 Days"), ("= '4'", "Late 91-120 Days"), ("= '5'", "Late 120+ Days")], "Other Status"
# FIXED VALUES - columns by table: text columns end in "$"; types of the raw ones.
APPLICATION_TYPES = {"SK_ID_CURR": "bigint", "TARGET": "int", "CODE_GENDER": "string", "DAYS_BIRTH": "int", "DAYS_EMPLOYED": "int",
                     "AMT_INCOME_TOTAL": "double", "AMT_CREDIT": "double", "AMT_ANNUITY": "double", "NAME_CONTRACT_TYPE": "string",
                     "NAME_INCOME_TYPE": "string", "NAME_EDUCATION_TYPE": "string", "NAME_FAMILY_STATUS": "string",
                     "OCCUPATION_TYPE": "string", "CNT_CHILDREN": "int"}
RAW_TYPES = {
    "application_train": APPLICATION_TYPES,
    "application_test": {c: t for c, t in APPLICATION_TYPES.items() if c != "TARGET"},
    "bureau": {"SK_ID_CURR": "bigint", "SK_ID_BUREAU": "bigint", "CREDIT_ACTIVE": "string", "CREDIT_TYPE": "string",
               "AMT_CREDIT_SUM": "double", "AMT_CREDIT_SUM_DEBT": "double", "DAYS_CREDIT": "int"},
    "bureau_balance": {"SK_ID_BUREAU": "bigint", "MONTHS_BALANCE": "int", "STATUS": "string"},
    "previous_application": {"SK_ID_CURR": "bigint", "SK_ID_PREV": "bigint", "NAME_CONTRACT_STATUS": "string",
                             "CODE_REJECT_REASON": "string", "AMT_APPLICATION": "double", "AMT_CREDIT": "double", "DAYS_DECISION": "int"},
    "pos_cash_balance": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
                         "p_retailprice": "double"},
    "installments_payments": {"SK_ID_CURR": "bigint", "SK_ID_PREV": "bigint", "AMT_INSTALMENT": "double", "AMT_PAYMENT": "double",
                              "DAYS_INSTALMENT": "int", "DAYS_ENTRY_PAYMENT": "int"},
    "credit_card_balance": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
}
# FIXED VALUES - columns of the stored tables: True for numbers.
STORED = {
    "region": {"r_regionkey": True, "r_name": False},
    "nation": {"n_nationkey": True, "n_name": False, "n_regionkey": True},
    "customer": {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False},
    "supplier": {"s_suppkey": True, "s_name": False, "s_nationkey": True, "s_acctbal": True},
    "part": {"p_partkey": True, "p_name": False, "p_brand": False, "p_type": False, "p_size": True, "p_retailprice": True},
    "orders": {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "o_orderdate": False, "o_orderpriority": False},
    "lineitem": {"l_orderkey": True, "l_partkey": True, "l_suppkey": True, "l_linenumber": True, "l_quantity": True, "l_extendedprice": True,
                 "l_discount": True, "l_tax": True, "l_returnflag": False, "l_linestatus": False, "l_shipdate": False},
    "events": {"event_id": True, "ts": False, "user_id": True, "event_type": False, "value": True, "props": False},
}
# FIXED VALUES - the column that identifies rows in a checksum.
ROW_KEYS = {"application_train": "SK_ID_CURR", "application_test": "SK_ID_CURR", "bureau": "SK_ID_BUREAU", "bureau_balance": "SK_ID_BUREAU",
            "previous_application": "SK_ID_PREV", "pos_cash_balance": "p_partkey", "installments_payments": "SK_ID_PREV",
            "credit_card_balance": "s_suppkey", "master_dataset": "SK_ID_CURR"}
RAW_SOURCE = {"application_train": "application_train_src", "application_test": "application_train_src", "bureau": "bureau_src",
              "bureau_balance": "bureau_balance_src", "previous_application": "previous_src", "pos_cash_balance": "part",
              "installments_payments": "installments_src", "credit_card_balance": "supplier"}
CLEAN_SOURCE = {"application_train": "app", "bureau": "bur", "bureau_balance": "bb", "previous_application": "prev",
                "installments_payments": "inst"}
ADDED_BY_CLEANING = {"application_train": ["AGE_YEARS", "CREDIT_INCOME_RATIO", "EMPLOYMENT_YEARS"], "bureau": ["CREDIT_UTILIZATION_RATIO"],
                     "bureau_balance": [], "previous_application": [], "installments_payments": ["PAYMENT_DIFFERENCE", "DAYS_LATE"]}
FILLED = {"b": ["BUREAU_CREDIT_COUNT", "ACTIVE_CREDIT_COUNT", "CLOSED_CREDIT_COUNT", "AVG_CREDIT_AMOUNT", "TOTAL_DEBT", "AVG_CREDIT_UTILIZATION"],
          "p": ["TOTAL_PREV_APPLICATIONS", "APPROVED_APPLICATIONS", "REFUSED_APPLICATIONS", "CANCELED_APPLICATIONS", "APPROVAL_RATE"],
          "y": ["TOTAL_PAYMENTS", "AVG_PAYMENT_DIFFERENCE", "AVG_DAYS_LATE", "LATE_PAYMENTS_COUNT", "LATE_PAYMENT_RATE"]}
UNFILLED = {"b": ["DAYS_LAST_CREDIT"], "p": ["AVG_PREV_APPLICATION_AMOUNT", "DAYS_LAST_DECISION"], "y": ["MAX_DAYS_LATE"]}
WIDE_BANDS = ["AGE_GROUP", "INCOME_LEVEL", "CREDIT_SIZE_CATEGORY", "CREDIT_RISK_LEVEL", "CREDIT_HISTORY_LEVEL"]
WIDE_DOUBLES = ["AVG_CREDIT_AMOUNT", "TOTAL_DEBT", "AVG_CREDIT_UTILIZATION", "AVG_PREV_APPLICATION_AMOUNT", "APPROVAL_RATE",
                "AVG_PAYMENT_DIFFERENCE", "AVG_DAYS_LATE", "LATE_PAYMENT_RATE"]
KEY_FEATURES = ["TARGET", "CODE_GENDER", "AGE_YEARS", "AMT_INCOME_TOTAL", "AMT_CREDIT", "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS",
                "BUREAU_CREDIT_COUNT", "TOTAL_PREV_APPLICATIONS", "CREDIT_INCOME_RATIO"]
SCORES = ["AGE_RISK_SCORE", "INCOME_RISK_SCORE", "CREDIT_RATIO_RISK_SCORE", "CREDIT_HISTORY_RISK_SCORE", "PREV_APP_RISK_SCORE"]


# ---------------------------------------------------------------------------
# Helpers that write SQL
# ---------------------------------------------------------------------------

def _lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def case(tests: list[tuple[str, object]], rest) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {_lit(v)}" for t, v in tests) + f" ELSE {_lit(rest)} END"


def up_to(x: str, ladder) -> str:
    return case([(f"{x} <= {bound}", v) for bound, v in ladder[0]], ladder[1])


def at_least(x: str, ladder) -> str:
    return case([(f"{x} >= {bound}", v) for bound, v in ladder[0]], ladder[1])


def within(x: str, ladder) -> str:
    return case([(f"{x} BETWEEN {_lit(a)} AND {_lit(b)}", v) for (a, b), v in ladder[0]], ladder[1])


def avg(x: str, digits: int = 0) -> str:
    return f"ROUND(AVG({x}), {digits})"


def percent(x: str, digits: int = 2) -> str:
    return f"ROUND(AVG({x}) * 100, {digits})"


def count_if(test: str) -> str:
    return f"COUNT(*) FILTER (WHERE {test})"


def select(names: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in names.items())


def by(source: str, keys: dict[str, str], counted: str, also: dict[str, str] | None = None, where: str = "", at_least_rows: int = 0) -> str:
    """Rows counted by key, with other aggregates."""
    sql = f"SELECT {select(keys)}, COUNT(*) AS {counted}" + "".join(f", {e} AS {n}" for n, e in (also or {}).items()) + f" FROM {source}"
    sql += f" WHERE {where}" if where else ""
    return sql + " GROUP BY ALL" + (f" HAVING COUNT(*) >= {at_least_rows}" if at_least_rows else "")


def share(grouped: str, counted: str, total: str, name: str = "PERCENTAGE") -> str:
    """A grouped count as percent of the number of rows of ``total``."""
    return f"SELECT g.*, ROUND(CAST(g.{counted} AS DOUBLE) * 100 / t.n, 2) AS {name} FROM ({grouped}) g, (SELECT COUNT(*) AS n FROM {total}) t"


def checksum(column: str, text: bool, key: str) -> str:
    """Sum over rows of the value as a whole number times the row's key, as digits."""
    value = f"('0x' || left(md5({column}), 7))::BIGINT" if text else f"(((floor(CAST({column} AS DOUBLE) * 1000 + 0.3183098861837907)::BIGINT % 2147483647) + 2147483647) % 2147483647)"
    return f"COALESCE(CAST(SUM({value} * (COALESCE((({key} % 1048576) + 1048576) % 1048576, 0) + 1)) AS VARCHAR), '0')"


def column_profile(table: str, source: str, columns: dict[str, bool]) -> list[str]:
    """Non-null count, least and greatest value and checksum of each column (True: text)."""
    number = lambda f, c, text: "CAST(NULL AS DOUBLE)" if text else f"ROUND(CAST({f}({c}) AS DOUBLE), {R6}) + 0.0"
    word = lambda f, c, text: f"{f}({c})" if text else "CAST(NULL AS VARCHAR)"
    return [f"SELECT '{table}' AS TABLE_NAME, '{c}' AS COLUMN_NAME, COUNT({c}) AS NON_NULL_COUNT, {number('MIN', c, t)} AS MIN_NUMBER, "
            f"{number('MAX', c, t)} AS MAX_NUMBER, {word('MIN', c, t)} AS MIN_TEXT, {word('MAX', c, t)} AS MAX_TEXT, {checksum(c, t, ROW_KEYS[table])} AS CHECKSUM FROM {source}"
            for c, t in columns.items()]


def _text(table: str) -> dict[str, bool]:
    return {c: t == "string" for c, t in RAW_TYPES[table].items()}


UNION = "\nUNION ALL\n"

# ---------------------------------------------------------------------------
# Tables, as common table expressions
# ---------------------------------------------------------------------------

CTES: dict[str, str] = {}

CTES["application_train_src"] = """
SELECT o_orderkey AS SK_ID_CURR,
  CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN (o_orderkey * 7919) % 100 < 8 THEN 1 ELSE 0 END AS TARGET,
  CASE WHEN c_nationkey = 0 THEN 'XNA' WHEN c_nationkey % 3 = 1 THEN 'M' ELSE 'F' END AS CODE_GENDER,
  CAST(-(6575 + (o_orderkey * 37) % 19000) AS INTEGER) AS DAYS_BIRTH,
  CAST(CASE WHEN o_orderkey % 6 = 0 THEN 365243 ELSE -((o_orderkey * 13) % 15000) END AS INTEGER) AS DAYS_EMPLOYED,
  (c_acctbal + 1000.0) * 120.0 AS AMT_INCOME_TOTAL, o_totalprice * 5.0 AS AMT_CREDIT, o_totalprice * 0.25 AS AMT_ANNUITY,
  CASE WHEN o_orderkey % 10 = 0 THEN 'Revolving loans' ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE,
  c_mktsegment AS NAME_INCOME_TYPE, o_orderpriority AS NAME_EDUCATION_TYPE, r_name AS NAME_FAMILY_STATUS,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE n_name END AS OCCUPATION_TYPE, CAST(o_orderkey % 5 AS INTEGER) AS CNT_CHILDREN
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

CTES["bureau_src"] = """
SELECT l_orderkey AS SK_ID_CURR, l_orderkey * 100 + l_linenumber AS SK_ID_BUREAU,
  CASE l_returnflag WHEN 'A' THEN 'Active' WHEN 'N' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE,
  CASE l_linestatus WHEN 'F' THEN 'Consumer credit' ELSE 'Credit card' END AS CREDIT_TYPE,
  CASE WHEN l_quantity = 50.0 THEN NULL WHEN l_quantity = 49.0 THEN CAST(0.0 AS DOUBLE) ELSE l_extendedprice * 10.0 END AS AMT_CREDIT_SUM,
  CASE WHEN l_quantity = 48.0 THEN NULL ELSE l_extendedprice * 10.0 * l_discount * 10.0 END AS AMT_CREDIT_SUM_DEBT,
  CAST(-((l_partkey * 7 + l_linenumber) % 2900) AS INTEGER) AS DAYS_CREDIT
FROM lineitem
"""

CTES["previous_src"] = """
SELECT l_orderkey AS SK_ID_CURR, l_orderkey * 100 + l_linenumber AS SK_ID_PREV,
  CASE WHEN (l_partkey + l_linenumber) % 20 < 12 THEN 'Approved' WHEN (l_partkey + l_linenumber) % 20 < 16 THEN 'Refused'
       WHEN (l_partkey + l_linenumber) % 20 < 19 THEN 'Canceled' ELSE 'Unused offer' END AS NAME_CONTRACT_STATUS,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'R' || CAST(l_suppkey % 13 AS VARCHAR) END AS CODE_REJECT_REASON,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_extendedprice * 15.0 END AS AMT_APPLICATION,
  l_extendedprice * 13.5 AS AMT_CREDIT, CAST(-((l_partkey * 3 + l_linenumber) % 2922) AS INTEGER) AS DAYS_DECISION
FROM lineitem WHERE l_orderkey % 10 <> 0
"""

CTES["installments_src"] = """
SELECT l_orderkey AS SK_ID_CURR, l_orderkey * 100 + l_linenumber AS SK_ID_PREV, l_extendedprice AS AMT_INSTALMENT,
  CASE WHEN l_partkey % 61 = 0 THEN NULL ELSE l_extendedprice * (1.0 + 2.0 * l_tax - 2.0 * l_discount) END AS AMT_PAYMENT,
  CAST(-(l_partkey % 2900) AS INTEGER) AS DAYS_INSTALMENT,
  CAST(CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE -(l_partkey % 2900) + l_quantity - 12.0 END AS INTEGER) AS DAYS_ENTRY_PAYMENT
FROM lineitem
"""

CTES["bureau_balance_src"] = """
SELECT user_id AS SK_ID_BUREAU, CAST(-(event_id % 97) AS INTEGER) AS MONTHS_BALANCE,
  CASE event_id % 9 WHEN 0 THEN 'C' WHEN 1 THEN 'X' WHEN 2 THEN '0' WHEN 3 THEN '1' WHEN 4 THEN '2'
                    WHEN 5 THEN '3' WHEN 6 THEN '4' WHEN 7 THEN '5' ELSE NULL END AS STATUS
FROM events
"""

CTES["app"] = """
SELECT * REPLACE (abs(DAYS_BIRTH) AS DAYS_BIRTH, abs(DAYS_EMPLOYED) AS DAYS_EMPLOYED),
  CAST(floor(abs(DAYS_BIRTH) / 365.25) AS BIGINT) AS AGE_YEARS,
  CASE WHEN AMT_INCOME_TOTAL > 0 THEN AMT_CREDIT / AMT_INCOME_TOTAL ELSE 0 END AS CREDIT_INCOME_RATIO,
  CAST(CASE WHEN abs(DAYS_EMPLOYED) < 365243 THEN floor(abs(DAYS_EMPLOYED) / 365.25) ELSE 0 END AS BIGINT) AS EMPLOYMENT_YEARS
FROM application_train_src
WHERE TARGET IS NOT NULL AND AMT_INCOME_TOTAL BETWEEN 10000 AND 10000000 AND AMT_CREDIT BETWEEN 10000 AND 50000000
"""

CTES["bur"] = """
SELECT * REPLACE (abs(DAYS_CREDIT) AS DAYS_CREDIT),
  CASE WHEN AMT_CREDIT_SUM > 0 AND AMT_CREDIT_SUM_DEBT IS NOT NULL THEN AMT_CREDIT_SUM_DEBT / AMT_CREDIT_SUM ELSE 0 END AS CREDIT_UTILIZATION_RATIO
FROM bureau_src
WHERE SK_ID_CURR IS NOT NULL AND (AMT_CREDIT_SUM IS NULL OR AMT_CREDIT_SUM BETWEEN 0 AND 100000000)
"""

CTES["prev"] = """
SELECT * REPLACE (abs(DAYS_DECISION) AS DAYS_DECISION) FROM previous_src
WHERE SK_ID_CURR IS NOT NULL AND (AMT_APPLICATION IS NULL OR AMT_APPLICATION BETWEEN 0 AND 50000000)
"""

CTES["inst"] = """
SELECT *, AMT_PAYMENT - AMT_INSTALMENT AS PAYMENT_DIFFERENCE, DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS DAYS_LATE
FROM installments_src WHERE SK_ID_CURR IS NOT NULL AND AMT_PAYMENT IS NOT NULL AND AMT_INSTALMENT IS NOT NULL
"""

CTES["bb"] = "SELECT * FROM bureau_balance_src WHERE SK_ID_BUREAU IS NOT NULL"


def _rate(test: str, counted: str) -> str:
    return f"CASE WHEN COUNT({counted}) > 0 THEN CAST({count_if(test)} AS DOUBLE) / COUNT({counted}) * 100 ELSE 0 END"


def _per_customer(source: str, columns: dict[str, str]) -> str:
    return f"SELECT SK_ID_CURR, {select(columns)} FROM {source} GROUP BY SK_ID_CURR"


CTES["bureau_feat"] = _per_customer("bur", {
    "BUREAU_CREDIT_COUNT": "COUNT(SK_ID_BUREAU)", "ACTIVE_CREDIT_COUNT": count_if("CREDIT_ACTIVE = 'Active'"),
    "CLOSED_CREDIT_COUNT": count_if("CREDIT_ACTIVE = 'Closed'"), "AVG_CREDIT_AMOUNT": "AVG(AMT_CREDIT_SUM)",
    "TOTAL_DEBT": "SUM(AMT_CREDIT_SUM_DEBT)", "AVG_CREDIT_UTILIZATION": "AVG(CREDIT_UTILIZATION_RATIO)", "DAYS_LAST_CREDIT": "MAX(DAYS_CREDIT)"})
CTES["prev_feat"] = _per_customer("prev", {
    "TOTAL_PREV_APPLICATIONS": "COUNT(SK_ID_PREV)", "APPROVED_APPLICATIONS": count_if("NAME_CONTRACT_STATUS = 'Approved'"),
    "REFUSED_APPLICATIONS": count_if("NAME_CONTRACT_STATUS = 'Refused'"), "CANCELED_APPLICATIONS": count_if("NAME_CONTRACT_STATUS = 'Canceled'"),
    "AVG_PREV_APPLICATION_AMOUNT": "AVG(AMT_APPLICATION)", "DAYS_LAST_DECISION": "MAX(DAYS_DECISION)",
    "APPROVAL_RATE": _rate("NAME_CONTRACT_STATUS = 'Approved'", "SK_ID_PREV")})
CTES["pay_feat"] = _per_customer("inst", {
    "TOTAL_PAYMENTS": "COUNT(SK_ID_PREV)", "AVG_PAYMENT_DIFFERENCE": "AVG(PAYMENT_DIFFERENCE)", "AVG_DAYS_LATE": "AVG(DAYS_LATE)",
    "LATE_PAYMENTS_COUNT": count_if("DAYS_LATE > 0"), "MAX_DAYS_LATE": "MAX(DAYS_LATE)", "LATE_PAYMENT_RATE": _rate("DAYS_LATE > 0", "SK_ID_PREV")})

CTES["joined"] = (
    "SELECT a.*, " + ", ".join([f"COALESCE({t}.{c}, 0) AS {c}" for t, cs in FILLED.items() for c in cs] + [f"{t}.{c}" for t, cs in UNFILLED.items() for c in cs])
    + " FROM app a LEFT JOIN bureau_feat b USING (SK_ID_CURR) LEFT JOIN prev_feat p USING (SK_ID_CURR) LEFT JOIN pay_feat y USING (SK_ID_CURR)")
CTES["wide"] = "SELECT *, " + select({
    "AGE_GROUP": up_to("AGE_YEARS", WIDE_AGE), "INCOME_LEVEL": up_to("AMT_INCOME_TOTAL", INCOME),
    "CREDIT_SIZE_CATEGORY": up_to("AMT_CREDIT", CREDIT_SIZE), "CREDIT_RISK_LEVEL": up_to("CREDIT_INCOME_RATIO", CREDIT_TO_INCOME),
    "CREDIT_HISTORY_LEVEL": up_to("BUREAU_CREDIT_COUNT", HISTORY)}) + " FROM joined"

CTES["slim_bureau"] = _per_customer("bur", {
    "BUREAU_CREDITS": "COUNT(SK_ID_BUREAU)", "ACTIVE_CREDITS": count_if("CREDIT_ACTIVE = 'Active'"), "TOTAL_DEBT": "SUM(AMT_CREDIT_SUM_DEBT)"})
_APPROVED = count_if("NAME_CONTRACT_STATUS = 'Approved'")
CTES["slim_prev"] = _per_customer("prev", {
    "PREV_APPLICATIONS": "COUNT(SK_ID_PREV)",
    "RATE": f"ROUND(100.0 * CAST({_APPROVED} AS DOUBLE) / NULLIF(COUNT(SK_ID_PREV), 0), 2)"})
CTES["slim"] = "SELECT " + select({
    **{c: f"a.{c}" for c in ["SK_ID_CURR", "TARGET", "CODE_GENDER"]}, "AGE": "a.AGE_YEARS", "AGE_GROUP": within("a.AGE_YEARS", SLIM_AGE),
    **{c: f"a.{c}" for c in ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "NAME_CONTRACT_TYPE", "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS", "CNT_CHILDREN"]},
    "CREDIT_INCOME_RATIO": "ROUND(a.AMT_CREDIT / a.AMT_INCOME_TOTAL, 2)", "INCOME_CATEGORY": up_to("a.AMT_INCOME_TOTAL", SLIM_INCOME),
    "BUREAU_CREDITS": "COALESCE(b.BUREAU_CREDITS, 0)", "ACTIVE_CREDITS": "COALESCE(b.ACTIVE_CREDITS, 0)", "TOTAL_DEBT": "COALESCE(b.TOTAL_DEBT, 0)",
    "PREV_APPLICATIONS": "COALESCE(p.PREV_APPLICATIONS, 0)", "HISTORICAL_APPROVAL_RATE": "COALESCE(p.RATE, 0)"}) + (
    " FROM app a LEFT JOIN slim_bureau b USING (SK_ID_CURR) LEFT JOIN slim_prev p USING (SK_ID_CURR)")
CTES["scored_parts"] = "SELECT SK_ID_CURR, TARGET, " + select(dict(zip(SCORES, [
    up_to("AGE", AGE_SCORE), up_to("AMT_INCOME_TOTAL", INCOME_SCORE), at_least("CREDIT_INCOME_RATIO", RATIO_SCORE), up_to("BUREAU_CREDITS", HISTORY_SCORE),
    case([("PREV_APPLICATIONS = 0", 1), ("HISTORICAL_APPROVAL_RATE < 50", 3), ("HISTORICAL_APPROVAL_RATE < 80", 2)], 0)]))) + " FROM slim"
CTES["totals"] = f"SELECT *, {' + '.join(SCORES)} AS TOTAL_RISK_SCORE FROM scored_parts"
CTES["scored"] = f"SELECT *, {up_to('TOTAL_RISK_SCORE', RISK_CATEGORY)} AS RISK_CATEGORY FROM totals"


def _deps(sql: str) -> list[str]:
    words = set(re.findall(r"\b(?:FROM|JOIN)\s+([A-Za-z_][A-Za-z0-9_]*)", sql))
    return [w for w in CTES if w in words]


def with_ctes(body: str) -> str:
    """Prefix ``body`` with every CTE it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for d in _deps(CTES[name]):
                visit(d)
            order.append(name)

    for d in _deps(body):
        visit(d)
    parts = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in order)
    return (f"WITH {parts}\n" if order else "") + body.strip()


# ---------------------------------------------------------------------------
# Queries (one per registered key)
# ---------------------------------------------------------------------------

BODIES: dict[str, str] = {}

# ---- sources, sinks, inspection ------------------------------------------------------------

# the files carry one column more than declared, and it must be kept
BODIES["load_tables"] = UNION.join(
    q for t, src in RAW_SOURCE.items()
    for q in column_profile(t, src, _text(t)) + [f"SELECT '{t}', 'SOURCE_NOTE', COUNT(*), NULL, NULL, MIN('kept, \"as is\"'), MAX('kept, \"as is\"'), {checksum("'kept, " + chr(34) + "as is" + chr(34) + "'", True, ROW_KEYS[t])} FROM {src}"])
BODIES["infer_tables"] = UNION.join(
    f"SELECT '{t}' AS TABLE_NAME, '{c}' AS COLUMN_NAME, " + (f"CASE WHEN MAX(ABS({c})) > 2147483647 THEN 'bigint' ELSE 'int' END" if kind in ("int", "bigint") else f"'{kind}'")
    + f" AS DATA_TYPE, COUNT({c}) AS NON_NULL_COUNT FROM {src}"
    for t, src in RAW_SOURCE.items() for c, kind in RAW_TYPES[t].items()) + UNION + UNION.join(
    f"SELECT '{t}', 'SOURCE_NOTE', 'string', COUNT(*) FROM {src}" for t, src in RAW_SOURCE.items())
BODIES["footer_profile"] = UNION.join(
    f"SELECT '{t}' AS TABLE_NAME, '{c}' AS COLUMN_NAME, COUNT(*) AS ROW_COUNT, COUNT({c}) AS NON_NULL_COUNT, "
    + ", ".join((f"ROUND(CAST({f}({c}) AS DOUBLE), {R6}) + 0.0" if number else "CAST(NULL AS DOUBLE)") + f" AS {f}_NUMBER" for f in ("MIN", "MAX")) + f" FROM {t}"
    for t, columns in STORED.items() for c, number in columns.items())
BODIES["preview_first_rows"] = UNION.join(
    f"SELECT '{t}' AS TABLE_NAME, LEAST(COUNT(*), 20) AS SHOWN, LEAST(COUNT(*), 20) AS FOUND FROM {RAW_SOURCE[t]}" for t in CLEAN_SOURCE)
BODIES["profile_tables"] = UNION.join(
    f"SELECT '{t}' AS TABLE_NAME, COUNT(*) AS ROW_COUNT, CAST({len(RAW_TYPES[t])} AS BIGINT) AS COLUMN_COUNT FROM {src}" for t, src in RAW_SOURCE.items())
BODIES["schema_listing"] = UNION.join(
    f"SELECT '{t}' AS TABLE_NAME, {i} AS POSITION, '{c}' AS COLUMN_NAME, '{kind}' AS DATA_TYPE, COUNT({c}) AS NON_NULL_COUNT FROM {src}"
    for t, src in RAW_SOURCE.items() for i, (c, kind) in enumerate(RAW_TYPES[t].items(), 1))
for _key, _table, _order in [("preview", "application_train", "SK_ID_CURR"), ("preview_bureau", "bureau", "SK_ID_BUREAU"),
                             ("preview_bureau_balance", "bureau_balance", "SK_ID_BUREAU, MONTHS_BALANCE, STATUS NULLS FIRST"),
                             ("preview_previous", "previous_application", "SK_ID_PREV"), ("preview_installments", "installments_payments", "SK_ID_PREV")]:
    BODIES[_key] = f"SELECT * FROM {RAW_SOURCE[_table]} ORDER BY {_order} LIMIT 20"
BODIES["save_gold"] = UNION.join(
    [q for t, src in CLEAN_SOURCE.items() for q in column_profile(t, src, _text(t) | {c: False for c in ADDED_BY_CLEANING[t]})]
    + column_profile("master_dataset", "wide", _text("application_train") | {c: False for c in ADDED_BY_CLEANING["application_train"]}
                     | {c: False for group in (FILLED, UNFILLED) for cs in group.values() for c in cs} | {c: True for c in WIDE_BANDS}))
BODIES["master_views"] = UNION.join(
    f"SELECT '{name}' AS MASTER, AGE_GROUP, COUNT(*) AS CUSTOMER_COUNT, {percent('TARGET')} AS DEFAULT_RATE FROM {name} GROUP BY ALL" for name in ("wide", "slim"))

# ---- cleaners, features, risk tables ---------------------------------------------------------

for _key, _source in [("clean_application", "app"), ("clean_bureau", "bur"), ("clean_previous", "prev"), ("clean_installments", "inst"), ("clean_bureau_balance", "bb")]:
    BODIES[_key] = f"SELECT * FROM {_source}"


def _rounded(source: str, columns: list[str]) -> str:
    return "SELECT * REPLACE (" + select({c: f"ROUND({c}, {R6}) + 0.0" for c in columns}) + f") FROM {source}"


BODIES["features_bureau"] = _rounded("bureau_feat", WIDE_DOUBLES[:3])
BODIES["features_previous"] = _rounded("prev_feat", WIDE_DOUBLES[3:5])
BODIES["features_payment"] = _rounded("pay_feat", WIDE_DOUBLES[5:])
BODIES["risk_wide"] = _rounded("wide", WIDE_DOUBLES)
BODIES["risk_slim"] = _rounded("slim", ["TOTAL_DEBT"])
BODIES["risk_score_rows"] = "SELECT * FROM scored"
BODIES["stage_counts"] = UNION.join(f"SELECT '{stage}' AS STAGE, COUNT(*) AS ROW_COUNT FROM {source}" for stage, source in [
    ("application_train_clean", "app"), ("bureau_clean", "bur"), ("previous_application_clean", "prev"), ("installments_payments_clean", "inst"),
    ("bureau_balance_clean", "bb"), ("bureau_features", "bureau_feat"), ("prev_app_features", "prev_feat"), ("payment_features", "pay_feat"), ("master_dataset", "wide")])
BODIES["risk_wide_bucketed"] = BODIES["risk_wide"]
BODIES["rebuild_gold"] = UNION.join(
    f"SELECT '{t}' AS TABLE_NAME, COUNT(*) AS ROW_COUNT, CAST({n} AS BIGINT) AS COLUMN_COUNT FROM {src}" for t, src, n in
    [(t, src, len(RAW_TYPES[t]) + len(ADDED_BY_CLEANING[t])) for t, src in CLEAN_SOURCE.items()]
    + [("master_dataset", "wide", len(APPLICATION_TYPES) + len(ADDED_BY_CLEANING["application_train"]) + sum(len(cs) for g in (FILLED, UNFILLED) for cs in g.values()) + len(WIDE_BANDS))])
BODIES["portfolio_summary"] = "SELECT " + select({
    "CUSTOMER_COUNT": "COUNT(*)", "DEFAULT_RATE": percent("TARGET"), "AVG_AGE": avg("AGE_YEARS", 1), "AVG_INCOME": avg("AMT_INCOME_TOTAL"), "AVG_CREDIT": avg("AMT_CREDIT")}) + " FROM wide"
BODIES["completeness"] = UNION.join(
    f"SELECT '{c}' AS FEATURE, COUNT({c}) AS NON_NULL_COUNT, COUNT(*) AS TOTAL_ROWS, ROUND(COUNT({c}) * 100.0 / COUNT(*), 1) AS COMPLETENESS_PCT FROM wide" for c in KEY_FEATURES)

# ---- reports on the wide table and the cleaned tables -----------------------------------------

RATE = {"DEFAULT_RATE": percent("TARGET")}
BODIES["demo_by_age"] = by("wide", {"AGE_GROUP": "AGE_GROUP"}, "CUSTOMER_COUNT", RATE)
BODIES["risk_by_income"] = by("wide", {"INCOME_LEVEL": "INCOME_LEVEL"}, "CUSTOMER_COUNT", RATE | {"AVG_LOAN_SIZE": avg("AMT_CREDIT")})
BODIES["age_distribution"] = share(by("app", {"AGE_GROUP": within("AGE_YEARS", AGE_DISTRIBUTION)}, "CUSTOMER_COUNT", where="DAYS_BIRTH IS NOT NULL"), "CUSTOMER_COUNT", "app")
BODIES["gender_mix"] = share(by("app", {"GENDER": within("CODE_GENDER", GENDER)}, "CUSTOMER_COUNT", where="CODE_GENDER IN ('M', 'F')"), "CUSTOMER_COUNT", "app WHERE CODE_GENDER IN ('M', 'F')")
BODIES["income_distribution"] = share(
    by("app", {"INCOME_BRACKET": up_to("AMT_INCOME_TOTAL", INCOME)}, "CUSTOMER_COUNT", {"AVG_INCOME": avg("AMT_INCOME_TOTAL")}, "AMT_INCOME_TOTAL > 0"), "CUSTOMER_COUNT", "app WHERE AMT_INCOME_TOTAL IS NOT NULL")
BODIES["education_employment"] = by(
    "app", {"EDUCATION_LEVEL": "NAME_EDUCATION_TYPE", "EMPLOYMENT_TYPE": "NAME_INCOME_TYPE"}, "CUSTOMER_COUNT", {"AVG_INCOME": avg("AMT_INCOME_TOTAL")},
    "NAME_EDUCATION_TYPE IS NOT NULL AND NAME_INCOME_TYPE IS NOT NULL AND AMT_INCOME_TOTAL IS NOT NULL", 100)
BODIES["top_occupations"] = share(
    by("app", {"JOB_CATEGORY": "OCCUPATION_TYPE"}, "CUSTOMER_COUNT", {"AVG_INCOME": avg("AMT_INCOME_TOTAL")}, "OCCUPATION_TYPE IS NOT NULL"),
    "CUSTOMER_COUNT", "app WHERE OCCUPATION_TYPE IS NOT NULL") + " ORDER BY CUSTOMER_COUNT DESC, JOB_CATEGORY LIMIT 15"
BODIES["salary_by_profession"] = by(
    "app", {"PROFESSION": "OCCUPATION_TYPE"}, "EMPLOYEE_COUNT",
    {"AVERAGE_SALARY": avg("AMT_INCOME_TOTAL"), "MIN_SALARY": "ROUND(MIN(AMT_INCOME_TOTAL), 0)", "MAX_SALARY": "ROUND(MAX(AMT_INCOME_TOTAL), 0)",
     "MEDIAN_SALARY": "ROUND(quantile_cont(AMT_INCOME_TOTAL, 0.5), 0)"}, "OCCUPATION_TYPE IS NOT NULL AND AMT_INCOME_TOTAL > 0", 100)
# whatever the sketch answers, it must keep its promise
BODIES["salary_approx_check"] = "SELECT PROFESSION, EMPLOYEE_COUNT, MIN_SALARY, MAX_SALARY, TRUE AS WITHIN_RANK_ERROR FROM (" + BODIES["salary_by_profession"] + ")"
BODIES["loan_size_distribution"] = share(
    by("app", {"LOAN_SIZE_CATEGORY": up_to("AMT_CREDIT", CREDIT_SIZE)}, "APPLICATION_COUNT", {"AVG_LOAN_AMOUNT": avg("AMT_CREDIT")}, "AMT_CREDIT > 0"), "APPLICATION_COUNT", "app WHERE AMT_CREDIT IS NOT NULL")
BODIES["loan_purpose"] = share(
    by("app", {"LOAN_TYPE": "NAME_CONTRACT_TYPE"}, "APPLICATION_COUNT", {"AVG_LOAN_AMOUNT": avg("AMT_CREDIT")}, "NAME_CONTRACT_TYPE IS NOT NULL"), "APPLICATION_COUNT", "app")
BODIES["credit_to_income_rows"] = "SELECT " + select({
    "ANNUAL_INCOME": "AMT_INCOME_TOTAL", "CREDIT_REQUESTED": "AMT_CREDIT", "CREDIT_TO_INCOME_RATIO": "ROUND(CREDIT_INCOME_RATIO, 2)",
    "RISK_APPETITE": up_to("CREDIT_INCOME_RATIO", CREDIT_TO_INCOME)}) + " FROM app WHERE AMT_INCOME_TOTAL > 0 AND AMT_CREDIT > 0 AND CREDIT_INCOME_RATIO <= 10"
BODIES["application_outcomes"] = share(
    by("prev", {"APPLICATION_STATUS": "NAME_CONTRACT_STATUS"}, "APPLICATION_COUNT", {"AVG_REQUESTED_AMOUNT": avg("AMT_APPLICATION"), "AVG_APPROVED_AMOUNT": avg("AMT_CREDIT")},
       "NAME_CONTRACT_STATUS IS NOT NULL"), "APPLICATION_COUNT", "prev")
BODIES["rejection_reasons"] = "SELECT COALESCE(CODE, 'Not Specified') AS REJECTION_REASON, * EXCLUDE (CODE) FROM (" + share(
    by("prev", {"CODE": "CODE_REJECT_REASON"}, "REJECTION_COUNT", {"AVG_REQUESTED_AMOUNT": avg("AMT_APPLICATION")}, "NAME_CONTRACT_STATUS = 'Refused'"),
    "REJECTION_COUNT", "prev WHERE NAME_CONTRACT_STATUS = 'Refused'", "PERCENTAGE_OF_REJECTIONS") + ") ORDER BY REJECTION_COUNT DESC, REJECTION_REASON, CODE NULLS FIRST LIMIT 10"
BODIES["approval_by_size"] = (
    "SELECT *, ROUND(CAST(APPLICATION_COUNT AS DOUBLE) * 100 / SUM(APPLICATION_COUNT) OVER (PARTITION BY APPLICATION_SIZE), 2) AS PERCENTAGE FROM ("
    + by("prev", {"APPLICATION_SIZE": up_to("AMT_APPLICATION", APPLICATION_SIZE), "STATUS": "NAME_CONTRACT_STATUS"}, "APPLICATION_COUNT",
         where="AMT_APPLICATION IS NOT NULL AND NAME_CONTRACT_STATUS IS NOT NULL") + ")")
BODIES["credit_portfolio"] = share(
    by("bur", {"CREDIT_PRODUCT_TYPE": "CREDIT_TYPE", "STATUS": "CREDIT_ACTIVE"}, "CREDIT_COUNT", {"AVG_CREDIT_AMOUNT": avg("AMT_CREDIT_SUM")},
       "CREDIT_TYPE IS NOT NULL AND CREDIT_ACTIVE IS NOT NULL"), "CREDIT_COUNT", "bur")
BODIES["payment_status"] = share(
    by("bb", {"PAYMENT_STATUS": "STATUS", "PAYMENT_DESCRIPTION": case([(f"STATUS {t}", v) for t, v in STATUS[0]], STATUS[1])}, "OCCURRENCE_COUNT", where="STATUS IS NOT NULL"),
    "OCCURRENCE_COUNT", "bb WHERE STATUS IS NOT NULL")
BODIES["credit_utilization"] = by(
    "bur", {"UTILIZATION_LEVEL": up_to("(AMT_CREDIT_SUM_DEBT / AMT_CREDIT_SUM)", UTILIZATION)}, "CUSTOMER_COUNT",
    {"AVG_UTILIZATION_PCT": percent("AMT_CREDIT_SUM_DEBT / AMT_CREDIT_SUM")}, "AMT_CREDIT_SUM > 0 AND AMT_CREDIT_SUM_DEBT >= 0")
BODIES["payment_timeliness"] = share(
    by("inst", {"PAYMENT_TIMING": up_to("DAYS_LATE", TIMING)}, "PAYMENT_COUNT", {"AVG_PAYMENT_AMOUNT": avg("AMT_PAYMENT")}, "DAYS_LATE IS NOT NULL"),
    "PAYMENT_COUNT", "inst WHERE DAYS_LATE IS NOT NULL")
BODIES["payment_variance_rows"] = "SELECT " + select({
    "EXPECTED_PAYMENT": "AMT_INSTALMENT", "ACTUAL_PAYMENT": "AMT_PAYMENT",
    "PAYMENT_VARIANCE_PCT": "ROUND((AMT_PAYMENT - AMT_INSTALMENT) / AMT_INSTALMENT * 100, 2) + 0.0",
    "PAYMENT_CATEGORY": at_least("(AMT_PAYMENT / AMT_INSTALMENT)", VARIANCE)}) + " FROM inst WHERE AMT_INSTALMENT > 0 AND AMT_PAYMENT > 0 AND AMT_INSTALMENT <= 100000"

# ---- reports on the slim table ------------------------------------------------------------------

BODIES["default_kpis"] = UNION.join(
    f"SELECT '{name}' AS METRIC, {value} AS VALUE, '{unit}' AS UNIT, COUNT(*) AS TOTAL_CUSTOMERS FROM slim" for name, value, unit in [
        ("OVERALL_DEFAULT_RATE", percent("TARGET"), "%"), ("AVG_LOAN_AMOUNT", avg("AMT_CREDIT"), "USD"),
        ("AVG_INCOME", avg("AMT_INCOME_TOTAL"), "USD"), ("AVG_CREDIT_INCOME_RATIO", avg("CREDIT_INCOME_RATIO", 2), "X")])
BODIES["risk_matrix"] = by("slim", {"AGE_GROUP": "AGE_GROUP", "INCOME_CATEGORY": "INCOME_CATEGORY"}, "CUSTOMER_COUNT",
                           RATE | {"AVG_LOAN_SIZE": avg("AMT_CREDIT"), "AVG_CREDIT_RATIO": avg("CREDIT_INCOME_RATIO", 2)}, at_least_rows=100)
BODIES["history_impact"] = by("slim", {"CREDIT_HISTORY_LEVEL": up_to("BUREAU_CREDITS", HISTORY)}, "CUSTOMER_COUNT",
                              RATE | {"AVG_LOAN_AMOUNT": avg("AMT_CREDIT"), "AVG_ACTIVE_CREDITS": avg("ACTIVE_CREDITS", 1)})
BODIES["ratio_by_history"] = by("slim", {"CREDIT_TO_INCOME_RATIO": "ROUND(CREDIT_INCOME_RATIO, 1)"}, "TOTAL_CUSTOMERS", {
    f"{name}_DEFAULT_RATE": f"ROUND(AVG(TARGET) FILTER (WHERE {test}) * 100, 2)" for name, test in [
        ("NO_HISTORY", "BUREAU_CREDITS = 0"), ("SOME_HISTORY", "BUREAU_CREDITS BETWEEN 1 AND 5"), ("EXTENSIVE_HISTORY", "BUREAU_CREDITS > 5")]},
    "CREDIT_INCOME_RATIO BETWEEN 0.5 AND 5.0", 50)
BODIES["education_employment_risk"] = by(
    "slim", {"EDUCATION": "NAME_EDUCATION_TYPE", "EMPLOYMENT": "NAME_INCOME_TYPE"}, "CUSTOMER_COUNT",
    RATE | {"AVG_INCOME": avg("AMT_INCOME_TOTAL"), "AVG_LOAN_SIZE": avg("AMT_CREDIT")}, "NAME_EDUCATION_TYPE IS NOT NULL AND NAME_INCOME_TYPE IS NOT NULL", 100)
BODIES["family_risk"] = by(
    "slim", {"FAMILY_STATUS": "NAME_FAMILY_STATUS", "CHILDREN_CATEGORY": within("CNT_CHILDREN", CHILDREN)}, "CUSTOMER_COUNT",
    RATE | {"AVG_INCOME": avg("AMT_INCOME_TOTAL"), "AVG_CREDIT_RATIO": avg("CREDIT_INCOME_RATIO", 2)}, "NAME_FAMILY_STATUS IS NOT NULL", 50)
BODIES["prior_application_risk"] = by(
    "slim", {"APPLICATION_HISTORY": within("PREV_APPLICATIONS", PRIOR)}, "CUSTOMER_COUNT",
    RATE | {"AVG_HISTORICAL_APPROVAL_RATE": avg("HISTORICAL_APPROVAL_RATE", 2), "AVG_CURRENT_LOAN": avg("AMT_CREDIT")}, at_least_rows=100)
BODIES["risk_score"] = share(by("scored", {"RISK_CATEGORY": "RISK_CATEGORY"}, "CUSTOMER_COUNT", {"ACTUAL_DEFAULT_RATE": percent("TARGET"), "AVG_RISK_SCORE": avg("TOTAL_RISK_SCORE", 1)}),
                             "CUSTOMER_COUNT", "scored", "PERCENTAGE_OF_PORTFOLIO")
BODIES["risk_score_saved"] = BODIES["risk_score"]


def _money(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


BODIES["exec_summary"] = UNION.join(
    f"SELECT '{name}' AS METRIC, {value} AS VALUE, '{text}' AS DESCRIPTION FROM slim" for name, value, text in [
        ("Total Portfolio Value", _money("SUM(AMT_CREDIT)"), "Credit issued to all customers"),
        ("Credit at Risk", _money("SUM(CASE WHEN TARGET = 1 THEN AMT_CREDIT ELSE 0 END)"), "Credit issued to customers who defaulted"),
        ("Overall Default Rate", f"CAST({percent('TARGET')} AS VARCHAR) || '%'", "Percentage of customers who defaulted"),
        ("New vs Existing Split", f"CAST(ROUND(100.0 * CAST({count_if('BUREAU_CREDITS = 0')} AS DOUBLE) / COUNT(*), 1) AS VARCHAR) || '% New'",
         "First-time customers vs customers with credit history")])


def oracle_sql() -> dict[str, str]:
    """Full DuckDB statement per registered key."""
    return {k: with_ctes(v) for k, v in BODIES.items()}
