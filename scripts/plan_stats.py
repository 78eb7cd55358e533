"""Count parquet scans and shuffle exchanges in executed plans: each rewrite
(KPI fusion, share of total, one-aggregate completeness) against the
literal UNION ALL / scalar-subquery / per-column form, and every registered query.

Usage: python scripts/plan_stats.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loanlens.plans import quality, reports  # noqa: E402
from loanlens.registry import QUERIES, ctx_for  # noqa: E402
from loanlens.session import local_session  # noqa: E402


def counts(df):
    execution = df._jdf.queryExecution()
    execution.toRdd().count()  # runs this very plan, so that the adaptive plan below is the final one
    plan = execution.executedPlan().toString().split("== Initial Plan ==")[0]
    scans = len(re.findall(r"FileScan parquet", plan))
    shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
    return scans, shuffles


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    ctx = ctx_for(spark, sf_dir)
    ctx.register_views("p_")
    pairs = {
        "X1 default_kpis": (reports.default_kpis(ctx), spark.sql("""
            SELECT 'A', AVG(TARGET), COUNT(*) FROM p_risk_slim UNION ALL SELECT 'B', AVG(AMT_CREDIT), COUNT(*) FROM p_risk_slim
            UNION ALL SELECT 'C', AVG(AMT_INCOME_TOTAL), COUNT(*) FROM p_risk_slim
            UNION ALL SELECT 'D', AVG(CREDIT_INCOME_RATIO), COUNT(*) FROM p_risk_slim""")),
        "X2 loan_purpose": (reports.loan_purpose(ctx), spark.sql("""
            SELECT NAME_CONTRACT_TYPE, COUNT(*), COUNT(*) * 100.0 / (SELECT COUNT(*) FROM p_application_train)
            FROM p_application_train WHERE NAME_CONTRACT_TYPE IS NOT NULL GROUP BY NAME_CONTRACT_TYPE""")),
        "X3 completeness": (quality.completeness(ctx), spark.sql(" UNION ALL ".join(
            f"SELECT '{c}', COUNT({c}), COUNT(*) FROM p_risk_wide" for c in quality.KEY_FEATURES))),
    }
    print("rewrite | scans (rewrite / literal) | exchanges (rewrite / literal)")
    for name, (a, b) in pairs.items():
        (sa, ea), (sb, eb) = counts(a), counts(b)
        print(f"{name} | {sa} / {sb} | {ea} / {eb}")
    print()
    print("query | parquet scans | exchanges")
    for k in QUERIES:
        s, e = counts(QUERIES[k](spark, sf_dir))
        print(f"{k} | {s} | {e}")


if __name__ == "__main__":
    main()
