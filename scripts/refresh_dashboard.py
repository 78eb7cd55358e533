"""Batch entry point (spark-submit or python): rebuild the tables and every report.

  spark-submit scripts/refresh_dashboard.py --csv /data/lending --database lending_gold --buckets 512
  python scripts/refresh_dashboard.py --fixtures /root/testdata/sf0.01 --database demo --local

The session is the cluster's (``--local`` builds a local one for trying it out);
recommended AQE settings are applied only where the cluster left them unset.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from loanlens import LendingData  # noqa: E402
from loanlens.plans import dashboard  # noqa: E402
from loanlens.session import local_session, tune  # noqa: E402


def main(argv: list[str] | None = None) -> dict[str, str]:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="folder with the eight headed CSV files")
    src.add_argument("--fixtures", help="benchmark parquet folder to derive the tables from")
    ap.add_argument("--database", required=True)
    ap.add_argument("--buckets", type=int, default=None, help="bucket tables by SK_ID_CURR into N buckets")
    ap.add_argument("--infer", action="store_true", help="infer CSV types instead of the declared schemas")
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--local", action="store_true", help="build a local session")
    args = ap.parse_args(argv)

    spark = local_session() if args.local else tune(SparkSession.builder.getOrCreate())
    ctx = (LendingData.from_csv(spark, args.csv, infer=args.infer) if args.csv
           else LendingData.from_fixtures(spark, args.fixtures))
    tables = dashboard.refresh(ctx, args.database, fmt=args.format, buckets=args.buckets)
    for name, table in tables.items():
        print(f"{name}\t{table}")
    return tables


if __name__ == "__main__":
    main()
