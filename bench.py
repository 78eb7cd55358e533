"""Benchmark: run the registered queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed end to end with the ``noop`` sink (every row is
produced, nothing is collected to the driver), once to warm up and then
$BENCH_REPS times; the per-query figure is the median.  Prints ONE JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPS = int(os.environ.get("BENCH_REPS", "3"))



def main() -> None:
    from loanlens.registry import QUERIES
    from loanlens.session import local_session

    import tempfile

    scratch = tempfile.mkdtemp(prefix="loanlens-bench-")
    spark = local_session(cpus=CPUS, shuffle_partitions=CPUS, app="loanlens-bench",
                          extra={"spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
                                 "spark.checkpoint.dir": os.path.join(scratch, "checkpoints")})
    only = [a for a in sys.argv[1:]]
    keys = [k for k in QUERIES if not only or k in only]

    def run(key: str) -> float:
        t0 = time.perf_counter()
        QUERIES[key](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    times, errors = {}, {}
    try:
        run("risk_score")  # JVM / code-cache warm-up
    except Exception as exc:
        errors["warm_up"] = f"{type(exc).__name__}: {exc}"[:300]
    for k in keys:
        try:
            run(k)
            samples = [run(k) for _ in range(REPS)]
        except Exception as exc:  # keep measuring the others; report the failure
            errors[k] = f"{type(exc).__name__}: {exc}"[:300]
            print(f"{k:28s} FAILED {errors[k]}", file=sys.stderr)
            continue
        times[k] = round(statistics.median(samples), 4)
        print(f"{k:28s} {times[k]:7.3f}s", file=sys.stderr)

    # end-to-end bronze -> silver -> gold build: five cleaned tables + the wide master table
    build = None
    if not only and os.environ.get("BENCH_BUILD", "1") != "0":
        from loanlens.plans import gold
        from loanlens.plans.context import LendingData

        t0 = time.perf_counter()
        try:
            gold.build_tables(LendingData.from_fixtures(spark, SF_DIR), "bench_gold")
            build = round(time.perf_counter() - t0, 3)
        except Exception as exc:
            errors["build_gold"] = f"{type(exc).__name__}: {exc}"[:300]
        print(f"{'build_gold (write 6 tables)':28s} {build:7.3f}s", file=sys.stderr)

    m = re.search(r"sf([0-9.]+)", SF_DIR)
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else SF_DIR,
        "cpus": CPUS,
        "reps": REPS,
        "build_gold_sec": build,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
