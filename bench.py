"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is planned and fully executed with the ``noop`` sink (every row is
produced, nothing is collected to the driver). Prints one JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}.
Set BENCH_QUERIES=a,b to run a subset, BENCH_WARM=1 to also time a second run.
Before timing, one untimed job on the ``region`` table warms the session.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["silver_benefit_policy", "tfidf_topk_padded", "qa_end_to_end", "config_sweep",
            "psi_weekly", "hybrid_topk"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    warm = os.environ.get("BENCH_WARM", "0") == "1"

    from coverwise.plans.catalog import load_all
    from coverwise.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          app_name="coverwise-bench")
    qs = load_all()
    # session warm-up (JVM class loading, parquet reader, one shuffle) on a
    # tiny driver table that no headline query reads; not timed
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy().count().collect()
    times: dict[str, float] = {}
    warm_times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        if warm:
            t0 = time.perf_counter()
            qs[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            warm_times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
           "cpus": cpus}
    if warm:
        out["warm"] = warm_times
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
