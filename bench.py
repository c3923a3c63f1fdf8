"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced end to end with the ``noop`` sink (full execution, no driver collect).
JVM warm-up (JIT, code generation) is done by running every query once on the smallest driver
tables (a different folder, so no result or cached data is reused); ``spark.catalog.clearCache()``
between queries keeps one query's persisted frames from helping the next.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldspark.plans.catalog import QUERIES  # noqa: E402
from fieldspark.session import get_session  # noqa: E402

HEADLINE = [
    "clean_full",
    "clean_diagnostics",
    "outlier_iqr",
    "impute_median",
    "impute_time",
    "impute_categorical",
    "dedup_keep_last",
    "gdd",
    "physical_bounds",
    "soft_confidence",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in (sys.argv[1:] or HEADLINE + [q for q in QUERIES if q not in HEADLINE]) if n in QUERIES]
    spark = get_session(f"local[{cpus}]", partitions=int(cpus))
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir)
    for n in names if warm else ["physical_bounds"]:
        try:
            QUERIES[n](spark, warm_dir if warm else sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            print(f"# warm-up {n} failed: {e!r}"[:300], file=sys.stderr)
        spark.catalog.clearCache()
    times: dict[str, float] = {}
    for n in names:
        t = time.time()
        try:
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.time() - t, 3)
        except Exception as e:  # noqa: BLE001 - a failing query is reported, not fatal
            times[n] = -1.0
            print(f"# {n} failed: {e!r}"[:300], file=sys.stderr)
        spark.catalog.clearCache()
    total = round(sum(v for v in times.values() if v >= 0), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf, "warmup": warm}))


if __name__ == "__main__":
    main()
