"""Benchmark: every registered query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1).

1. ``ingest``: derive sales / target / summaries from the star schema and write them in the
   stored layout (facts partitioned by Year) under the session's checkpoint folder -- the
   one-off load, like building the reference's database.
2. Every registered query runs against the stored tables; each is timed end to end with a
   ``noop`` write (full execution, no driver collection), median of ``$BENCH_REPEAT`` runs.

Prints one JSON line: {"metric", "value" (sum of query medians), "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]

    from salescope.session import build_session

    os.environ.setdefault("SALESCOPE_DRIVER_MEMORY", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=2 * cpus, app="salescope-bench")
    spark.sparkContext.setLogLevel("OFF")

    from salescope.plans import registry
    from salescope.session import checkpoint_dir
    from salescope.sources.ingest import write_tables
    from salescope.sources.tables import load_tables, star_tables

    root = f"{checkpoint_dir(spark).rstrip('/')}/salescope-bench-{uuid.uuid4().hex[:8]}"
    t0 = time.perf_counter()
    write_tables(star_tables(spark, sf_dir), root)
    ingest = time.perf_counter() - t0
    tables = load_tables(spark, root)

    keys = only or sorted(registry.queries())
    times: dict[str, float] = {}
    for key in keys:
        runs = []
        for _ in range(repeat):
            t = time.perf_counter()
            registry.run_on(tables, spark, key, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[key] = round(statistics.median(runs), 4)

    sf_match = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "sum_of_query_medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf_match.group(1)) if sf_match else sf_dir,
        "cpus": cpus,
        "repeat": repeat,
        "ingest_sec": round(ingest, 3),
        "n_queries": len(times),
    }))


if __name__ == "__main__":
    main()
