"""Time the queries: one JSON line.

Each query runs once to warm up, then ``BENCH_REPEAT`` times (default 2); its figure
is the median. Building the plan, jobs run while building it, and a full evaluation
into a no-op sink are all included. ``BENCH_ONLY`` names queries, comma separated.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from dateline.plans import all_queries
from dateline.session import build_session


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    only = [name for name in os.environ.get("BENCH_ONLY", "").split(",") if name]
    spark = build_session(
        "bench", cores, **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cores}
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    for name, query in all_queries().items():
        if only and name not in only:
            continue
        runs = []
        for _ in range(repeat + 1):
            start = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name} {runs[0]:.2f} {timings[name]:.2f}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
