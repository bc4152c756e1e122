"""Time the headline queries and print one JSON line.

Every query runs once to warm up; the reported seconds are the median of the
following runs, plan building included, with the whole result computed and
discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from checks.compare import session
from checks.queries import queries

HEADLINE = (
    "m_rep", "m_cert", "m_sni", "m_srv", "m_proto", "m_scan", "m_vol", "m_fail",
    "m_vol_diagnostic", "host_scores", "host_scores_from_profile", "network_index",
    "suspect_ranking", "suspect_details", "service_novelty", "hourly_profile", "contextual_baseline",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    registered, seconds = queries(), {}
    for name in HEADLINE:
        timings = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            timings.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(timings[1:]), 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": float(scale) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
