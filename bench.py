"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (no collect),
including any stage it materializes while being built.  One untimed
warm-up pass over all headline queries, then the median of ``BENCH_RUNS``
(default 3) timed runs per query; prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postlens.plans import QUERIES  # noqa: E402
from postlens.session import get_session  # noqa: E402

HEADLINE = [
    "topic_viral_ranking", "viral_coefficient", "performance_tier", "kpi_summary", "best_key",
    "hashtag_effectiveness", "top_posts", "ab_battery", "trend_velocity", "forecast",
    "content_calendar", "relatability_score", "problem_awareness", "tfidf", "page_links",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "12g"})
    names = [n for n in HEADLINE if n in QUERIES]
    # warm-up: one untimed pass over every headline query (JIT, file listing)
    for n in names:
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {}
    for n in names:
        ts = []
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            ts.append(time.perf_counter() - t0)
        times[n] = round(statistics.median(ts), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
