"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS: local cores (default 8)
"""

from __future__ import annotations

import json
import os
import time

from contestry.plans.catalogue import QUERIES
from contestry.session import local_session

# In this order the stored tables (contests, statistics, ratings, features, log)
# are built inside the query that first needs them, so their cost is counted.
HEADLINE = (
    "clean_contests",
    "side_stats",
    "csv_contests",
    "parse_raw",
    "name_forms",
    "career_history",
    "ratings",
    "rated_history",
    "snapshots",
    "rating_grid",
    "features",
    "preprocessing_stats",
    "winner_metrics",
    "temperature",
    "calibration",
    "quote_alignment",
    "roi_sweep",
    "predict_cards",
    "merge_log",
    "graded_log",
    "track_record",
    "card_pages",
    "winner_model",
    "ensemble",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the JVM's readers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
