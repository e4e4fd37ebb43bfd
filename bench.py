"""Times headline queries: python bench.py prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "flt09_search_videos", "ex01_random_clips", "ex02_temporal_clips", "ex04_coreset_step", "ex06_cluster_margin", "ex07_label_uncertainty",
    "jn01_label_join_full", "jn01_label_join_partial", "jn01_label_join_bucketed", "jn04_labels_within_clips", "jn05_features_in_clips_full", "jn06_nearest_features",
    "jn14_predictions_for_clips", "ag01_label_counts_full", "ag03_label_seconds", "ag06_predictions_pivoted", "ag16_pyramid_pooled", "dml05_labels_coalesced",
    "ml01_training_set", "ml07_metrics", "ml15_augmented", "lb06_propagated", "fn25_distances", "bd01_survivors",
)


def main() -> None:
    from kinolake.plans import all_queries
    from kinolake.session import session

    spark = session(f"local[{CPUS}]", "bench", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    every = all_queries()
    run = lambda name: every[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # starts the JVM's compilers
    times = {}
    for name in HEADLINE:
        began = time.time()
        run(name)
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
