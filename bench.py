"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wattline.plans.catalog import REGISTRY
from wattline.session import local_session

HEADLINE = [
    "day_metrics", "interp_pos", "asof_fill_join", "dedupe_first", "resample_mean", "sliding_windows", "neighbour_mean", "corr_graph",
    "day_point_features", "knn_asof_join", "robust_z", "horizon_metrics", "slot_offset_search", "stratified_source_nodes", "active_source",
    "parse_generation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # One small query first, so that the first timing is not the JVM's start.
    REGISTRY["slot_day"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for key in HEADLINE:
        start = time.perf_counter()
        REGISTRY[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[key] = round(time.perf_counter() - start, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_time", "value": total, "unit": "sec", "queries": timings, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
