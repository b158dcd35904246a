"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sightline.plans import QUERIES  # noqa: E402
from sightline.session import build_session, release  # noqa: E402

HEADLINE = [
    "flowtime_stats", "asof_pose", "pose_interpolation", "tracklets", "keyframes_in_window",
    "voxel_iou", "nearest_distance", "chamfer", "f_score",
    "label_iou_matrix", "panoptic_summary", "recall_by_level",
    "pair_stats", "gt_status_3d", "clear_metrics", "identity_metrics", "hota_metrics",
    "components", "merge_instances", "run_medians", "stale_groups", "stream_tracker", "unproject", "silhouettes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["topic_counts"](spark, sf_dir).collect()  # JVM warm-up, not timed
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
