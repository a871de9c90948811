"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

All queries run twice to warm up, the second time in turned order, so that none pays for starting the
session or compiling what the others share. Then each runs $BENCH_RUNS times (default 2); the median counts. Results are consumed by the no-op sink, so that every column is
computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberscope.session import build_session  # noqa: E402
from showcase import REGISTRY  # noqa: E402

HEADLINE = [
    "label_join",
    "label_join_bucketed",
    "orphan_fires",
    "grid_snap_join",
    "neighbour_mean",
    "rolling_rows",
    "rolling_time",
    "rolling_time_double",
    "training_table",
    "horizon_label",
    "dry_run",
    "block_6h",
    "memory_feature_table",
    "feature_table",
    "asof_monthly",
    "landing_document_roundtrip",
    "dedup_first",
    "hotspots_topk",
    "month_rank",
    "audit_all",
    "roc_auc",
    "ingest_stream",
    "medallion_build",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("OFF")

    def once(run) -> float:
        started = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    names = only or HEADLINE
    for name in [*names, *reversed(names)]:
        once(REGISTRY[name][0])
    for name in names:
        run, _ = REGISTRY[name]
        seconds[name] = round(statistics.median(once(run) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
