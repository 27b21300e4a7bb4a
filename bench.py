"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is run once to
warm up at the smallest scale and once timed; the timed run covers planning, execution and
every result row (written to Spark's no-op sink).

The given tables are files of one row group. ``BENCH_SCAN_TASKS`` (the cores, by default) deals
their rows out, so that all cores take part; 0 leaves the scans as a cluster would run them. The
JSON says which of the two was timed.
"""

from __future__ import annotations

import json
import os
import time

from plumbline.plans.registry import QUERIES
from plumbline.session import local_session
from plumbline.sources.tables import SCAN_TASKS

HEADLINE = [
    "flagship", "in_10", "in_12", "in_13", "rf_06", "ih_02", "ih_05", "ih_06", "ih_10", "ih_11",
    "ih_14", "ec_01", "ec_05", "ec_07", "ec_08", "wm_03", "df_03", "df_04", "df_05", "df_06",
    "df_07", "mt_01", "mt_02", "mt_04", "vf_02", "vf_12", "vf_13", "gv_05", "gv_07", "gv_10",
    "gv_12",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    tasks = int(os.environ.get("BENCH_SCAN_TASKS", spark.conf.get(SCAN_TASKS)))
    if tasks:
        spark.conf.set(SCAN_TASKS, str(tasks))
    else:
        spark.conf.unset(SCAN_TASKS)
    times = {}
    for name in HEADLINE:
        if os.path.isdir(warm_dir):
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "scan_tasks": tasks,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
