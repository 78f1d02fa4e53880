"""Times the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the tables and the cores.
Each query is run once to warm up and then timed three times, of which the median counts; its rows go to a sink that writes none.
"""

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")

from pyspark.sql import SparkSession  # noqa: E402

from wayline import queries as registered  # noqa: E402

HEADLINES = (
    "daygroup_timebin_summary", "daily_bands", "rolling_centered", "segment_delay", "complete_flags_total", "corridor_total", "coverage_cost",
    "compare_raw_day", "compare_ci_pvalues", "bh_qvalues", "rolling_median_7d", "decompose_hourly", "changepoints_daily", "changepoints_hourly", "keep_first_merge",
    "weighted_by_time", "nearest_line_join", "overlap_pairs", "panel_summary",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        taken = []
        for _ in range(4):
            began = time.perf_counter()
            registered.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(median(taken[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
