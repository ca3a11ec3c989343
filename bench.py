"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Rows are produced in full and discarded in the JVM (``noop`` sink).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from veedor.plans.queries import QUERIES
from veedor.runtime import get_session

HEADLINE = (
    "quality_summary",
    "population_counts",
    "count_filtered",
    "page_by_id",
    "modality_stats",
    "monthly_series",
    "cost_histogram",
    "concentration_top",
    "by_department",
    "municipality_fill",
    "burst_max",
    "pair_features_60d",
    "rules_ranking",
    "hybrid_ranking",
    "sector_deviation",
    "relationship_age",
    "trailing_concentration",
    "cast_errors",
    "upsert",
    "load_stats",
    "partitioned_copy",
    "stream_daily_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "veedor-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
