"""Time the registered queries: each one run once cold, then its best of two.

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES choose the
data, the cores and (comma-separated) the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestead.queries import QUERIES  # noqa: E402

HEADLINE = [
    "fit_scores_long", "decision_report", "decision_report_full", "suggested_actions", "ratings_wide", "ratings_latest",
    "nearest_wide", "nearest_long", "nearest_grid", "station_build", "geo_enrich", "extract_rendered", "extract_noisy_pages",
    "extract_amenities", "extract_bullets", "extract_lease_terms", "batch_fold", "upsert_apply", "ingest_skip", "detail_diff",
    "detail_update", "rating_upsert", "column_medians", "lineitem_medians", "feature_matrix_scalar", "value_signal_folds",
    "value_signal_full", "export_newest_first",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestead-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
