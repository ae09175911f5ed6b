"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "c1_recording_owner",
    "c2_nearest_interval",
    "c4_band_average_by_subject",
    "d5_pair_outcomes",
    "d11_recorded_by_day",
    "d12_hourly_quality",
    "d13_daily_summary",
    "e1_sample_rate",
    "e5_pulse_band",
    "e9_refractory_merge",
    "e12_motion_envelope",
    "f6_ranked_warnings",
    "h1_reading_upsert",
    "p2_pair_points",
    "p3_waveforms",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from catalog import registry
    from wavecohort.session import drop_intermediates

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    took: dict[str, float] = {}
    for _ in range(2):  # the first pass warms the JVM; the better of the two counts
        for name in HEADLINE:
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - began
            took[name] = round(min(seconds, took.get(name, seconds)), 3)
            drop_intermediates(spark)
    line = {
        "metric": "headline_total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir),
        "cpus": int(cpus),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
