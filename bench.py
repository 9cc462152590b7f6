"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from perimetra.queries import load
from perimetra.session import configured, ship

HEADLINE = (
    "track_kinematics", "classify_tracks", "threat_tracks", "alert_opens", "site_model_fit", "cell_zscores", "thermal_persistence",
    "path_familiarity", "feature_novelty", "site_score", "policy_judge", "associate_sensors", "best_name", "heat_check", "merge_blobs",
    "unclaimed_static", "assessment_union", "watch_list", "alert_intervals", "dwell", "object_numbers", "escalation_requests",
    "settled_regions", "learned_site", "learned_optical", "packet_frames", "confusion", "current_state",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        configured(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    jobs = load().jobs
    names = sys.argv[1:] or HEADLINE
    jobs["current_state"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        jobs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir), "event_rows": rows}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
