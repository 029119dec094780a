"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barwatch.operators.features import engineer_features  # noqa: E402
from barwatch.plans import adaptors, catalog  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = [
    "volatile_days", "engineer_features", "engineer_features_brand", "engineer_features_ticks", "correlation_matrix",
    "distance_to_center", "contamination_cut", "user_dashboard_summary", "recent_runs", "daily_activity",
    "kmeans_anomalies", "gmm_anomalies", "isolation_forest_anomalies", "ocsvm_anomalies",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    named = catalog.queries()
    # Start the JVM's compiler and the file system caches before the clock.
    engineer_features(adaptors.bars(spark, SF_DIR)).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        named[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
