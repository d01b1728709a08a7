"""Time the headline queries; prints one JSON line."""

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from panelscope.plans.queries import queries

NAMES = ["penetration_month", "penetration_iso_week", "share_by_period", "rbr_exact", "rbr_bucket_complete", "rbr_cohort_weeks", "buying_windowed", "buying_growing", "buying_scopes", "fit_discounted", "stability", "piecewise_fit", "cohort_table", "predictions"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every, took = queries(), {}
    every[NAMES[0]](spark, sf).write.format("noop").mode("overwrite").save()  # compiles code and warms the file cache
    for name in NAMES:
        began = time.time()
        every[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
