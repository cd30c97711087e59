"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "hourly_median_pivot", "first_stay_cohort", "static_features", "hourly_series", "freetext_cohort", "comorbidity_flags",
    "first_window_value_pivot", "ffill_clip", "sequence_pad", "preprocess_splits", "stratified_split", "numeric_profile",
    "category_profile", "corr_matrix", "table1_by_group", "ks_per_column", "kruskal_wallis", "chi_square", "rubin_pool",
    "plausibility_rules", "corr_frobenius", "nn_distance", "dcr", "mia", "sequence_distance", "acf_compare",
    "family_counts", "cpd_bdeu", "forward_sample", "scenario_compare", "feedback_ema", "drift_report", "stream_hourly_medians",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up, not timed
    seconds = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
