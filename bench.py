"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from cellwright.plans import registry  # noqa: E402
from cellwright.session import local_session  # noqa: E402

HEADLINE = [
    "value_counts", "duplicate_count", "eval_metrics", "rules_first_match", "ks_drift", "schema_inference",
    "profile_columns", "outliers_both", "anomalies", "actions_log", "apply_fixes", "table_diff", "reconstruct_records",
    "clean_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    queries, times = registry.queries(), {}
    # the first job pays for starting the JVM's code paths
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_wall", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
