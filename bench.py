"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the test data folder, BENCH_CPUS the local cores. Every query runs to its full
result, discarded by the noop sink; the time is the best of BENCH_RUNS runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallybrook.plans.registry import QUERIES
from tallybrook.session import build_session

HEADLINE = [
    "parse_transactions",
    "rule_fraud_score",
    "enriched_transactions",
    "quarantine",
    "silver_transactions",
    "dedup_natural_keys",
    "merchant_daily_summary",
    "governorate_daily_summary",
    "service_history",
    "summary_upsert",
    "counter_deltas",
    "live_kpis",
    "rolling_batch_mean",
    "amount_percentile",
    "fraud_features",
    "stratified_split",
    "classification_report",
    "roc_auc",
    "stream_ingest",
    "warehouse_sink",
    "stream_fanout",
    "stream_dedup",
    "stream_daily_summary",
    "stream_merchant_summary",
    "silver_incremental",
    "label_encoding",
    "train_fraud_model",
    "ml_fraud_score",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeats = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, sf_dir)
        times[name] = round(min(run(spark, name, sf_dir) for _ in range(repeats)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
