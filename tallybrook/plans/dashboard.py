"""The frames a dashboard shows, read from the counters and the gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybrook.operators import counters, summaries
from tallybrook.operators.upsert import read_if_present
from tallybrook.plans.jobs import GOVERNORATE_TABLE, SERVICE_TABLE
from tallybrook.schema import GOVERNORATE_SUMMARY_SCHEMA, SERVICE_SUMMARY_SCHEMA
from tallybrook.streaming.sinks import read_counters


def live_frames(
    spark: SparkSession, counters_path: str, baseline_path: str | None = None
) -> dict[str, DataFrame]:
    """Headline numbers and the two live charts; zeros and empty frames before the first batch."""
    deltas = read_counters(spark, counters_path, baseline_path)
    by_service = counters.keyed_counts(deltas, "by_service", "service_type")
    by_governorate = counters.keyed_counts(deltas, "by_governorate", "governorate")
    return {
        "kpis": counters.live_kpis(deltas),
        "revenue": counters.keyed_revenue(deltas),
        "services": counters.ranked_counts(by_service, "service_type", ascending=True),
        "governorates": counters.ranked_counts(by_governorate, "governorate", ascending=False),
    }


def history_frames(spark: SparkSession, gold_path: str) -> dict[str, DataFrame]:
    """Newest rows of the daily summaries; empty frames before the first daily job."""

    def table(name: str, schema: str) -> DataFrame:
        found = read_if_present(spark, f"{gold_path}/{name}", schema)
        return spark.createDataFrame([], schema) if found is None else found

    services = table(SERVICE_TABLE, SERVICE_SUMMARY_SCHEMA)
    governorates = table(GOVERNORATE_TABLE, GOVERNORATE_SUMMARY_SCHEMA)
    return {
        "services": summaries.newest(services, "service_type"),
        "governorates": summaries.newest(governorates, "governorate"),
    }
