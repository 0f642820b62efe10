"""Daily summaries, their rollups and the history reports on them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.features import money
from tallybrook.schema import MONEY_SUM

MEASURES = ["total_transactions", "total_amount_egp", "fraud_count"]
HISTORY_ROWS = 200


def successful(rows: DataFrame) -> DataFrame:
    """Only payments that went through."""
    return rows.where(F.col("status") == "success")


def day_slice(rows: DataFrame, day: dt.date, time: str = "event_time") -> DataFrame:
    """Rows of one calendar day; the range form reaches the file scan as a pushed filter."""
    start = F.lit(day).cast("timestamp_ntz")
    end = F.lit(day + dt.timedelta(days=1)).cast("timestamp_ntz")
    return rows.where((F.col(time) >= start) & (F.col(time) < end))


def missing_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Successful payments that lack a key of a summary, and which."""
    names = F.concat_ws(",", *[F.when(F.col(k).isNull(), k) for k in keys])
    found = successful(rows).select(
        "transaction_id", names.alias("missing"), F.to_date("event_time").alias("summary_date")
    )
    return found.where(F.col("missing") != "")


def _measures() -> list:
    # count_if, not sum: an unknown flag counts as no fraud, also in an all-unknown group
    return [
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(money()).cast(MONEY_SUM).alias("total_amount_egp"),
        F.count_if("is_fraud").alias("fraud_count"),
    ]


def _totals() -> list:
    return [
        F.sum("total_transactions").alias("total_transactions"),
        F.sum("total_amount_egp").cast(MONEY_SUM).alias("total_amount_egp"),
        F.sum("fraud_count").alias("fraud_count"),
    ]


def merchant_daily_summary(rows: DataFrame) -> DataFrame:
    """Successful payments per day, merchant and service."""
    day = F.to_date("event_time").alias("summary_date")
    return successful(rows).groupBy(day, "merchant_id", "service_type").agg(*_measures())


def governorate_daily_summary(rows: DataFrame) -> DataFrame:
    """Successful payments per day and governorate."""
    day = F.to_date("event_time").alias("summary_date")
    return successful(rows).groupBy(day, "governorate").agg(*_measures())


def service_daily_rollup(merchant_summary: DataFrame) -> DataFrame:
    """Merchant summary rolled up to day and service."""
    return merchant_summary.groupBy("summary_date", "service_type").agg(*_totals())


def add_up(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two daily summaries with the same keys as one."""
    both = first.unionByName(second.select(*first.columns))
    return both.groupBy("summary_date", *keys).agg(*_totals())


def summary_row_counts(summaries: dict[str, DataFrame]) -> DataFrame:
    """Rows per date of each summary table, counted per table and put together."""
    parts = [
        table.groupBy("summary_date")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("summary"), "summary_date", "row_count")
        for name, table in summaries.items()
    ]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def newest(summary: DataFrame, key: str, rows: int = HISTORY_ROWS) -> DataFrame:
    """Newest rows of a daily summary; `key` makes the cut at the limit unambiguous."""
    return (
        summary.select("summary_date", key, *MEASURES)
        .orderBy(F.desc("summary_date"), key)
        .limit(rows)
    )

