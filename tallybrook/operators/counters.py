"""Live counters: per-batch delta rows, their totals and the batch-size window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybrook.functions.features import money
from tallybrook.operators.running import running_totals
from tallybrook.schema import COUNTER_VALUE

# Batches in the size window, digits shown.
WINDOW_BATCHES = 60
SHOWN_DIGITS = 2

BATCHES_PER_PIECE = 1024


def counter_deltas(rows: DataFrame, batch_id: str = "batch_id") -> DataFrame:
    """What each batch adds to the counters, as (batch_id, metric, key, value).

    Rows are aggregated once to (batch, service, region); the six counters are then unfolded
    from that small table. Missing and empty keys are not counted by key.
    """
    base = rows.groupBy(batch_id, "service_type", "governorate").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_fraud").alias("fraud"), F.sum(money()).alias("egp")
    )

    def entry(metric: str, value: str, key: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            key.alias("key"),
            F.col(value).cast(COUNTER_VALUE).alias("value"),
        )

    entries = F.array(
        entry("total_transactions", "n", F.lit("")),
        entry("total_fraud", "fraud", F.lit("")),
        entry("total_revenue", "egp", F.lit("")),
        entry("by_service", "n", F.coalesce("service_type", F.lit(""))),
        entry("revenue_by_service", "egp", F.coalesce("service_type", F.lit(""))),
        entry("by_governorate", "n", F.coalesce("governorate", F.lit(""))),
    )
    return (
        base.select(batch_id, F.inline(entries))
        .where(F.col("metric").startswith("total_") | (F.col("key") != ""))
        .groupBy(F.col(batch_id).alias("batch_id"), "metric", "key")
        .agg(F.sum("value").cast(COUNTER_VALUE).alias("value"))
    )


def keyed_counts(deltas: DataFrame, metric: str, key_name: str) -> DataFrame:
    """Running count per key of one keyed counter."""
    return (
        deltas.where(F.col("metric") == metric)
        .groupBy(F.col("key").alias(key_name))
        .agg(F.sum("value").cast("bigint").alias("cnt"))
    )


def keyed_revenue(deltas: DataFrame) -> DataFrame:
    """Running revenue per service."""
    return (
        deltas.where(F.col("metric") == "revenue_by_service")
        .groupBy(F.col("key").alias("service_type"))
        .agg(F.sum("value").cast(COUNTER_VALUE).alias("revenue"))
    )


def ranked_counts(counts: DataFrame, key: str, ascending: bool) -> DataFrame:
    """Counts per category with their position in chart order.

    The input holds one row per category of the network's catalogue, not per payment.
    """
    by = F.col("cnt").asc() if ascending else F.col("cnt").desc()
    return counts.withColumn("position", F.row_number().over(W.orderBy(by, key)).cast("bigint"))


def batch_sizes(rows: DataFrame, batch_id: str = "batch_id") -> DataFrame:
    """Rows per micro-batch."""
    return rows.groupBy(batch_id).agg(F.count(F.lit(1)).alias("n_rows"))


def batch_sizes_from(deltas: DataFrame) -> DataFrame:
    """Rows per micro-batch, read back from the counters; sums of folded batches are no batch."""
    counted = (F.col("metric") == "total_transactions") & F.col("batch_id").isNotNull()
    return deltas.where(counted).select(
        "batch_id", F.col("value").cast("bigint").alias("n_rows")
    )


def newest_batches(sizes: DataFrame, count: int = WINDOW_BATCHES) -> DataFrame:
    """Sizes of the newest batches."""
    return sizes.orderBy(F.desc("batch_id")).limit(count)


def avg_rows_per_batch(sizes: DataFrame) -> DataFrame:
    """Mean size of the newest batches, 0 before the first one."""
    mean = F.coalesce(F.round(F.avg("n_rows"), SHOWN_DIGITS), F.lit(0.0))
    return newest_batches(sizes).agg(mean.alias("avg_rows"))


def live_kpis(deltas: DataFrame) -> DataFrame:
    """Totals, fraud rate in percent and mean batch size, all 0 when there is no data yet."""

    def total(metric: str) -> Column:
        part = F.sum(F.when(F.col("metric") == metric, F.col("value")))
        return F.coalesce(part, F.lit(0)).alias(metric)

    totals = deltas.where(F.col("metric").startswith("total_")).agg(
        total("total_transactions"), total("total_fraud"), total("total_revenue")
    )
    rate = F.try_divide(
        F.col("total_fraud").cast("double") * 100.0, F.col("total_transactions").cast("double")
    )
    return totals.select(
        F.col("total_transactions").cast("bigint").alias("total_transactions"),
        F.col("total_fraud").cast("bigint").alias("total_fraud"),
        F.col("total_revenue").cast(COUNTER_VALUE).alias("total_revenue"),
        F.coalesce(F.round(rate, SHOWN_DIGITS), F.lit(0.0)).alias("fraud_rate"),
        avg_rows_per_batch(batch_sizes_from(deltas)).scalar().alias("avg_rows_per_batch"),
    )


def rolling_batch_mean(sizes: DataFrame, count: int = WINDOW_BATCHES) -> DataFrame:
    """The batch-size mean as it stood after each batch.

    Batches are numbered and summed with running totals over id ranges, and each mean is the
    difference of two running sums: an equi-join on the number, no window over all batches.
    """
    piece = F.floor(F.col("batch_id") / BATCHES_PER_PIECE)
    summed = running_totals(
        sizes.withColumn("one", F.lit(1)),
        {"number": "one", "before": "n_rows"},
        order="batch_id",
        bucket=piece,
    )
    older = summed.select(
        (F.col("number") + count - 1).alias("number"), F.col("before").alias("left_out")
    )
    width = F.least(F.col("number") + 1, F.lit(count))
    held = F.col("before") + F.col("n_rows") - F.coalesce("left_out", F.lit(0))
    return summed.join(older, "number", "left").select(
        "batch_id", F.round(held / width, SHOWN_DIGITS).alias("rolling_mean")
    )


def batch_audit(rows: DataFrame, batch_id: str = "batch_id") -> DataFrame:
    """Per-batch report: rows, fraud, event-time span and the true rate in rows per second."""
    audit = rows.groupBy(F.col(batch_id).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_fraud").alias("n_fraud"),
        F.min("event_time").cast("timestamp_ntz").alias("first_event"),
        F.max("event_time").cast("timestamp_ntz").alias("last_event"),
    )
    span = F.unix_micros(F.col("last_event").cast("timestamp")) - F.unix_micros(
        F.col("first_event").cast("timestamp")
    )
    rate = F.try_divide(F.col("n_rows").cast("double") * 1e6, span.cast("double"))
    return audit.withColumn("rows_per_second", F.round(rate, 6))
