"""Payment events derived from the `events` table, as rows and as JSON messages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.schema import (
    GOVERNORATES,
    PAYMENT_METHODS,
    SERVICE_TYPES,
    TRANSACTION_COLUMNS,
)
from tallybrook.session import use_utc

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)
WIRE_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
ROWS_PER_BATCH = 130
#: Events of a batch of a stream that go into one file.
ROWS_PER_FILE = 200_000


def _pick(index: Column, domain: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in domain]), (index + 1).cast("int"))


def to_payments(events: DataFrame, *extra: str) -> DataFrame:
    """Map events rows to payment rows; works on a batch or a stream. Keeps `extra` columns."""
    k = F.get_json_object("props", "$.k").cast("int")
    event_id = F.col("event_id")
    method = F.lit(PAYMENT_METHODS[-1])
    for kind, name in zip(("click", "error", "purchase", "signup"), PAYMENT_METHODS):
        method = F.when(F.col("event_type") == kind, name).otherwise(method)
    status = (
        F.when(event_id % 6 == 4, "failed").when(event_id % 6 == 5, "pending").otherwise("success")
    )
    flag = F.when(event_id % 50 == 7, F.lit(None).cast("boolean")).otherwise(event_id % 33 == 0)
    return events.select(
        event_id.cast("string").alias("transaction_id"),
        F.col("ts").alias("event_time"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.concat(F.lit("MERCH-"), (1000 + (event_id * 7) % 40).cast("string")).alias("merchant_id"),
        _pick(k % 15, SERVICE_TYPES).alias("service_type"),
        (F.col("value") * 100).alias("amount_egp"),
        _pick(F.col("user_id") % 15, GOVERNORATES).alias("governorate"),
        method.alias("payment_method"),
        status.alias("status"),
        flag.alias("is_fraud"),
        *extra,
    )


def payments(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Payment rows of a test data folder."""
    use_utc(spark)
    return to_payments(spark.read.parquet(f"{sf_dir}/events.parquet"), *extra)


def files_per_batch(spark: SparkSession, sf_dir: str, batches: int) -> int:
    """Files that a batch is written as when the events make so many: one task's work each."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    return max(1, math.ceil(rows / batches / ROWS_PER_FILE))


def events_by_time(
    spark: SparkSession, sf_dir: str, folder: str, batches: int, files: int = 1
) -> str:
    """Write the events to `folder` as batches of consecutive times, the earliest first, each as
    so many files.

    A stream that takes this number of files at a time, in the order they were written, meets events
    in the order of their times, whatever the order of the table. Events without a time are in the
    last batch.
    """
    return in_time_order(spark.read.parquet(f"{sf_dir}/events.parquet"), folder, batches, files)


def in_time_order(events: DataFrame, folder: str, batches: int, files: int = 1) -> str:
    """Add the events to `folder` as batches of consecutive times, the earliest first."""
    shares = [i / batches for i in range(1, batches)]
    moment = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(moment, shares)).first()[0] if shares else []
    bounds = [None, *sorted(set(cuts or [])), None]
    reader = events.sparkSession.read.schema(events.schema)
    for low, high in zip(bounds, bounds[1:]):
        part = events
        if high is not None:
            part = part.where(moment < high)
        if low is not None:
            late = moment >= low
            part = part.where(late if high is not None else late | moment.isNull())
        part.repartition(files).write.mode("append").parquet(folder)
        # empty partitions leave no file: without the missing ones, batches would run into each other
        for _ in range(-len(reader.parquet(folder).inputFiles()) % files):
            events.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return folder


def held_back() -> Column:
    """Every 15th event: those a delivery brings last."""
    return F.col("event_id") % 15 == 4


def events_with_stragglers(
    spark: SparkSession, sf_dir: str, folder: str, batches: int, files: int = 1
) -> str:
    """Like `events_by_time`, but the held-back events come after all others."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    in_time_order(events.where(~held_back()), folder, batches, files)
    return in_time_order(events.where(held_back()), folder, 1, files)


def events_coming_back(
    spark: SparkSession, sf_dir: str, folder: str, batches: int, files: int = 1
) -> str:
    """Like `events_by_time`, and then every 20th event once more, stamped two hours later."""
    events_by_time(spark, sf_dir, folder, batches, files)
    again = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_id") % 20 == 0)
    later = again.withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 HOURS"))
    return in_time_order(later, folder, 1, files)


def payments_missing_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of which every 40th lacks its amount."""
    rows = payments(spark, sf_dir, "event_id")
    absent = F.col("event_id") % 40 == 9
    amount = F.when(absent, F.lit(None).cast("double")).otherwise(F.col("amount_egp"))
    return rows.withColumn("amount_egp", amount).drop("event_id")


def payments_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with the id of the micro-batch of 130 consecutive events they arrived in."""
    rows = payments(spark, sf_dir, "event_id")
    batch_id = F.floor(F.col("event_id") / ROWS_PER_BATCH).cast("bigint")
    return rows.withColumn("batch_id", batch_id).drop("event_id")


def with_late_copies(rows: DataFrame) -> DataFrame:
    """Every 20th payment arrives once more, stamped a minute later."""
    copies = F.when(F.col("event_id") % 20 == 0, 2).otherwise(1)
    minute = F.make_dt_interval(mins=F.col("copy"))
    return (
        rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        .withColumn("event_time", F.col("event_time") + minute)
        .drop("copy")
    )


def redelivered(rows: DataFrame) -> DataFrame:
    """Every 20th payment is delivered twice, unchanged, as an at-least-once broker does."""
    copies = F.when(F.col("event_id") % 20 == 0, 2).otherwise(1)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


def _wire_json(**changed: Column) -> Column:
    time = F.date_format(F.col("event_time").cast("timestamp"), WIRE_TIME_FORMAT)
    fields = {name: F.col(name) for name in TRANSACTION_COLUMNS} | {"event_time": time}
    for name, value in changed.items():
        fields[name] = value.otherwise(fields[name])
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def to_wire(rows: DataFrame, *keep: str) -> DataFrame:
    """Payment rows as JSON messages in a `value` column; a NULL field is left out."""
    return rows.select(_wire_json().cast("binary").alias("value"), *keep)


def with_defects(rows: DataFrame, *keep: str) -> DataFrame:
    """Payment rows as JSON messages, every 200th broken in one of ten ways (needs event_id)."""
    event_id, defect = F.col("event_id"), F.col("defect")
    kind = F.when(event_id % 200 == 3, F.floor(event_id / 200) % 10)
    long_text = F.repeat(F.lit("x"), 60)
    absent = F.lit(None)
    message = _wire_json(
        amount_egp=F.when(defect == 1, absent).when(defect == 7, 1e11).when(defect == 8, math.nan),
        event_time=F.when(defect == 2, absent).when(defect == 4, "2024-13-45T99:00:00"),
        transaction_id=F.when(defect == 5, absent),
        merchant_id=F.when(defect == 6, long_text),
        status=F.when(defect == 9, long_text),
    )
    opening = (
        F.when(defect == 1, '{"amount_egp":"abc",')
        .when(defect == 3, '{"channel":"kiosk",')
        .otherwise("{")
    )
    text = F.when(defect == 0, "not json").otherwise(F.overlay(message, opening, 1, 1))
    return rows.withColumn("defect", kind).select(text.cast("binary").alias("value"), *keep)


def wire_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON messages of a test data folder, defects included."""
    return with_defects(payments(spark, sf_dir, "event_id"))
