"""Batch jobs: bronze to silver, silver to gold, model training."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.operators import evaluation, idtable, model, quality, summaries
from tallybrook.operators.parse import parse_transactions
from tallybrook.operators.upsert import (
    finish_replacement,
    read_if_present,
    replace_partitions,
    touched_partitions,
    write_partitions,
)
from tallybrook.sources.tables import table_stream
from tallybrook.streaming import lateness
from tallybrook.streaming.queries import (
    clean_stream,
    daily_totals,
    daily_totals_sink,
    finish,
    start,
)

MERCHANT_TABLE = "merchant_daily_summary"
GOVERNORATE_TABLE = "governorate_daily_summary"
SERVICE_TABLE = "service_daily_rollup"
MISSING_TABLE = "payments_without_summary_key"

TOTALS_DELAY = "1 day"
CLEAN_STREAM_SCHEMA = (
    "transaction_id string, event_time timestamp, merchant_id string, service_type string, "
    "amount_egp double, governorate string, status string, is_fraud boolean"
)

#: What the table of ids keeps beside an id.
ID_COLUMNS = "event_date date"


def previous_day() -> dt.date:
    """The day that has just ended in UTC: what a job started at midnight should summarise."""
    return dt.datetime.now(dt.UTC).date() - dt.timedelta(days=1)


@dataclass(frozen=True)
class Lake:
    """Folders of the lake: raw messages, clean rows, rejected messages, summaries, work space, and
    the table of ids with the event dates they came under."""

    bronze: str
    silver: str
    quarantine: str
    gold: str
    staging: str
    checkpoint: str
    ids: str


def lake_at(root: str) -> Lake:
    """Default layout of a lake below one folder."""
    return Lake(
        bronze=f"{root}/bronze/transactions",
        silver=f"{root}/silver/transactions",
        quarantine=f"{root}/quarantine/silver",
        gold=f"{root}/gold",
        staging=f"{root}/staging/silver",
        checkpoint=f"{root}/checkpoints/silver",
        ids=f"{root}/silver/ids",
    )


def refresh_silver(messages: DataFrame, batch_id: int, lake: Lake) -> DataFrame:
    """Bring raw messages (value, and ingested_at if known) into the clean table and return the
    event dates touched, as a table.

    Late rows land in the partition of their event date. An id counts once over all dates: a
    table of the ids and dates taken in so far tells in which other dates the ids of this batch
    lie, and these are redone too; the earliest row stays. Only touched dates are read and
    replaced. A run that stops is finished by the next one, and a second run changes nothing.
    """
    spark = messages.sparkSession
    finish_replacement(spark, lake.silver, f"{lake.staging}/silver", "event_date")
    staging = f"{lake.staging}/{batch_id}"
    keep = [c for c in messages.columns if c != "value"]
    checked = quality.with_reject_reason(parse_transactions(messages, "value", *keep)).persist()
    try:
        bad = quality.rejected(checked).select("value", quality.REJECT)
        write_partitions(
            bad.withColumn("batch_id", F.lit(batch_id).cast("bigint")), lake.quarantine, "batch_id"
        )
        fresh = quality.clean_rows(checked.drop("value"))
        fresh.write.mode("overwrite").parquet(f"{staging}/fresh")
    finally:
        checked.unpersist()
    rows = spark.read.parquet(f"{staging}/fresh")
    _touched(rows, lake).write.mode("overwrite").parquet(f"{staging}/touched")
    touched = spark.read.parquet(f"{staging}/touched")
    table = read_if_present(spark, lake.silver)
    if table is not None:
        old = touched_partitions(table, touched, "event_date")
        both = old.unionByName(rows.select(*old.columns))
        rows = quality.dedup_earliest(both, ["transaction_id"], ["event_time", "ingested_at"])
    if not touched.isEmpty():
        replace_partitions(rows, touched, lake.silver, f"{lake.staging}/silver", "event_date")
    return touched


def _touched(fresh: DataFrame, lake: Lake) -> DataFrame:
    """Dates of the fresh rows and all dates under which their ids came before.

    Ids are entered in the table of ids before the clean table changes, so none is missing
    there after a stop; a date too many only costs a needless rewrite of it. What is read of that
    table grows with the delivery.
    """
    spark = fresh.sparkSession
    own = fresh.select("transaction_id", "event_date")
    dates = own.select("event_date")
    before = idtable.lookup(own, lake.ids, ID_COLUMNS)
    if before is not None:
        before.write.mode("overwrite").parquet(f"{lake.staging}/known")
        before = spark.read.parquet(f"{lake.staging}/known")
        dates = dates.union(before.select("event_date"))
        own = own.join(before, own.columns, "left_anti")
    idtable.add(own, lake.ids, ID_COLUMNS)
    return dates.distinct()


def catch_up(spark: SparkSession, lake: Lake) -> None:
    """Take in all bronze files that are new since the last run and redo the days they touch.

    The stream checkpoint keeps what was taken; a step that fails is done again as a whole.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        touched = refresh_silver(batch, batch_id, lake)
        if not touched.isEmpty():
            _summarise(batch.sparkSession, lake, touched)

    files = table_stream(
        spark, lake.bronze, "value binary, ingested_at timestamp", maxFilesPerTrigger="4096"
    )
    writer = files.select("value", "ingested_at").writeStream.foreachBatch(step)
    finish(start(writer, lake.checkpoint, None))


def _summarise(spark: SparkSession, lake: Lake, touched: DataFrame) -> dict[str, DataFrame]:
    """Recompute the summaries of the touched event dates in full and replace them; a date that
    has no payment any more loses its rows.

    The key columns of the summaries are never NULL: successful payments that lack one are left
    out of that summary and listed in a table of their own.
    """
    days = touched.select(F.col("event_date").alias("summary_date"))
    clean = spark.read.parquet(lake.silver)
    rows = clean.join(touched, "event_date", "left_semi")

    def replace(name: str, frame: DataFrame) -> DataFrame:
        path, staging = f"{lake.gold}/{name}", f"{lake.staging}/{name}"
        finish_replacement(spark, path, staging, "summary_date")
        replace_partitions(frame, days, path, staging, "summary_date")
        table = read_if_present(spark, path)
        return frame.limit(0) if table is None else touched_partitions(table, days, "summary_date")

    merchant_keys, governorate_keys = ["merchant_id", "service_type"], ["governorate"]
    merchants = replace(
        MERCHANT_TABLE, summaries.merchant_daily_summary(rows.dropna(subset=merchant_keys))
    )
    governorates = replace(
        GOVERNORATE_TABLE, summaries.governorate_daily_summary(rows.dropna(subset=governorate_keys))
    )
    replace(MISSING_TABLE, summaries.missing_keys(rows, [*merchant_keys, *governorate_keys]))
    replace(SERVICE_TABLE, summaries.service_daily_rollup(merchants))
    return {MERCHANT_TABLE: merchants, GOVERNORATE_TABLE: governorates}


def run_daily(
    spark: SparkSession, lake: Lake, dates: Sequence[dt.date] | None = None
) -> DataFrame:
    """Recompute the summaries of the given event dates (default: yesterday) and replace them.

    Each date is recomputed in full from the clean table, so a repeated run changes nothing.
    Returns the row count of each summary table for the dates.
    """
    days = list(dates) if dates is not None else [previous_day()]
    touched = spark.createDataFrame([(day,) for day in days], "event_date date")
    return summaries.summary_row_counts(_summarise(spark, lake, touched))


def source_labels(silver: DataFrame) -> DataFrame:
    """The clean table as training rows: `is_fraud` is the flag that came with the payment, not
    the one that the score raised, and unknown where none came."""
    return silver.withColumn("is_fraud", F.col("source_flag"))


def stream_totals(spark: SparkSession, messages: DataFrame, root: str, interval: str | None):
    """Start the streams that keep the daily totals per governorate of payments seen once.

    The first lands each payment once, the second adds up those that are in time. The late
    ones wait in a table that `streamed_totals` adds.
    """
    once = lateness.first_arrivals(clean_stream(messages))
    landing = lateness.landing_at(f"{root}/stream")
    checkpoints = f"{root}/checkpoints"
    first = lateness.split_sink(once, landing, f"{checkpoints}/arrivals", TOTALS_DELAY, interval)
    if interval is None:
        finish(first)
    clean = table_stream(messages.sparkSession, landing.in_time, CLEAN_STREAM_SCHEMA)
    second = daily_totals_sink(
        spark,
        daily_totals(clean, ["governorate"], TOTALS_DELAY),
        ["governorate"],
        f"{root}/stream/governorate_totals",
        f"{root}/staging/governorate_totals",
        f"{checkpoints}/totals_in_time",
        interval,
    )
    if interval is None:
        finish(second)
    return [first, second]


def streamed_totals(spark: SparkSession, root: str) -> DataFrame | None:
    """The daily totals per governorate of the streams, late payments included; None before the
    first are written."""
    streamed = read_if_present(spark, f"{root}/stream/governorate_totals")
    if streamed is None:
        return None
    late = lateness.late_rows(spark, lateness.landing_at(f"{root}/stream"), CLEAN_STREAM_SCHEMA)
    known = summaries.governorate_daily_summary(late.dropna(subset=["governorate"]))
    return summaries.add_up(streamed, known, ["governorate"])


def train(spark: SparkSession, labelled: DataFrame, path: str) -> dict[str, DataFrame]:
    """Train, save and evaluate the fraud model; returns the evaluation frames."""
    fitted, tested = model.train_and_test(labelled)
    fitted.save(path)
    return {
        "classification_report": evaluation.classification_report(
            tested, "is_fraud", "predicted_fraud"
        ),
        "roc_auc": evaluation.roc_auc(tested, "is_fraud", "fraud_probability"),
        "confusion_matrix": evaluation.confusion_matrix(tested, "is_fraud", "predicted_fraud"),
        "files": model.model_files(spark, path),
    }
