"""Streaming queries over raw payment messages."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybrook.functions.features import money
from tallybrook.operators.parse import enrich, parse_transactions
from tallybrook.operators.parse import score as rule
from tallybrook.operators.quality import accepted, typed_for_storage, with_reject_reason
from tallybrook.operators.summaries import MEASURES, successful
from tallybrook.operators.upsert import upsert_partitions, write_partitions
from tallybrook.schema import MONEY_SUM
from tallybrook.session import cloned
from tallybrook.streaming.sinks import (
    BATCH_KEYS,
    Score,
    StreamId,
    Targets,
    append_new_payments,
    each_batch,
    fan_out,
    with_batch,
    write_counters,
)

# How often the sinks write.
TABLE_INTERVAL = "30 seconds"
COUNTER_INTERVAL = "10 seconds"

DEDUP_SLOTS = 16
SLOT_SEED = 7

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
SAVE_CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

log = logging.getLogger(__name__)


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for streams whose state is kept in RocksDB instead of the JVM heap, of which only
    changes are saved per batch; the given session keeps its settings.

    The working copy lies on executor disks, the saved state in the checkpoint folder. Each
    state partition costs a store to open and to save; without `state_partitions` there are
    as many as shuffle partitions, which the first checkpoint then fixes.
    """
    own = {STATE_STORE: ROCKSDB, SAVE_CHANGES: "true"}
    if state_partitions:
        own[PARTITIONS] = str(state_partitions)
    return cloned(spark, **{key.replace(".", "__"): value for key, value in own.items()})


def clean_stream(messages: DataFrame) -> DataFrame:
    """Raw messages as enriched rows that meet the table contract."""
    return enrich(accepted(with_reject_reason(parse_transactions(messages))))


def start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Start a query; without an interval it takes all that is there now and ends."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def bronze_sink(
    messages: DataFrame, path: str, checkpoint: str, interval: str | None = TABLE_INTERVAL
) -> StreamingQuery:
    """Append every raw message, unchanged, to the bronze table, by ingestion date."""

    def write(batch: DataFrame, batch_id: int, query_id: str) -> None:
        now = F.current_timestamp()
        raw = batch.select("value", now.alias("ingested_at"), F.to_date(now).alias("ingest_date"))
        write_partitions(with_batch(raw, batch_id, query_id), path, "ingest_date", *BATCH_KEYS)

    return start(each_batch(messages, checkpoint, write), checkpoint, interval)


def lake_sink(
    enriched: DataFrame, path: str, checkpoint: str, interval: str | None = TABLE_INTERVAL
) -> StreamingQuery:
    """Append enriched rows to a Parquet table by event date, in few files per batch."""

    def write(batch: DataFrame, batch_id: int, query_id: str) -> None:
        dated = batch.withColumn("event_date", F.to_date("event_time"))
        write_partitions(with_batch(dated, batch_id, query_id), path, "event_date", *BATCH_KEYS)

    return start(each_batch(enriched, checkpoint, write), checkpoint, interval)


def warehouse_sink(
    enriched: DataFrame, path: str, checkpoint: str, interval: str | None = TABLE_INTERVAL
) -> StreamingQuery:
    """Add new payments to the warehouse table."""

    def write(batch: DataFrame, batch_id: int, query_id: str) -> None:
        append_new_payments(typed_for_storage(batch), batch_id, path, query_id)

    return start(each_batch(enriched, checkpoint, write), checkpoint, interval)


def counter_sink(
    enriched: DataFrame, path: str, checkpoint: str, interval: str | None = COUNTER_INTERVAL
) -> StreamingQuery:
    """Keep the live counters."""

    def write(batch: DataFrame, batch_id: int, query_id: str) -> None:
        write_counters(batch, batch_id, path, query_id)

    return start(each_batch(enriched, checkpoint, write), checkpoint, interval)


def fan_out_sink(
    messages: DataFrame,
    targets: Targets,
    checkpoint: str,
    interval: str | None = COUNTER_INTERVAL,
    score: Score = rule,
) -> StreamingQuery:
    """One query for warehouse, counters and quarantine: messages are read and scored once."""

    stream = StreamId(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        fan_out(batch, batch_id, targets, stream.of(batch.sparkSession), score)

    return start(messages.writeStream.foreachBatch(write), checkpoint, interval)


def dedup_stream(enriched: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated transaction ids that arrive within `delay` of each other in event time.

    The watermark bounds the state and drops rows older than it; bronze keeps those, and the
    daily batch counts them.
    """
    return drop_copies(enriched.withWatermark("event_time", delay))


def drop_copies(watermarked: DataFrame) -> DataFrame:
    """Drop repeated transaction ids within the watermark, in two steps: first within a random slot
    of their id, so that an id repeated without end is worked off by many tasks, then among the
    few rows that are left of it.
    """
    slot = F.floor(F.rand(SLOT_SEED) * DEDUP_SLOTS)
    spread = watermarked.withColumn("slot", slot)
    thinned = spread.dropDuplicatesWithinWatermark(["transaction_id", "slot"]).drop("slot")
    return thinned.dropDuplicatesWithinWatermark(["transaction_id"])


def daily_totals(clean: DataFrame, keys: Sequence[str], delay: str = "1 day") -> DataFrame:
    """Running totals per event day and keys; each change is emitted as the new total."""
    day = F.window("event_time", "1 day")
    return (
        successful(clean)
        .where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
        .withWatermark("event_time", delay)
        .groupBy(day, *keys)
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.sum(money()).cast(MONEY_SUM).alias("total_amount_egp"),
            F.count_if("is_fraud").alias("fraud_count"),
        )
        .select(*keys, *MEASURES, F.to_date("window.start").alias("summary_date"))
    )


def daily_totals_sink(
    spark: SparkSession,
    totals: DataFrame,
    keys: Sequence[str],
    path: str,
    staging: str,
    checkpoint: str,
    interval: str | None = TABLE_INTERVAL,
) -> StreamingQuery:
    """Upsert changed daily totals into a summary table; rows without a key value stay out.

    `staging` belongs to this table, so that a new checkpoint finds what an old one left.
    """

    def write(batch: DataFrame, batch_id: int, query_id: str) -> None:
        upsert_partitions(
            spark,
            path,
            staging,
            batch,
            ["summary_date", *keys],
            MEASURES,
            "summary_date",
        )

    return start(each_batch(totals, checkpoint, write).outputMode("update"), checkpoint, interval)


def finish(query: StreamingQuery) -> int:
    """Wait for a query that ends by itself; a failure in it is raised here.

    Returns how many rows came behind its watermark, which the stream leaves to the daily batch
    jobs, and logs them. The count covers the progress reports the session keeps.
    """
    query.awaitTermination()
    late = sum(
        state.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for state in progress.stateOperators
    )
    if late:
        log.warning("%s rows came behind the watermark and are left to the daily job", late)
    return late


def batch_count(query: StreamingQuery) -> int:
    """Batches with rows that a query has run, of those whose progress the session keeps."""
    return len({p.batchId for p in query.recentProgress if p.numInputRows})
