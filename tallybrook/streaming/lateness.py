"""Streams that lose no payment to a watermark: ids remembered by arrival, late rows set aside.

A watermark over event times bounds the state of a stream by dropping what comes behind it. Here ids
expire by the time they arrived, which no row is behind, and rows whose day the totals have closed
go to a table of their own, from which they are added to the totals when these are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybrook.operators.upsert import read_if_present, write_partitions
from tallybrook.session import delete, exists
from tallybrook.streaming.queries import TABLE_INTERVAL, drop_copies, start
from tallybrook.streaming.sinks import BATCH_KEYS, each_batch, with_batch

#: How long an id is remembered after it arrived.
MEMORY = "30 days"
DAY = 86_400_000_000


def first_arrivals(enriched: DataFrame, memory: str = MEMORY) -> DataFrame:
    """Each transaction id once, as it arrived first, however far apart its copies' event times lie.

    Needs `ingested_at`, the time of the batch. An id that comes back within `memory` of its
    arrival is dropped; no row is dropped for its event time. The state holds the ids of that time,
    on executor disks, and a batch looks up only its own. Of copies in one batch any may stay.
    """
    return drop_copies(enriched.withWatermark("ingested_at", memory))


@dataclass(frozen=True)
class Landing:
    """Folders of the rows in time, the late ones, and per batch the greatest event time so far."""

    in_time: str
    late: str
    horizon: str


def landing_at(root: str) -> Landing:
    """Default layout below one folder."""
    return Landing(f"{root}/in_time", f"{root}/late", f"{root}/horizon")


def split_sink(
    enriched: DataFrame,
    landing: Landing,
    checkpoint: str,
    delay: str,
    interval: str | None = TABLE_INTERVAL,
) -> StreamingQuery:
    """Land every row once: in time, or late if its UTC day had ended `delay` before the greatest
    event time of earlier batches.

    That is when a stream of daily totals with this delay has closed the day at the earliest: it reads
    landed batches in their order and each as a whole. A batch that ran before is left as it landed,
    so the reader meets no file twice.
    """

    def write(batch: DataFrame, batch_id: int, query_id: str) -> None:
        spark = batch.sparkSession
        before, high = _horizon(spark, landing, batch_id, query_id)
        time = F.unix_micros(F.col("event_time").cast("timestamp"))
        closed = F.lit(False)
        if high is not None:
            limit = F.unix_micros(F.timestamp_micros(F.lit(high)) - F.expr(f"INTERVAL {delay}"))
            closed = (F.floor(time / DAY) + 1) * DAY <= limit
        greatest = F.greatest(F.max(time), F.lit(high).cast("bigint")).alias("high")
        for path, rows in (
            (landing.in_time, batch.where(~closed)),
            (landing.late, batch.where(closed)),
            (landing.horizon, batch.agg(greatest)),
        ):
            if not exists(spark, f"{path}/query_id={query_id}/batch_id={batch_id}"):
                # one folder per batch, which the commit moves into place as a whole
                write_partitions(with_batch(rows, batch_id, query_id), path, *BATCH_KEYS)
        for old in before[1:]:
            delete(spark, f"{landing.horizon}/query_id={query_id}/batch_id={old}")

    return start(each_batch(enriched, checkpoint, write), checkpoint, interval)


def _horizon(
    spark: SparkSession, landing: Landing, batch_id: int, query_id: str
) -> tuple[list[int], int | None]:
    """Earlier batches whose greatest time is kept, the newest first, and that time."""
    schema = "high bigint, query_id string, batch_id bigint"
    kept = read_if_present(spark, landing.horizon, schema)
    if kept is None:
        return [], None
    own = kept.where((F.col("query_id") == query_id) & (F.col("batch_id") < batch_id))
    rows = own.orderBy(F.desc("batch_id")).collect()
    return [row.batch_id for row in rows], rows[0].high if rows else None


def late_rows(spark: SparkSession, landing: Landing, schema: str) -> DataFrame:
    """The rows that came late; none before the first."""
    late = read_if_present(spark, landing.late, schema)
    return spark.createDataFrame([], schema) if late is None else late
