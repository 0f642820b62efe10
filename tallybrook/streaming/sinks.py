"""Batch writers for streams. Each may run again for the same batch and changes nothing then."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallybrook.operators import idtable
from tallybrook.operators.counters import WINDOW_BATCHES, counter_deltas
from tallybrook.operators.parse import fill_amount, parse_transactions
from tallybrook.operators.parse import score as rule
from tallybrook.operators.quality import (
    REJECT,
    accepted,
    dedup_earliest,
    rejected,
    typed_for_storage,
    with_reject_reason,
)
from tallybrook.operators.upsert import read_if_present, write_partitions
from tallybrook.schema import COUNTER_VALUE, STORED_COUNTERS, WAREHOUSE_COLUMNS
from tallybrook.session import delete

#: Parts of a batch's own partition of a sink: the stream it belongs to and its number there.
BATCH_KEYS = ("query_id", "batch_id")
#: Copies of a payment whose event times lie this close are kept out of the warehouse.
COPY_SPAN = "1 hour"

#: What the warehouse's table of ids keeps beside an id: the batch that brought it.
ID_COLUMNS = "query_id string, batch_id bigint"

#: Rows of a baseline that say up to which batch it holds a stream.
UPTO = "upto"

Score = Callable[[DataFrame], DataFrame]

log = logging.getLogger(__name__)


class StreamId:
    """The id that a stream's checkpoint gives it, the same after every restart; read once, with
    the first batch.

    Batches are numbered from 0 again under a new checkpoint, so a number alone names no batch.
    """

    def __init__(self, checkpoint: str):
        self.checkpoint = checkpoint
        self.known: str | None = None

    def of(self, spark: SparkSession) -> str:
        if self.known is None:
            saved = spark.read.schema("id string").json(f"{self.checkpoint}/metadata")
            self.known = saved.first()["id"]
        return self.known


def with_batch(rows: DataFrame, batch_id: int, query_id: str) -> DataFrame:
    """The rows with the keys of their batch."""
    return rows.withColumns(
        {"query_id": F.lit(query_id), "batch_id": F.lit(batch_id).cast("bigint")}
    )


def append_new_payments(
    batch: DataFrame, batch_id: int, path: str, query_id: str, ids: str | None = None
) -> None:
    """Add a batch to the warehouse table, leaving out ids that other batches brought.

    The table is partitioned by event date, stream and batch: writing a batch again replaces
    what it wrote before and nothing else. Ids are compared with payments of the same time,
    give or take COPY_SPAN: a redelivered message keeps its event time. Dates prune folders and
    times prune files, so a batch reads as much at the end of a day as at its start. An id that
    comes back under a time farther away is found in the table at `ids`, which keeps the ids of
    all batches in buckets; without it, the job that builds the clean table settles it. Call
    it with a cached batch: its times are read before its rows.

    Ids are entered after the rows: a stop between leaves rows without ids, which the batch enters
    when it runs again, never ids without rows.
    """
    rows = batch.select(*WAREHOUSE_COLUMNS, F.to_date("event_time").alias("event_date"))
    rows = dedup_earliest(rows, ["transaction_id"], ["event_time"])
    table = read_if_present(batch.sparkSession, path)
    if table is not None:
        known = known_ids(table, rows, batch_id, query_id)
        rows = rows.join(known, ["transaction_id"], "left_anti")
    if ids is None:
        write_partitions(with_batch(rows, batch_id, query_id), path, "event_date", *BATCH_KEYS)
        return
    met = idtable.lookup(batch, ids, ID_COLUMNS)
    if met is not None:
        rows = rows.join(met.where(_of_others(batch_id, query_id)), ["transaction_id"], "left_anti")
    fresh = with_batch(rows, batch_id, query_id).persist()
    try:
        write_partitions(fresh, path, "event_date", *BATCH_KEYS)
        idtable.add(fresh.select("transaction_id", *BATCH_KEYS), ids, ID_COLUMNS)
    finally:
        fresh.unpersist()


def _of_others(batch_id: int, query_id: str) -> Column:
    return ~((F.col("query_id") == query_id) & (F.col("batch_id") == batch_id))


def known_ids(table: DataFrame, rows: DataFrame, batch_id: int, query_id: str) -> DataFrame:
    """Ids that other batches brought with an event time near those of `rows`."""
    span = F.expr(f"INTERVAL {COPY_SPAN}")
    first, last = rows.agg(F.min("event_time") - span, F.max("event_time") + span).first()
    return table.where(
        _of_others(batch_id, query_id)
        & F.col("event_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        & F.col("event_time").between(F.lit(first), F.lit(last))
    ).select("transaction_id")


def append_new_payments_jdbc(
    batch: DataFrame, batch_id: int, options: Mapping[str, str], table: str, connections: int = 8
) -> None:
    """Add a batch to a database table, leaving out ids that are there already.

    The batch goes to a staging table first; the database itself joins it with the big table and
    returns only the ids of this batch it knows, so no more than a batch travels back.
    """
    spark = batch.sparkSession
    staging = f"{table}_staging"
    rows = dedup_earliest(batch.select(*WAREHOUSE_COLUMNS), ["transaction_id"], ["event_time"])
    writer = {**options, "batchsize": "10000", "numPartitions": str(connections)}
    staged = rows.write.format("jdbc").options(**writer).mode("overwrite").option("truncate", True)
    staged.option("dbtable", staging).save()
    known = (
        spark.read.format("jdbc")
        .options(**options)
        .option(
            "query",
            f"SELECT s.transaction_id FROM {staging} s "
            f"JOIN {table} t ON t.transaction_id = s.transaction_id",
        )
        .load()
    )
    fresh = rows.join(known, "transaction_id", "left_anti").select(*WAREHOUSE_COLUMNS)
    fresh.write.format("jdbc").options(**writer).mode("append").option("dbtable", table).save()


def each_batch(
    rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int, str], None]
) -> DataStreamWriter:
    """A stream writer that hands every batch with rows, cached, to `write` with its number and
    the id of its stream.

    Uncached, each use of a batch would read its source again and step its state again.
    """

    stream = StreamId(checkpoint)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                write(batch, batch_id, stream.of(batch.sparkSession))
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(step)


def write_counters(batch: DataFrame, batch_id: int, path: str, query_id: str) -> None:
    """Store what a batch adds to the live counters as its own partition.

    Counters count messages as they arrive: a redelivered one counts again, as it does in the
    stream's row counts. The warehouse and the tables made from it hold each payment once.
    """
    tagged = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    deltas = counter_deltas(tagged).select("metric", "key", "value")
    stored = deltas.withColumn("written_at", F.current_timestamp())
    write_partitions(with_batch(stored, batch_id, query_id), path, *BATCH_KEYS)


def read_counters(
    spark: SparkSession, deltas_path: str, baseline_path: str | None = None
) -> DataFrame:
    """Counter rows: the newest baseline plus the deltas after it; empty before the first batch.

    `batch_id` orders batches of all streams by the time they were written; rows of a
    baseline have none.
    """
    deltas = read_if_present(spark, deltas_path, STORED_COUNTERS)
    if deltas is None:
        deltas = spark.createDataFrame([], STORED_COUNTERS)
    folded, upto = _newest_baseline(spark, baseline_path)
    if folded is not None:
        deltas = deltas.join(upto, "query_id", "left").where(
            F.col("upto").isNull() | (F.col("batch_id") > F.col("upto"))
        )
    live = deltas.select(
        "metric", "key", "value", F.unix_micros("written_at").alias("batch_id")
    )
    if folded is None:
        return live
    return live.unionByName(folded.withColumn("batch_id", F.lit(None).cast("bigint")))


def _newest_baseline(
    spark: SparkSession, path: str | None
) -> tuple[DataFrame | None, DataFrame | None]:
    """Sums (metric, key, value) of the newest baseline, and per stream the last batch in it."""
    table = read_if_present(spark, path) if path else None
    if table is None:
        return None, None
    newest = table.where(F.col("version") == table.agg(F.max("version")).first()[0])
    sums = newest.where(F.col("metric") != UPTO).select("metric", "key", "value")
    upto = newest.where(F.col("metric") == UPTO).select(
        F.col("key").alias("query_id"), F.col("value").cast("bigint").alias("upto")
    )
    return sums, upto


def fold_counters(
    spark: SparkSession, deltas_path: str, baseline_path: str, keep: int = WINDOW_BATCHES
) -> None:
    """Sum all but the newest `keep` batches of each stream into one baseline, so that readers
    skip their deltas.

    The kept batches serve the batch-size window. Each baseline is a partition of its own, holds
    everything, and readers take the newest, so a run that stops half-way loses or
    doubles no count. Deltas go one run after they were folded, when no reader needs them.
    """
    deltas = read_if_present(spark, deltas_path, STORED_COUNTERS)
    if deltas is None:
        return
    folded, upto = _newest_baseline(spark, baseline_path)
    if upto is not None:
        _drop_folded(spark, deltas, upto, deltas_path)
        deltas = spark.read.schema(STORED_COUNTERS).parquet(deltas_path).join(upto, "query_id", "left").where(
            F.col("upto").isNull() | (F.col("batch_id") > F.col("upto"))
        ).drop("upto")
    newest = W.partitionBy("query_id").orderBy(F.desc("batch_id"))
    ends = (
        deltas.select(*BATCH_KEYS)
        .distinct()
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") == keep + 1)
        .select("query_id", F.col("batch_id").alias("end"))
    )
    if ends.isEmpty():
        return
    old = deltas.join(ends, "query_id").where(F.col("batch_id") <= F.col("end"))
    sums = old.select("metric", "key", "value")
    lasts = ends.select("query_id", F.col("end").alias("upto"))
    if folded is not None:
        sums = sums.unionByName(folded)
        lasts = lasts.unionByName(upto)
    sums = sums.groupBy("metric", "key").agg(F.sum("value").cast(COUNTER_VALUE).alias("value"))
    ended = lasts.groupBy("query_id").agg(F.max("upto").alias("upto"))
    rows = sums.unionByName(
        ended.select(
            F.lit(UPTO).alias("metric"),
            F.col("query_id").alias("key"),
            F.col("upto").cast(COUNTER_VALUE).alias("value"),
        )
    )
    # a version is the number of folds, the same when a stopped run is done again
    done = read_if_present(spark, baseline_path)
    version = 0 if done is None else done.agg(F.max("version")).first()[0] + 1
    write_partitions(
        rows.withColumn("version", F.lit(version).cast("bigint")), baseline_path, "version"
    )


def _drop_folded(
    spark: SparkSession, deltas: DataFrame, upto: DataFrame, deltas_path: str
) -> None:
    """Remove the folders of batches that the newest baseline holds."""
    gone = deltas.join(upto, "query_id").where(F.col("batch_id") <= F.col("upto"))
    for row in gone.select(*BATCH_KEYS).distinct().toLocalIterator():
        delete(spark, f"{deltas_path}/query_id={row.query_id}/batch_id={row.batch_id}")


@dataclass(frozen=True)
class Targets:
    """Where the parts of the fan-out go; without `bronze` the raw messages are not kept, without
    `ids` an id that comes back under a time far away is in the warehouse again, without `commits`
    readers cannot tell batches that all sinks hold from one that is being written."""

    warehouse: str
    counters: str
    quarantine: str
    bronze: str | None = None
    ids: str | None = None
    commits: str | None = None


#: Batches of a stream that its log of commits keeps, the newest.
KEPT_COMMITS = WINDOW_BATCHES
COMMIT = "n_read bigint, n_rejected bigint, query_id string, batch_id bigint"


def commit(
    spark: SparkSession, path: str, batch_id: int, query_id: str, read: int, bad: int
) -> None:
    """Note that all sinks hold a batch, and its row counts; notes of long past batches go.

    A batch begins when the one before has ended, so the newest note stands for all before it.
    """
    counts = spark.range(1).select(F.lit(read).alias("n_read"), F.lit(bad).alias("n_rejected"))
    write_partitions(with_batch(counts.coalesce(1), batch_id, query_id), path, *BATCH_KEYS)
    kept = read_if_present(spark, path, COMMIT)
    old = kept.where((F.col("query_id") == query_id) & (F.col("batch_id") <= batch_id - KEPT_COMMITS))
    for row in old.select(*BATCH_KEYS).distinct().toLocalIterator():
        delete(spark, f"{path}/query_id={row.query_id}/batch_id={row.batch_id}")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed batches of each stream with the messages read and rejected."""
    kept = read_if_present(spark, path, COMMIT)
    return spark.createDataFrame([], COMMIT) if kept is None else kept


def committed(table: DataFrame, commits: DataFrame) -> DataFrame:
    """The rows of a sink's table whose batch all sinks hold.

    One row per stream is joined, so no row of the table is shuffled. Tables read with the same
    commits agree: every batch is in all of them or in none.
    """
    upto = commits.groupBy("query_id").agg(F.max("batch_id").alias("upto"))
    return (
        table.join(upto, "query_id")
        .where(F.col("batch_id") <= F.col("upto"))
        .select(*table.columns)
    )


def fan_out(
    batch: DataFrame, batch_id: int, targets: Targets, query_id: str, score: Score = rule
) -> None:
    """Write one batch of raw messages to all sinks: read, parsed and checked once.

    A batch without rows writes nothing. All sinks see the same ingestion time. `score` adds
    fraud_score and raises is_fraud, by the rules or by a model. The row counts that
    are logged come from the one pass that fills the cache.
    """
    checked = (
        with_reject_reason(parse_transactions(batch, "value"))
        .withColumn("ingested_at", F.current_timestamp())
        .persist()
    )
    try:
        read, bad = checked.agg(F.count(F.lit(1)), F.count_if(F.col(REJECT) != "")).first()
        if not read:
            return
        if targets.bronze:
            raw = with_batch(checked.select("value", "ingested_at"), batch_id, query_id)
            write_partitions(raw, targets.bronze, *BATCH_KEYS)
        good = typed_for_storage(score(fill_amount(accepted(checked).drop("value")))).persist()
        try:
            append_new_payments(good, batch_id, targets.warehouse, query_id, targets.ids)
            write_counters(good, batch_id, targets.counters, query_id)
        finally:
            good.unpersist()
        broken = with_batch(rejected(checked).select("value", REJECT), batch_id, query_id)
        write_partitions(broken, targets.quarantine, *BATCH_KEYS)
        if targets.commits:
            commit(batch.sparkSession, targets.commits, batch_id, query_id, read, bad)
        log.info("batch %s of %s: %s messages, %s rejected", batch_id, query_id, read, bad)
    finally:
        checked.unpersist()
