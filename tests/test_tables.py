from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tallybrook import session
from tallybrook.operators import splitting, summaries
from tallybrook.operators import upsert as upsert_module
from tallybrook.operators.parse import parse_transactions, score
from tallybrook.operators.quality import silver
from tallybrook.operators.upsert import (
    read_if_present,
    upsert,
    upsert_partitions,
    write_partitions,
)
from tallybrook.plans import dashboard, jobs
from tallybrook.sources import payments as source

from .conftest import plan_of

DAY = dt.date(2024, 1, 10)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_upsert_keeps_updates_and_inserts(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], "k string, n int, note string")
    new = spark.createDataFrame([("b", 5, "y"), ("c", None, "y")], "k string, n int, note string")
    got = upsert(target, new, ["k"], ["n"])
    assert rows_of(got.where("k <> 'c'")) == [("a", 1, "x"), ("b", 5, "x")]
    assert rows_of(got.where("k = 'c'")) == [("c", None, "y")]


def test_upsert_sets_null_from_the_source(spark):
    target = spark.createDataFrame([("a", 1)], "k string, n int")
    new = spark.createDataFrame([("a", None)], "k string, n int")
    assert rows_of(upsert(target, new, ["k"], ["n"])) == [("a", None)]


def test_null_is_a_key_like_any_other(spark, folder):
    schema = "k string, n int, d date"
    old = spark.createDataFrame([(None, 5, DAY), ("a", 1, DAY), (None, 9, None)], schema)
    new = spark.createDataFrame([(None, 7, DAY)], schema)
    want = [("a", 1, DAY), (None, 7, DAY), (None, 9, None)]
    got = upsert(old, new, ["d", "k"], ["n"]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    for part in (old, new, new):
        upsert_partitions(spark, f"{folder}/t", f"{folder}/s", part, ["d", "k"], ["n"], "d")
    got = spark.read.parquet(f"{folder}/t").select("k", "n", "d").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_upsert_stopped_between_removing_and_writing_loses_nothing(spark, folder, monkeypatch):
    path, staging = f"{folder}/t", f"{folder}/staging"
    schema = "k string, n int, d date"

    def put(*rows):
        frame = spark.createDataFrame([(k, n, DAY) for k, n in rows], schema)
        upsert_partitions(spark, path, staging, frame, ["d", "k"], ["n"], "d")

    put(("a", 1), ("b", 2))

    def stop(rows, place, *partition_by):
        session.delete(spark, f"{place}/d={DAY}")
        raise RuntimeError("stopped")

    with monkeypatch.context() as broken:
        broken.setattr(upsert_module, "write_partitions", stop)
        with pytest.raises(RuntimeError):
            put(("a", 5))
    put(("a", 5))
    assert rows_of(spark.read.parquet(path).select("k", "n")) == [("a", 5), ("b", 2)]
    # also when other rows come next, and when the stop was before the staged copy was complete
    with monkeypatch.context() as broken:
        broken.setattr(upsert_module, "write_partitions", stop)
        with pytest.raises(RuntimeError):
            put(("b", 6))
    put(("c", 7))
    with monkeypatch.context() as broken:
        broken.setattr(upsert_module, "mark", stop)
        with pytest.raises(RuntimeError):
            put(("c", 8))
    put(("d", 9))
    assert rows_of(spark.read.parquet(path).select("k", "n")) == [("a", 5), ("b", 6), ("c", 7), ("d", 9)]
    assert not os.path.exists(staging)


def test_upsert_into_partitions_twice(spark, folder):
    path, staging = f"{folder}/t", f"{folder}/staging"
    schema = "k string, n int, d date"
    first = spark.createDataFrame([("a", 1, DAY), ("b", 2, DAY), ("a", 9, dt.date(2024, 1, 9))], schema)
    second = spark.createDataFrame([("b", 7, DAY), ("c", 3, DAY)], schema)
    upsert_partitions(spark, path, staging, first, ["d", "k"], ["n"], "d")
    for _ in range(2):
        upsert_partitions(spark, path, staging, second, ["d", "k"], ["n"], "d")
        got = rows_of(spark.read.parquet(path).select("k", "n", "d"))
        assert got == [("a", 1, DAY), ("a", 9, dt.date(2024, 1, 9)), ("b", 7, DAY), ("c", 3, DAY)]
    upsert_partitions(spark, path, staging, second.limit(0), ["d", "k"], ["n"], "d")
    assert spark.read.parquet(path).count() == 4


def test_missing_table_is_none_but_other_errors_are_raised(spark, folder):
    assert read_if_present(spark, f"{folder}/absent") is None
    with open(f"{folder}/junk.parquet", "w") as file:
        file.write("this is no parquet file")
    with pytest.raises(Exception):
        read_if_present(spark, f"{folder}/junk.parquet").collect()


def test_day_slice_reaches_the_scan(spark, sf_dir):
    rows = source.payments(spark, sf_dir)
    plan = plan_of(summaries.day_slice(rows, DAY).select("transaction_id"))
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
    days = summaries.day_slice(rows, DAY).select(F.to_date("event_time")).distinct().collect()
    assert [row[0] for row in days] == [DAY]


def test_all_unknown_flags_count_as_no_fraud(spark):
    rows = [(dt.datetime(2024, 1, 1), "m", "gas", 1.0, None, "success")] * 2
    schema = "event_time timestamp_ntz, merchant_id string, service_type string, amount_egp double, is_fraud boolean, status string"
    (row,) = summaries.merchant_daily_summary(spark.createDataFrame(rows, schema)).collect()
    assert (row.total_transactions, row.fraud_count) == (2, 0)


def test_history_is_newest_first_and_unambiguous(spark):
    rows = [(dt.date(2024, 1, d), s, 1, 1, 0) for d in range(1, 30) for s in "cab"]
    frame = spark.createDataFrame(
        rows,
        "summary_date date, service_type string, total_transactions int, total_amount_egp int, fraud_count int",
    )
    got = [(r.summary_date.day, r.service_type) for r in summaries.newest(frame, "service_type", 4).collect()]
    assert got == [(29, "a"), (29, "b"), (29, "c"), (28, "a")]


lake_at = jobs.lake_at


def delivery(spark, rows, at="2024-03-01"):
    """Messages of (id, event time, changed fields), come in at a time."""
    fields = {"status": "success", "governorate": "Giza", "merchant_id": "m", "service_type": "gas_bill", "amount_egp": 10.0}
    texts = [json.dumps({"transaction_id": i, "event_time": time, **fields, **changed}) for i, time, changed in rows]
    frame = spark.createDataFrame([(t,) for t in texts], "value string")
    return frame.select(F.col("value").cast("binary").alias("value"), F.lit(at).cast("timestamp").alias("ingested_at"))


def test_one_row_per_id_over_all_dates(spark, folder):
    lake = lake_at(folder)

    def state():
        clean = spark.read.parquet(lake.silver)
        totals = spark.read.parquet(f"{lake.gold}/{jobs.GOVERNORATE_TABLE}")
        return (
            rows_of(clean.select("transaction_id", F.col("event_date").cast("string"))),
            rows_of(totals.select(F.col("summary_date").cast("string"), "total_transactions")),
        )

    def take(number, *rows):
        touched = jobs.refresh_silver(delivery(spark, [(*r, {}) for r in rows]), number, lake)
        jobs._summarise(spark, lake, touched)

    take(0, ("t1", "2024-01-01T10:00:00"), ("t2", "2024-01-02T10:00:00"))
    take(1, ("t1", "2024-01-02T10:00:00"))  # again, under a later date: the earlier one stays
    assert state() == ([("t1", "2024-01-01"), ("t2", "2024-01-02")], [("2024-01-01", 1), ("2024-01-02", 1)])
    take(2, ("t2", "2024-01-01T09:00:00"))  # an earlier one: its old date is left empty
    for _ in range(2):
        assert state() == ([("t1", "2024-01-01"), ("t2", "2024-01-01")], [("2024-01-01", 2)])
        take(2, ("t2", "2024-01-01T09:00:00"))


def test_payments_without_a_summary_key_are_listed(spark, folder):
    lake = lake_at(folder)
    rows = [
        ("t1", "2024-01-01T10:00:00", {}),
        ("t2", "2024-01-01T10:00:00", {"governorate": None}),
        ("t3", "2024-01-01T10:00:00", {"merchant_id": None, "service_type": None}),
        ("t4", "2024-01-01T10:00:00", {"governorate": None, "status": "failed"}),
    ]
    jobs._summarise(spark, lake, jobs.refresh_silver(delivery(spark, rows), 0, lake))
    read = {n: spark.read.parquet(f"{lake.gold}/{n}") for n in (jobs.MERCHANT_TABLE, jobs.GOVERNORATE_TABLE, jobs.MISSING_TABLE)}
    assert [r.total_transactions for r in read[jobs.MERCHANT_TABLE].collect()] == [2]
    assert [r.total_transactions for r in read[jobs.GOVERNORATE_TABLE].collect()] == [2]
    assert rows_of(read[jobs.MISSING_TABLE].select("transaction_id", "missing")) == [
        ("t2", "governorate"),
        ("t3", "merchant_id,service_type"),
    ]


def test_the_time_of_ingestion_and_the_source_flag_are_kept(spark, folder):
    lake = lake_at(folder)
    rows = [
        ("t1", "2024-01-01T10:00:00", {"amount_egp": 20000.0, "is_fraud": False}),
        ("t2", "2024-01-01T10:00:00", {"is_fraud": True}),
        ("t3", "2024-01-01T10:00:00", {"amount_egp": 1.0}),
    ]
    jobs.refresh_silver(delivery(spark, rows, "2024-03-05 06:07:08"), 0, lake)
    clean = spark.read.parquet(lake.silver)
    assert [r[0] for r in clean.select("ingested_at").distinct().collect()] == [dt.datetime(2024, 3, 5, 6, 7, 8)]
    flags = {r.transaction_id: (r.is_fraud, r.source_flag) for r in clean.collect()}
    assert flags == {"t1": (True, False), "t2": (True, True), "t3": (False, None)}
    profile = splitting.label_profile(jobs.source_labels(clean).where("is_fraud IS NOT NULL"), "is_fraud").first()
    assert (profile.n_rows, profile.label_mean) == (2, 0.5)


def test_training_takes_the_source_label(spark, sf_dir, folder):
    lake = lake_at(folder)
    messages = source.wire_messages(spark, sf_dir).withColumn("ingested_at", F.current_timestamp())
    jobs.refresh_silver(messages, 0, lake)
    clean = spark.read.parquet(lake.silver)
    own = source.payments(spark, sf_dir).join(clean.select("transaction_id"), "transaction_id", "left_semi")
    labels = [
        splitting.label_profile(rows.where("is_fraud IS NOT NULL"), "is_fraud").first()
        for rows in (own, jobs.source_labels(clean))
    ]
    assert labels[0] == labels[1]
    assert clean.where("is_fraud <> source_flag").count() > 0


def test_daily_jobs_take_in_late_rows_and_can_be_repeated(spark, sf_dir, folder):
    lake = lake_at(folder)

    def arrive(condition):
        rows = source.payments(spark, sf_dir, "event_id").where(condition)
        raw = source.with_defects(rows).withColumn("ingested_at", F.current_timestamp())
        raw.write.mode("append").parquet(lake.bronze)

    arrive("event_id % 10 <> 4")
    jobs.catch_up(spark, lake)
    assert spark.read.parquet(f"{lake.gold}/{jobs.GOVERNORATE_TABLE}").count() > 0
    arrive("event_id % 10 = 4 OR event_id < 50")  # late rows, and some delivered again
    jobs.catch_up(spark, lake)
    whole = silver(parse_transactions(source.wire_messages(spark, sf_dir)))
    columns = [c for c in whole.columns if c != "ingested_at"]
    assert rows_of(spark.read.parquet(lake.silver).select(columns)) == rows_of(whole.select(columns))
    want = rows_of(summaries.governorate_daily_summary(whole))
    for _ in range(2):
        table = spark.read.parquet(f"{lake.gold}/{jobs.GOVERNORATE_TABLE}")
        got = table.select("summary_date", "governorate", *summaries.MEASURES)
        assert rows_of(got) == want
        counts = jobs.run_daily(spark, lake, [DAY])
        assert {r.summary_date for r in counts.collect()} == {DAY}
        jobs.catch_up(spark, lake)  # nothing new
    frames = dashboard.history_frames(spark, lake.gold)
    assert frames["services"].count() == 200 and frames["governorates"].count() == 200


def test_repeated_step_changes_nothing(spark, sf_dir, folder):
    lake = lake_at(folder)
    messages = source.wire_messages(spark, sf_dir)
    first = rows_of(jobs.refresh_silver(messages, 0, lake))
    before = rows_of(spark.read.parquet(lake.silver).drop("ingested_at"))
    assert rows_of(jobs.refresh_silver(messages, 0, lake)) == first
    assert rows_of(spark.read.parquet(lake.silver).drop("ingested_at")) == before
    assert spark.read.parquet(lake.quarantine).count() == 5 - 1


def test_daily_job_reads_only_its_partitions(spark, sf_dir, folder):
    write_partitions(silver(parse_transactions(source.wire_messages(spark, sf_dir))), folder, "event_date")
    rows = spark.read.parquet(folder).where(F.col("event_date").isin([DAY]))
    plan = plan_of(summaries.merchant_daily_summary(rows)).split("== Physical Plan ==")[1]
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_date" in filters


def test_frames_are_empty_before_the_first_job(spark, folder):
    history = dashboard.history_frames(spark, f"{folder}/none")
    live = dashboard.live_frames(spark, f"{folder}/none")
    assert history["services"].count() == 0 and history["governorates"].count() == 0
    assert live["kpis"].first().total_transactions == 0 and live["services"].count() == 0


def test_default_day_is_yesterday():
    assert jobs.previous_day() == dt.datetime.now(dt.UTC).date() - dt.timedelta(days=1)


def test_score_is_shared_by_batch_tables(spark, sf_dir):
    frame = score(source.payments(spark, sf_dir))
    assert frame.where("fraud_score > 1 OR fraud_score < 0").count() == 0
