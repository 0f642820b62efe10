from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import counters, idtable
from tallybrook.plans import jobs
from tallybrook.streaming.sinks import Targets, fan_out, read_counters

from .test_streaming import message
from .test_tables import delivery, lake_at, rows_of

COLUMNS = "event_date date"
DAY = dt.date(2024, 1, 10)


def rows(spark, *ids, day=DAY):
    return spark.createDataFrame([(i, day) for i in ids], f"transaction_id string, {COLUMNS}")


def stored(spark, folder, n):
    ids = spark.range(n).select(
        F.concat(F.lit("t"), F.col("id")).alias("transaction_id"), F.lit(DAY).alias("event_date")
    )
    idtable.add(ids, folder, COLUMNS)


def test_lookup_finds_every_date_of_an_id_and_nothing_else(spark, folder):
    path = f"{folder}/ids"
    assert idtable.lookup(rows(spark, "a"), path, COLUMNS) is None
    idtable.add(rows(spark, "a", "b", "c"), path, COLUMNS)
    idtable.add(rows(spark, "a", day=dt.date(2024, 2, 1)), path, COLUMNS)
    got = idtable.lookup(rows(spark, "a", "a", "zz"), path, COLUMNS)
    assert rows_of(got) == [("a", DAY), ("a", dt.date(2024, 2, 1))]
    assert idtable.lookup(rows(spark), path, COLUMNS) is None
    idtable.add(rows(spark), path, COLUMNS)
    assert rows_of(idtable.lookup(rows(spark, "c"), path, COLUMNS)) == [("c", DAY)]


def test_files_read_grow_with_the_delivery(spark, folder):
    path = f"{folder}/ids"
    stored(spark, path, 3000)
    counts = [
        len(idtable.share(rows(spark, *[f"t{i}" for i in range(n)]), path, COLUMNS).inputFiles())
        for n in (1, 10, 100)
    ]
    assert counts[0] == 1 and counts[1] <= 10 < counts[2] <= 64
    whole = len(spark.read.parquet(path).inputFiles())
    assert whole == 64
    many = rows(spark, *[f"t{i}" for i in range(500)])
    assert idtable.lookup(many, path, COLUMNS).count() == 500


def test_bloom_filters_keep_row_groups_unread(spark, folder, monkeypatch):
    monkeypatch.setattr(idtable, "BUCKETS", 1)
    path = f"{folder}/ids"
    stored(spark, path, 20_000)
    sizes = [
        os.path.getsize(os.path.join(at, name))
        for at, _, names in os.walk(path)
        for name in names
        if name.endswith(".parquet")
    ]
    assert sum(sizes) < 1_000_000

    def scanned(number):
        plan = idtable.share(rows(spark, number), path, COLUMNS)._jdf.queryExecution().executedPlan()
        assert "EqualTo(transaction_id" in plan.toString()
        plan.execute().count()
        return plan.collectLeaves().head().metrics().get("numOutputRows").get().value()

    assert scanned("t7") > 0
    # these lie between the least and the greatest id; only a filter can tell
    assert [scanned(f"t5x{i}") for i in range(5)].count(0) >= 4


def test_crowded_buckets_are_rewritten_whole(spark, folder, monkeypatch):
    monkeypatch.setattr(idtable, "BUCKETS", 2)
    monkeypatch.setattr(idtable, "CROWDED", 4)
    path = f"{folder}/ids"
    most = 0
    for number in range(10):
        idtable.add(rows(spark, f"a{number}", f"b{number}", "again"), path, COLUMNS)
        most = max(most, len(spark.read.parquet(path).inputFiles()))
    assert most <= 2 * 4
    got = rows_of(spark.read.parquet(path).select("transaction_id").distinct())
    assert got == sorted([("again",), *[(f"{c}{n}",) for c in "ab" for n in range(10)]])


def test_a_stop_before_the_old_files_go_loses_no_id(spark, folder, monkeypatch):
    monkeypatch.setattr(idtable, "BUCKETS", 1)
    monkeypatch.setattr(idtable, "CROWDED", 2)
    path = f"{folder}/ids"
    idtable.add(rows(spark, "a"), path, COLUMNS)

    def stop(spark, file):
        raise RuntimeError("stopped")

    with monkeypatch.context() as broken:
        broken.setattr(idtable, "delete", stop)
        try:
            idtable.add(rows(spark, "b"), path, COLUMNS)
        except RuntimeError:
            pass
    idtable.add(rows(spark, "b"), path, COLUMNS)
    assert rows_of(spark.read.parquet(path).select("transaction_id")) == [("a",), ("b",)]


def test_a_small_delivery_reads_few_files_of_the_lake(spark, folder, monkeypatch):
    lake = lake_at(folder)
    first = [(f"t{i}", f"2024-01-{1 + i % 28:02d}T10:00:00", {}) for i in range(1500)]
    jobs.refresh_silver(delivery(spark, first), 0, lake)
    seen = []
    share = idtable.share

    def watched(*given):
        found = share(*given)
        seen.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(idtable, "share", watched)
    again = [("t3", "2024-02-20T10:00:00", {}), ("new", "2024-02-20T10:00:00", {})]
    touched = rows_of(jobs.refresh_silver(delivery(spark, again, "2024-03-02"), 1, lake))
    assert touched == [(dt.date(2024, 1, 4),), (dt.date(2024, 2, 20),)]
    assert seen[0] <= 2 and len(spark.read.parquet(lake.ids).inputFiles()) >= 64
    assert spark.read.parquet(lake.silver).count() == 1501


def far_apart(spark, *ids, day):
    texts = [message(i, f"2024-01-{day:02d}T10:00:00") for i in ids]
    return spark.createDataFrame([(text,) for text in texts], "value string")


def test_the_fan_out_keeps_an_id_once_whatever_its_time(spark, folder, monkeypatch):
    targets = Targets(f"{folder}/dw", f"{folder}/counters", f"{folder}/bad", ids=f"{folder}/ids")

    def state():
        kept = spark.read.parquet(targets.warehouse)
        return rows_of(kept.select("transaction_id", F.dayofmonth("event_time")))

    fan_out(far_apart(spark, 1, 2, day=1), 0, targets, "q")
    fan_out(far_apart(spark, 2, 3, day=9), 1, targets, "q")
    want = [("t1", 1), ("t2", 1), ("t3", 9)]
    assert state() == want
    # batches that run again keep their own rows; another stream brings none of them twice
    fan_out(far_apart(spark, 2, 3, day=9), 1, targets, "q")
    fan_out(far_apart(spark, 1, 2, day=1), 0, targets, "q")
    fan_out(far_apart(spark, 1, 3, day=20), 0, targets, "other")
    assert state() == want

    def stop(*given):
        raise RuntimeError("stopped")

    with monkeypatch.context() as broken:
        broken.setattr(idtable, "add", stop)
        with pytest.raises(RuntimeError):
            fan_out(far_apart(spark, 4, day=5), 2, targets, "q")
    fan_out(far_apart(spark, 4, day=5), 2, targets, "q")
    fan_out(far_apart(spark, 4, day=6), 3, targets, "q")
    assert state() == sorted([*want, ("t4", 5)])
    kpis = counters.live_kpis(read_counters(spark, targets.counters)).first()
    assert kpis.total_transactions == 2 + 2 + 2 + 1 + 1  # messages, each batch once
