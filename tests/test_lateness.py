from __future__ import annotations

import os

import pytest

from tallybrook.operators.summaries import governorate_daily_summary
from tallybrook.plans import jobs
from tallybrook.streaming import lateness
from tallybrook.streaming import queries as streams

from .test_streaming import feed, message, rows_of  # noqa: F401


def landed(spark, path):
    return sorted(r[0] for r in spark.read.parquet(path).select("transaction_id").collect())


def files_of(path):
    return sorted(name for _, _, names in os.walk(path) for name in names if name.endswith(".parquet"))


def test_an_id_that_comes_back_is_once_in_the_warehouse(spark, feed, folder):  # noqa: F811
    feed.add(message(1, "2024-01-01T10:00:00"), message(2, "2024-01-20T10:00:00"))
    feed.add(message(1, "2024-01-01T12:00:00"), message(3, "2024-01-20T10:00:00"))
    feed.add(message(1, "2023-12-01T12:00:00"), message(4, "2023-01-01T00:00:00"))
    once = lateness.first_arrivals(streams.clean_stream(feed.open()))
    query = streams.warehouse_sink(once, f"{folder}/table", f"{folder}/check", None)
    assert streams.finish(query) == 0  # no row is late, however old
    assert landed(spark, f"{folder}/table") == ["t1", "t2", "t3", "t4"]
    (first,) = spark.read.parquet(f"{folder}/table").where("transaction_id = 't1'").collect()
    assert str(first.event_time) == "2024-01-01 10:00:00"


def test_totals_of_three_batches_with_late_rows_equal_the_batch(spark, feed, folder):  # noqa: F811
    feed.add(message(1, "2024-01-01T10:00:00"), message(2, "2024-01-03T10:00:00"))
    feed.add(message(3, "2024-01-09T10:00:00"), message(4, "2024-01-03T11:00:00"))
    feed.add(
        message(5, "2024-01-01T23:59:59"),
        message(6, "2024-01-08T00:00:00"),
        message(7, "2024-01-07T23:59:59", governorate="Cairo"),
        message(8, "2024-01-02T10:00:00", status="failed"),
        message(2, "2024-01-03T10:00:00"),
        message(9, "2024-01-01T10:00:00", governorate=None),
    )
    assert jobs.streamed_totals(spark, folder) is None
    jobs.stream_totals(spark, feed.open(), folder, None)
    landing = lateness.landing_at(f"{folder}/stream")
    # 4 came in the batch that moved on; 7 lies a second behind the last open day
    assert landed(spark, landing.late) == ["t5", "t7", "t8", "t9"]
    assert landed(spark, landing.in_time) == ["t1", "t2", "t3", "t4", "t6"]
    once = spark.read.parquet(landing.in_time).unionByName(spark.read.parquet(landing.late))
    want = governorate_daily_summary(once.dropna(subset=["governorate"]))
    got = jobs.streamed_totals(spark, folder).select(want.columns)
    assert rows_of(got) == rows_of(want) and got.count() == 5
    assert len(files_of(landing.horizon)) <= 2
    # nothing new: nothing changes
    jobs.stream_totals(spark, feed.open(), folder, None)
    assert rows_of(jobs.streamed_totals(spark, folder).select(want.columns)) == rows_of(want)


@pytest.mark.parametrize("part", ["late", "horizon"])
def test_a_stopped_batch_is_landed_once(spark, feed, folder, monkeypatch, part):  # noqa: F811
    feed.add(message(1, "2024-01-01T10:00:00"))
    feed.add(message(2, "2024-01-09T10:00:00"))
    feed.add(message(3, "2024-01-01T10:00:00"), message(4, "2024-01-09T10:00:00"))
    landing = lateness.landing_at(folder)
    write, calls = lateness.write_partitions, []

    def stop(rows, path, *keys):
        calls.append(path)
        if calls.count(f"{folder}/{part}") == 3:
            raise RuntimeError("stopped")
        write(rows, path, *keys)

    def run():
        once = lateness.first_arrivals(streams.clean_stream(feed.open()))
        streams.finish(lateness.split_sink(once, landing, f"{folder}/check", "1 day", None))

    with monkeypatch.context() as broken:
        broken.setattr(lateness, "write_partitions", stop)
        with pytest.raises(Exception, match="stopped"):
            run()
    files = files_of(landing.in_time)
    run()
    assert files_of(landing.in_time) == files
    assert landed(spark, landing.in_time) == ["t1", "t2", "t4"]
    assert landed(spark, landing.late) == ["t3"]


def test_no_late_rows_is_an_empty_table(spark, feed, folder):  # noqa: F811
    feed.add(message(1, "2024-01-01T10:00:00"))
    jobs.stream_totals(spark, feed.open(), folder, None)
    late = lateness.late_rows(
        spark, lateness.landing_at(f"{folder}/stream"), jobs.CLEAN_STREAM_SCHEMA
    )
    assert late.count() == 0
    assert [tuple(r)[2:] for r in jobs.streamed_totals(spark, folder).collect()][0][0] == 1
