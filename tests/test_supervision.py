from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from tallybrook import __main__ as command_line
from tallybrook.streaming.supervision import StreamsFailed, supervise

LIMIT = 60


def ticking(spark, folder, name, condition="true"):
    """A stream that runs on, and fails at the first row that does not meet the condition."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 20).load()
    checked = ticks.select(F.when(F.expr(condition), F.col("value")).otherwise(F.raise_error(F.lit("bad row"))).alias("value"))
    writer = checked.writeStream.queryName(name).format("noop")
    return writer.option("checkpointLocation", f"{folder}/{name}").trigger(processingTime="200 milliseconds").start()


def test_a_failure_stops_the_other_stream_and_is_reported(spark, folder):
    good = ticking(spark, folder, "good")
    bad = ticking(spark, folder, "bad", "value < 10")
    with pytest.raises(StreamsFailed, match="1 of 2 streams failed: bad:") as caught:
        supervise([good, bad], poll=0.1)
    assert not good.isActive and not bad.isActive
    first, second = caught.value.ends
    assert (first.name, first.stopped, first.error) == ("good", True, None) and first.last_batch >= 0
    assert (second.name, second.stopped) == ("bad", False) and "bad row" in second.error


def test_a_stream_that_is_stopped_ends_the_others_without_an_error(spark, folder):
    queries = [ticking(spark, folder, name) for name in ("one", "two", "three")]
    threading.Timer(1.0, queries[1].stop).start()
    start = time.monotonic()
    ends = supervise(queries, poll=0.1)
    assert time.monotonic() - start < LIMIT
    assert [end.stopped for end in ends] == [True, False, True]
    assert not any(end.error for end in ends) and not any(query.isActive for query in queries)


def test_an_interrupted_wait_leaves_no_stream_running(spark, folder, monkeypatch):
    query = ticking(spark, folder, "alone")

    def interrupt(seconds):
        raise KeyboardInterrupt

    monkeypatch.setattr(time, "sleep", interrupt)
    with pytest.raises(KeyboardInterrupt):
        supervise([query])
    assert not query.isActive


def test_no_stream_and_streams_that_have_ended(spark, folder):
    assert supervise([]) == []
    query = ticking(spark, folder, "over")
    query.stop()
    (end,) = supervise([query])
    assert not end.stopped and end.error is None


def test_the_stream_job_ends_with_the_failure_of_one_of_its_streams(spark, folder, monkeypatch):
    started = []

    def fan_out(messages, targets, checkpoint, interval, score):
        started.append(ticking(spark, folder, "fan_out"))
        return started[-1]

    def totals(own, messages, root, interval):
        started.extend([ticking(spark, folder, "clean"), ticking(spark, folder, "totals", "value < 5")])
        return started[1:]

    monkeypatch.setattr(command_line.streams, "fan_out_sink", fan_out)
    monkeypatch.setattr(command_line.jobs, "stream_totals", totals)
    spark.createDataFrame([("{}",)], "value string").write.text(f"{folder}/in")
    given = ["stream", "--root", f"{folder}/lake", "--format", "text", "--option", f"path={folder}/in"]
    with pytest.raises(StreamsFailed, match="totals"):
        command_line.main(given, spark)
    assert len(started) == 3 and not any(query.isActive for query in started)
