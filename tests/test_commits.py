from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallybrook.streaming import sinks
from tallybrook.streaming.sinks import Targets, committed, fan_out, read_commits

from .conftest import plan_of
from .test_streaming import message, rows_of

PARTS = ("warehouse", "counters", "quarantine")


def messages(spark, *numbers, bad=0):
    texts = [message(n, "2024-01-01T10:00:00") for n in numbers] + ["junk"] * bad
    return spark.createDataFrame([(text,) for text in texts], "value string")


def targets_in(folder):
    return Targets(*[f"{folder}/{p}" for p in PARTS], ids=f"{folder}/ids", commits=f"{folder}/commits")


def batches(spark, targets, commits):
    """Per sink, the batches a reader of committed rows finds."""
    return [
        rows_of(committed(spark.read.parquet(path), commits).select("query_id", "batch_id").distinct())
        for path in (targets.warehouse, targets.counters, targets.quarantine)
    ]


def test_a_kill_between_two_sinks_shows_no_half_batch(spark, folder, monkeypatch):
    targets = targets_in(folder)
    fan_out(messages(spark, 1, 2, bad=1), 0, targets, "q")

    def stop(*given):
        raise RuntimeError("stopped")

    for part in ("write_counters", "rejected", "commit"):
        with monkeypatch.context() as broken:
            broken.setattr(sinks, part, stop)
            with pytest.raises(RuntimeError):
                fan_out(messages(spark, 3, 4, bad=2), 1, targets, "q")
        # rows of batch 1 are there, and no reader of committed rows meets one
        assert spark.read.parquet(targets.warehouse).where("batch_id = 1").count() == 2
        assert batches(spark, targets, read_commits(spark, targets.commits)) == [[("q", 0)]] * 3
    fan_out(messages(spark, 3, 4, bad=2), 1, targets, "q")
    commits = read_commits(spark, targets.commits)
    assert batches(spark, targets, commits) == [[("q", 0), ("q", 1)]] * 3
    assert rows_of(commits) == [(2 + 1, 1, "q", 0), (2 + 2, 2, "q", 1)]


def test_streams_commit_for_themselves_and_old_notes_go(spark, folder, monkeypatch):
    monkeypatch.setattr(sinks, "KEPT_COMMITS", 2)
    path = f"{folder}/commits"
    assert read_commits(spark, path).count() == 0
    for number in range(5):
        sinks.commit(spark, path, number, "a", 10, number)
    sinks.commit(spark, path, 0, "b", 7, 0)
    commits = read_commits(spark, path)
    assert rows_of(commits) == [(7, 0, "b", 0), (10, 3, "a", 3), (10, 4, "a", 4)]
    rows = [("a", 0), ("a", 4), ("a", 5), ("b", 0), ("b", 1), ("c", 0)]
    table = spark.createDataFrame(rows, "query_id string, batch_id bigint")
    assert rows_of(committed(table, commits)) == [("a", 0), ("a", 4), ("b", 0)]
    empty = committed(table, read_commits(spark, f"{folder}/none"))
    assert empty.count() == 0 and empty.columns == table.columns


def test_committed_rows_are_not_shuffled(spark, folder):
    targets = targets_in(folder)
    fan_out(messages(spark, 1, 2), 0, targets, "q")
    found = committed(spark.read.parquet(targets.warehouse), read_commits(spark, targets.commits))
    assert found.select(F.count(F.lit(1))).first()[0] == 2
    assert "BroadcastHashJoin" in plan_of(found)
