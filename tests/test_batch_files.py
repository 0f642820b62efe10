from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallybrook.plans import registry
from tallybrook.sources import payments as source


def batches_of(spark, folder, files):
    """The rows of a folder's files, so many at a time in the order they were written."""
    paths = sorted(Path(folder).glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(paths) % files == 0
    return [
        spark.read.schema(source.EVENTS_SCHEMA).parquet(*map(str, paths[i : i + files])).collect()
        for i in range(0, len(paths), files)
    ]


def test_a_batch_is_several_files_and_batches_follow_in_time(spark, sf_dir, folder, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    monkeypatch.setattr(source, "ROWS_PER_FILE", -(-rows // 12))
    files = source.files_per_batch(spark, sf_dir, 4)
    assert files == 3 and source.files_per_batch(spark, sf_dir, 100) == 1
    batches = batches_of(spark, source.events_by_time(spark, sf_dir, f"{folder}/e", 4, files), files)
    assert len(batches) == 4 and sum(map(len, batches)) == rows
    for early, late in zip(batches, batches[1:]):
        assert max(r.ts for r in early) < min(r.ts for r in late)


def test_a_batch_with_fewer_rows_than_files_has_as_many_files(spark, folder):
    times = F.when(F.col("id") == 0, F.lit("2024-01-01")).when(F.col("id") < 99, F.lit("2024-01-02"))
    rows = spark.range(100).select(
        F.col("id").alias("event_id"), times.cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    batches = batches_of(spark, source.in_time_order(rows, f"{folder}/e", 4, 3), 3)
    assert sorted(r.event_id for b in batches for r in b) == list(range(100))
    assert None in {r.ts for r in batches[-1]}


@pytest.mark.parametrize("name", ["stream_late_rows", "stream_totals_with_late"])
def test_streams_give_the_same_from_one_file_a_batch_and_several(spark, sf_dir, monkeypatch, name):
    want = registry.QUERIES[name](spark, sf_dir).collect()
    monkeypatch.setattr(source, "ROWS_PER_FILE", 90)
    assert source.files_per_batch(spark, sf_dir, registry.STREAM_BATCHES) > 1
    got = registry.QUERIES[name](spark, sf_dir).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) != []
