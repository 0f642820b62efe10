from __future__ import annotations

import random

import pytest

from tallybrook.operators import counters
from tallybrook.streaming.sinks import fold_counters, read_counters, write_counters

SCHEMA = "service_type string, governorate string, is_fraud boolean, amount_egp double"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def snapshot(spark, path, baseline=None):
    deltas = read_counters(spark, path, baseline)
    keyed = counters.keyed_counts(deltas, "by_service", "service_type").collect()
    return tuple(counters.live_kpis(deltas).first()), {r.service_type: r.cnt for r in keyed}


def test_empty_counters_read_as_zero(spark, folder):
    kpis, services = snapshot(spark, f"{folder}/none")
    assert kpis == (0, 0, 0, 0.0, 0.0) and services == {}


def test_counters_of_a_batch(spark, folder):
    rows = batch(
        spark,
        ("gas", "Giza", True, 10.5),
        ("gas", "", None, None),
        (None, "Giza", False, 1.25),
        ("", None, False, 0.25),
    )
    write_counters(rows, 7, folder, "q")
    kpis, services = snapshot(spark, folder)
    assert kpis[:2] == (4, 1) and float(kpis[2]) == 12.0 and kpis[3:] == (25.0, 4.0)
    assert services == {"gas": 2}


def test_replay_changes_nothing(spark, folder):
    for number in (0, 1, 2):
        write_counters(batch(spark, ("gas", "Giza", True, 1.0)), number, folder, "q")
    before = snapshot(spark, folder)
    for number in (2, 0):
        write_counters(batch(spark, ("gas", "Giza", True, 1.0)), number, folder, "q")
    assert snapshot(spark, folder) == before


def test_folding_keeps_totals_window_and_survives_reruns(spark, folder):
    deltas, baseline = f"{folder}/deltas", f"{folder}/baseline"
    for number in range(6):
        rows = [("gas", "Giza", number % 2 == 0, 1.0)] * (number + 1)
        write_counters(batch(spark, *rows), number, deltas, "q")
    before = snapshot(spark, deltas)

    def window():
        sizes = counters.batch_sizes_from(read_counters(spark, deltas, baseline))
        return [r.n_rows for r in counters.newest_batches(sizes, 3).collect()]

    assert window() == [6, 5, 4]
    for _ in range(2):
        fold_counters(spark, deltas, baseline, keep=3)
        after = snapshot(spark, deltas, baseline)
        assert after[0][:4] == before[0][:4] and after[1] == before[1] and window() == [6, 5, 4]
    write_counters(batch(spark, ("water", "Giza", False, 1.0)), 6, deltas, "q")
    write_counters(batch(spark, ("water", "Giza", False, 1.0)), 1, deltas, "q")  # a folded one again
    fold_counters(spark, deltas, baseline, keep=3)
    assert snapshot(spark, deltas, baseline)[1] == {"gas": 21, "water": 1}
    assert window() == [1, 6, 5]


def test_equal_batch_numbers_of_two_streams_both_count(spark, folder):
    write_counters(batch(spark, *[("gas", "Giza", True, 1.0)] * 10), 0, folder, "first")
    write_counters(batch(spark, *[("gas", "Giza", False, 1.0)] * 5), 0, folder, "second")
    kpis, services = snapshot(spark, folder)
    assert kpis[:2] == (15, 10) and services == {"gas": 15} and kpis[4] == 7.5


def test_folding_two_streams_and_dropping_what_is_folded(spark, folder):
    import os

    deltas, baseline = f"{folder}/deltas", f"{folder}/baseline"
    for number in range(4):
        for stream in ("a", "b"):
            write_counters(batch(spark, ("gas", "Giza", True, 1.0)), number, deltas, stream)
    write_counters(batch(spark, ("gas", "Giza", True, 1.0)), 0, deltas, "short")
    before = snapshot(spark, deltas)
    for _ in range(3):
        fold_counters(spark, deltas, baseline, keep=2)
        after = snapshot(spark, deltas, baseline)
        assert after[0][:4] == before[0][:4] and after[1] == before[1]
    left = {q: sorted(os.listdir(f"{deltas}/query_id={q}")) for q in ("a", "short")}
    assert left == {"a": ["batch_id=2", "batch_id=3"], "short": ["batch_id=0"]}


def test_amounts_that_are_no_number_count_as_nothing(spark, folder):
    write_counters(batch(spark, ("gas", "Giza", False, float("nan")), ("gas", "Giza", False, 2.0)), 0, folder, "q")
    kpis, _ = snapshot(spark, folder)
    assert kpis[0] == 2 and float(kpis[2]) == 2.0


@pytest.mark.parametrize("count", [1, 3, 60])
def test_rolling_mean_over_gaps_equals_brute_force(spark, count):
    rng = random.Random(2)
    ids = sorted(rng.sample(range(9000), 150))
    sizes = [(i, rng.randint(1, 500)) for i in ids]
    frame = spark.createDataFrame(sizes, "batch_id long, n_rows long")
    got = {r.batch_id: r.rolling_mean for r in counters.rolling_batch_mean(frame, count).collect()}
    assert len(got) == len(sizes)
    for at, (batch_id, _) in enumerate(sizes):
        window = [n for _, n in sizes[max(0, at - count + 1) : at + 1]]
        assert got[batch_id] == pytest.approx(sum(window) / len(window), abs=0.0051)


def test_average_of_newest_sixty(spark):
    frame = spark.createDataFrame([(i, i) for i in range(100)], "batch_id long, n_rows long")
    assert counters.avg_rows_per_batch(frame).first().avg_rows == sum(range(40, 100)) / 60


def test_ranking_order(spark):
    frame = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "k string, cnt long")
    up = {r.k: r.position for r in counters.ranked_counts(frame, "k", True).collect()}
    down = {r.k: r.position for r in counters.ranked_counts(frame, "k", False).collect()}
    assert up == {"a": 1, "b": 2, "c": 3} and down == {"c": 1, "a": 2, "b": 3}
