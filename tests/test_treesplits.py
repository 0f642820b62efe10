from __future__ import annotations

import random

import pytest

from tallybrook.operators.treesplits import best_splits, class_totals, first_levels

SCHEMA = "node bigint, x int, y int, label int"


def gini(fraud: float, other: float) -> float:
    whole = fraud + other
    return 1 - (fraud / whole) ** 2 - (other / whole) ** 2


def brute(rows, p, q):
    """(gain, feature, threshold) of the best split of one node, every split tried."""
    best = None
    for i, feature in ((1, "x"), (2, "y")):
        for threshold in sorted({r[i] for r in rows if r[i] is not None})[:-1]:
            known = [r for r in rows if r[i] is not None]
            left = [r for r in known if r[i] <= threshold]
            right = [r for r in known if r[i] > threshold]
            sides = [(sum(r[3] for r in s) / p, sum(1 - r[3] for r in s) / q) for s in (left, right)]
            f, o = (sum(x) for x in zip(*sides))
            split = sum((a + b) * gini(a, b) for a, b in sides) / (f + o)
            gain = round(gini(f, o) - split, 9)
            if gain > 0 and (best is None or (-gain, feature, threshold) < (-best[0], *best[1:])):
                best = (gain, feature, threshold)
    return best


def random_rows(n):
    rng = random.Random(4)
    rows = []
    for _ in range(n):
        x, y = rng.randrange(12), rng.choice([None, 1, 2, 3])
        rows.append((1, x, y, int(rng.random() < (0.6 if x > 7 and y != 2 else 0.1))))
    return rows


def test_the_best_split_of_each_node(spark):
    rows = [(1 + i % 3, *r[1:]) for i, r in enumerate(random_rows(600))]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    p, q = sum(r[3] for r in rows), sum(1 - r[3] for r in rows)
    got = best_splits(table, ["x", "y"], class_totals(table)).collect()
    assert sorted(r.node for r in got) == [1, 2, 3]
    for r in got:
        want = brute([row for row in rows if row[0] == r.node], p, q)
        assert (pytest.approx(r.gain, abs=2e-9), r.feature, r.threshold) == want


def test_levels_follow_the_splits(spark):
    rows = random_rows(500)
    table = spark.createDataFrame(rows, SCHEMA).drop("node")
    found = {r.node: r for r in first_levels(table, ["x", "y"], 2).collect()}
    p, q = sum(r[3] for r in rows), sum(1 - r[3] for r in rows)
    root = found[1]
    i = {"x": 1, "y": 2}[root.feature]
    for node in (2, 3):
        side = [r for r in rows if r[i] is not None and (r[i] > root.threshold) == (node == 3)]
        want = brute(side, p, q)
        assert (want is None) == (node not in found)
        if want:
            got = found[node]
            assert got.depth == 1 and (got.feature, got.threshold) == want[1:]


def test_no_split_without_two_labels_and_on_an_empty_table(spark):
    same = spark.createDataFrame([(1, 1, 2, 0), (1, 2, 2, 0)], SCHEMA).drop("node")
    assert first_levels(same, ["x", "y"]).collect() == []
    empty = spark.createDataFrame([], SCHEMA).drop("node")
    assert first_levels(empty, ["x", "y"]).collect() == []
