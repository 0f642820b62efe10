from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallybrook.operators.evaluation import classification_report, confusion_matrix, roc_auc
from tallybrook.operators.ranking import amount_percentile, skew_safe_lookup
from tallybrook.operators.running import log_bucket, running_totals
from tallybrook.operators.splitting import class_weights, label_profile, stratified_split
from tallybrook.sources.payments import payments

from .conftest import plan_of


@pytest.fixture(scope="module")
def uneven():
    """Payments of which a third share one service and amount, with missing values."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        service = rng.choice(["gas", "water", "fees", None])
        amount = rng.choice([rng.randint(0, 40) / 2, rng.uniform(-50, 9000), None, float("nan")])
        if i % 3 == 0:
            service, amount = "gas", 0.0
        rows.append((str(i), service, amount))
    return rows


SCHEMA = "transaction_id string, service_type string, amount_egp double"


def test_percentile_equals_pandas_rank(spark, uneven):
    got = amount_percentile(spark.createDataFrame(uneven, SCHEMA)).collect()
    frame = pd.DataFrame(uneven, columns=["id", "service", "amount"])
    want = frame.groupby("service")["amount"].rank(pct=True)
    by_id = {row.transaction_id: row.amount_pct for row in got}
    assert len(by_id) == len(uneven)
    for i, value in want.items():
        if pd.isna(value):
            assert by_id[str(i)] is None
        else:
            assert by_id[str(i)] == pytest.approx(value, abs=1e-12)


@pytest.mark.parametrize("hot_share", [1, 2, 5, 10_000])
def test_skew_safe_lookup_joins_hot_cold_missing_and_null_keys(spark, hot_share):
    keys = ["a"] * 60 + ["b"] * 30 + ["c"] * 9 + ["d", None, "absent"]
    rows = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    table = [("a", 60, 1.0), ("b", 30, 2.0), ("c", 9, 3.0), ("d", 1, 4.0), ("e", 1, 5.0)]
    lookup = spark.createDataFrame(table, "k string, n long, v double")
    got = skew_safe_lookup(rows, lookup, ["k"], "v", "n", "id", hot_share).collect()
    values = {k: v for k, _, v in table}
    assert sorted(row.id for row in got) == list(range(len(keys)))
    assert all(row.v == values.get(row.k) for row in got)


def test_rows_answered_by_the_hot_part_are_spread_in_the_shuffle(spark, uneven):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(amount_percentile(spark.createDataFrame(uneven, SCHEMA)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = [line for line in plan.splitlines() if "SortMergeJoin" in line and "LeftOuter" in line]
    assert keys and all("_at" in line and "_slot" in line for line in keys)


def test_running_totals_equal_cumulative_sums(spark):
    rng = random.Random(3)
    numbers = sorted(rng.uniform(-1e6, 1e6) for _ in range(500))
    rows = [(g, x, rng.randint(0, 9)) for g in "pq" for x in numbers]
    frame = spark.createDataFrame(rows, "g string, x double, n long")
    got = running_totals(
        frame, {"before": "n"}, "x", log_bucket("x"), ["g"], {"all": "n"}
    ).collect()
    table = pd.DataFrame(rows, columns=["g", "x", "n"])
    table["before"] = table.groupby("g")["n"].cumsum() - table["n"]
    want = {(r.g, r.x): r.before for r in table.itertuples()}
    size = table.groupby("g")["n"].sum()
    assert len(got) == len(rows)
    assert all(r.before == want[r.g, r.x] and r["all"] == size[r.g] for r in got)


def test_log_bucket_never_decreases(spark):
    frame = spark.range(-40000, 40000).select((F.col("id") / 7).alias("x"))
    pairs = frame.select("x", log_bucket("x").alias("b")).toPandas().sort_values("x")
    assert pairs["b"].is_monotonic_increasing and pairs["b"].nunique() > 500


@pytest.mark.parametrize("share", [0.8, 0.5, 0.01])
def test_split_takes_the_exact_share_of_each_label(spark, sf_dir, share):
    rows = payments(spark, sf_dir).where("is_fraud IS NOT NULL")
    split = stratified_split(rows, "is_fraud", "transaction_id", share).toPandas()
    assert len(split) == rows.count() and split["transaction_id"].is_unique
    for _, part in split.groupby("is_fraud"):
        assert (part["split"] == "train").sum() == int(len(part) * share)


def test_split_of_single_rows_and_unknown_labels(spark):
    rows = [("a", True), ("b", None)]
    frame = spark.createDataFrame(rows, "id string, flag boolean")
    got = {row.id: row.split for row in stratified_split(frame, "flag", "id").collect()}
    assert got == {"a": "test", "b": "test"}


def test_class_weights_and_profile(spark):
    frame = spark.createDataFrame([(True,), (False,), (False,), (False,)], "flag boolean")
    weights = {r.flag: r.weight for r in class_weights(frame, "flag").collect()}
    assert weights == {True: 2.0, False: pytest.approx(4 / 6)}
    assert tuple(label_profile(frame, "flag").first()) == (4, 0.25)


def test_roc_auc_equals_pair_counting(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.3, round(rng.random(), 2)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "y boolean, s double")
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert roc_auc(frame, "y", "s").first().auc == pytest.approx(wins / len(pos) / len(neg), abs=1e-6)
    assert roc_auc(frame.where("y"), "y", "s").first().auc is None


def test_report_and_matrix(spark):
    rows = [(True, True)] * 3 + [(False, True)] + [(True, False)] * 2 + [(False, False)] * 4
    frame = spark.createDataFrame(rows, "y boolean, p boolean")
    cells = {(r.label, r.prediction): r.n for r in confusion_matrix(frame, "y", "p").collect()}
    assert cells == {(True, True): 3, (False, True): 1, (True, False): 2, (False, False): 4}
    report = {r["class"]: r for r in classification_report(frame, "y", "p").collect()}
    assert report["Fraud"].precision == 0.75 and report["Fraud"].recall == 0.6
    assert report["Legit"].support == 5 and report["Fraud"].f1 == pytest.approx(0.666667)
    empty = classification_report(frame.where("y AND NOT y"), "y", "p").collect()
    assert all(row.precision == 0 and row.support == 0 for row in empty)
