from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallybrook.functions.features import amount_ratio, odd_hour
from tallybrook.functions.scoring import fraud_flag, rule_score
from tallybrook.operators.parse import score
from tallybrook.sources.payments import payments

from .conftest import plan_of

SCHEMA = "amount_egp double, service_type string, payment_method string, status string"

# worked out by hand: amount, service, method, status, score
CASES = [
    (None, "gas_bill", "credit_card", "failed", 0.0),
    (float("nan"), "gas_bill", "credit_card", "failed", 0.0),
    (-5.0, "gas_bill", "credit_card", "failed", 0.0),
    (0.0, "gas_bill", "wallet", "success", 0.0),
    (2000.0, "gas_bill", "wallet", "failed", 0.0),
    (2000.01, "gas_bill", "wallet", "failed", 0.1),
    (2000.01, "gas_bill", "wallet", "pending", 0.0),
    (3000.0, "gas_bill", "wallet", "success", 0.0),
    (3000.01, "gas_bill", "wallet", "success", 0.1),
    (3000.01, "gas_bill", "wallet", "failed", 0.2),
    (5000.0, "gas_bill", "credit_card", "success", 0.1),
    (5000.01, "gas_bill", "credit_card", "success", 0.25),
    (5000.01, "gas_bill", "debit_card", "success", 0.1),
    (5000.01, "gas_bill", "credit_card", "failed", 0.35),
    (8000.0, "gas_bill", "wallet", "success", 0.1),
    (8000.01, "gas_bill", "wallet", "success", 0.3),
    (8000.01, "gas_bill", "credit_card", "failed", 0.55),
    (15000.0, "gas_bill", "wallet", "success", 0.3),
    (15000.01, "gas_bill", "wallet", "success", 0.6),
    (15000.01, "gas_bill", "credit_card", "success", 0.75),
    (15000.01, "gas_bill", "wallet", "failed", 0.7),
    (50000.0, "gas_bill", "credit_card", "failed", 0.85),
    (100.0, "university_fees", "wallet", "success", 0.0),
    (3000.01, "university_fees", "wallet", "success", 0.0),
    (3000.01, "credit_card_payment", "wallet", "failed", 0.1),
    (8000.01, "credit_card_payment", "wallet", "success", 0.2),
    (15000.01, "university_fees", "wallet", "success", 0.5),
    (15000.01, "credit_card_payment", "credit_card", "failed", 0.75),
    (15000.01, None, None, None, 0.6),
    (15000.01, "new service", "barter", "unheard of", 0.6),
    (5000.01, None, "credit_card", None, 0.25),
]


def test_rule_score_of_cases_worked_out_by_hand(spark):
    rows = spark.createDataFrame(CASES, f"{SCHEMA}, want double")
    for row in rows.withColumn("s", rule_score()).collect():
        assert row.s == pytest.approx(row.want, abs=1e-12), row


def test_score_at_threshold_is_flagged(spark):
    rows = [(15000.01, "university_fees", "wallet", "success", False)]
    frame = score(spark.createDataFrame(rows, f"{SCHEMA}, is_fraud boolean"))
    assert frame.select("fraud_score", "is_fraud").first() == (0.5, True)


def test_flag_is_three_valued(spark):
    table = [
        (True, 0.4999, True), (True, 0.5, True), (False, 0.4999, False), (False, 0.5, True),
        (None, 0.4999, None), (None, 0.5, True),
    ]
    frame = spark.createDataFrame(table, "is_fraud boolean, fraud_score double, want boolean")
    assert all(row.got == row.want for row in frame.withColumn("got", fraud_flag()).collect())


def test_scoring_runs_without_python_workers(spark, sf_dir):
    plan = plan_of(score(payments(spark, sf_dir)))
    assert "EvalPython" not in plan and "MapInPandas" not in plan


def test_time_and_ratio_features(spark):
    rows = [("2024-01-01 04:59:59", 25000.0), ("2024-01-01 05:00:00", 90000.0)]
    frame = spark.createDataFrame(rows, "t string, amount_egp double").select(
        F.col("t").cast("timestamp").alias("event_time"),
        "amount_egp",
    )
    got = frame.select(odd_hour().alias("odd"), amount_ratio().alias("ratio")).collect()
    assert [tuple(r) for r in got] == [(1, 0.5), (0, 1.0)]
