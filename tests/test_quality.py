from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallybrook.operators.parse import CORRUPT, enrich, parse_transactions
from tallybrook.operators.quality import (
    accepted,
    dedup_earliest,
    rejected,
    silver,
    with_reject_reason,
)
from tallybrook.sources import payments as source

from .conftest import plan_of

GOOD = (
    '{"transaction_id":"a","event_time":"2024-01-01T10:00:00.5","customer_id":"c",'
    '"merchant_id":"m","service_type":"gas_bill","amount_egp":12.5,"governorate":"Giza",'
    '"payment_method":"wallet","status":"success","is_fraud":false}'
)


def parse(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    return parse_transactions(frame, "i")


def test_parser_corpus(spark):
    texts = [
        GOOD,
        "not json",
        GOOD.replace("12.5", '"abc"'),
        GOOD.replace('"status":"success",', ""),
        GOOD.replace("{", '{"channel":"kiosk",', 1),
        None,
        GOOD.replace("2024-01-01T10:00:00.5", "2024-13-45T99:00:00"),
        "",
    ]
    rows = {row.i: row for row in parse(spark, *texts).collect()}
    assert len(rows) == len(texts)
    assert rows[0].event_time == dt.datetime(2024, 1, 1, 10, 0, 0, 500000)
    assert rows[0].amount_egp == 12.5 and rows[0][CORRUPT] is None
    assert rows[1].transaction_id is None and rows[1][CORRUPT] == "not json"
    assert rows[2].amount_egp is None and rows[2].merchant_id == "m"
    assert rows[2][CORRUPT] is not None
    assert rows[3].status is None and rows[3].transaction_id == "a" and rows[3][CORRUPT] is None
    assert rows[4].transaction_id == "a" and rows[4][CORRUPT] is None
    assert rows[5].transaction_id is None and rows[5].amount_egp is None
    assert rows[6].event_time is None and rows[6].transaction_id == "a"
    assert rows[7].transaction_id is None


def test_reasons(spark):
    texts = [
        GOOD,
        "not json",
        GOOD.replace('"a"', "null"),
        GOOD.replace('"m"', f'"{"x" * 37}"'),
        GOOD.replace('"m"', f'"{"x" * 36}"'),
        GOOD.replace("12.5", "10000000000"),
        GOOD.replace("12.5", "9999999999.99"),
        GOOD.replace("12.5", '"NaN"'),
        GOOD.replace('"a"', "null").replace('"wallet"', f'"{"w" * 31}"'),
        GOOD.replace("12.5", "null"),
    ]
    rows = with_reject_reason(parse(spark, *texts)).collect()
    assert {row.i: row.reject_reason for row in rows} == {
        0: "",
        1: "malformed_json,transaction_id_missing,event_time_missing",
        2: "transaction_id_missing",
        3: "merchant_id_too_long",
        4: "",
        5: "amount_out_of_range",
        6: "",
        7: "amount_not_a_number",
        8: "transaction_id_missing,payment_method_too_long",
        9: "",
    }


def test_every_message_is_kept_or_quarantined(spark, sf_dir):
    messages = source.wire_messages(spark, sf_dir)
    checked = with_reject_reason(parse_transactions(messages))
    assert accepted(checked).count() + rejected(checked).count() == messages.count()


def test_json_is_parsed_once(spark, sf_dir):
    checked = with_reject_reason(parse_transactions(source.wire_messages(spark, sf_dir)))
    physical = plan_of(enrich(accepted(checked))).split("== Physical Plan ==")[1]
    assert physical.count("from_json(") == 1


def test_missing_amount_counts_as_zero(spark):
    row = enrich(parse(spark, GOOD.replace("12.5", "null"))).first()
    assert row.amount_egp == 0.0 and row.fraud_score == 0.0 and row.ingested_at is not None


def test_dedup_keeps_earliest_and_breaks_ties_by_content(spark):
    rows = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 5, None), ("c", None, "q")]
    frame = spark.createDataFrame(rows, "k string, t int, v string")
    got = dedup_earliest(frame, ["k"], ["t"])
    assert got.columns == ["k", "t", "v"]
    assert sorted(map(tuple, got.collect())) == [("a", 1, "y"), ("b", 5, None), ("c", None, "q")]


def test_dedup_of_one_huge_key_shrinks_before_the_shuffle(spark):
    frame = spark.range(30000, numPartitions=6).select(
        F.lit("hot").alias("k"), F.col("id").alias("t"), F.lit(1).alias("v")
    )
    result = dedup_earliest(frame, ["k"], ["t"])
    assert [tuple(r) for r in result.collect()] == [("hot", 0, 1)]
    physical = plan_of(result)
    assert "partial_min" in physical


def test_silver_defaults_and_types(spark):
    copies = [GOOD.replace("false", "null"), GOOD.replace("10:00:00.5", "09:00:00")]
    frame = spark.createDataFrame([(t,) for t in copies], "value string")
    clean = silver(parse_transactions(frame))
    types = dict(clean.dtypes)
    assert types["amount_egp"] == "decimal(12,2)" and types["fraud_score"] == "decimal(5,4)"
    (row,) = clean.collect()
    assert row.event_time.hour == 9 and row.is_fraud is False
    assert row.event_date == dt.date(2024, 1, 1)
