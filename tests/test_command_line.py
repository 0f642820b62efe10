from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallybrook.__main__ import main, targets_of
from tallybrook.operators import model
from tallybrook.plans import jobs
from tallybrook.sources import payments as source
from tallybrook.sources import tables
from tallybrook.streaming.sinks import read_counters


def test_all_jobs_one_after_the_other(spark, sf_dir, folder, monkeypatch, capsys):
    monkeypatch.setattr(model, "TREES", 3)
    wire = source.wire_messages(spark, sf_dir).selectExpr("CAST(value AS STRING) AS value")
    wire.write.text(f"{folder}/in")
    root = f"{folder}/lake"
    stream = ["stream", "--root", root, "--format", "text", "--interval", ""]
    main([*stream, "--option", f"path={folder}/in"], spark)
    main(["daily", "--root", root], spark)
    main(["daily", "--root", root, "--run-date", "2024-01-10"], spark)
    main(["train", "--root", root], spark)
    main(["fold", "--root", root], spark)
    main(["frames", "--root", root], spark)
    stored = spark.read.parquet(targets_of(root).warehouse)
    assert stored.count() == spark.read.parquet(jobs.lake_at(root).silver).count() == 996
    totals = spark.read.parquet(f"{root}/stream/governorate_totals")
    daily = spark.read.parquet(f"{root}/gold/{jobs.GOVERNORATE_TABLE}")
    columns = ["summary_date", "governorate", "total_transactions", "total_amount_egp"]
    assert sorted(map(tuple, totals.select(columns).collect())) == sorted(
        map(tuple, daily.select(columns).collect())
    )
    # a second delivery, with a model: its scores are in the warehouse
    wire.limit(0).union(later(spark, sf_dir)).write.mode("append").text(f"{folder}/in")
    main([*stream, "--option", f"path={folder}/in"], spark)
    scores = spark.read.parquet(targets_of(root).warehouse).where("transaction_id LIKE 'later%'")
    rows = model.score_with_model(source.payments(spark, sf_dir), model.load_model(spark, f"{root}/model"))
    want = {f"later{r.transaction_id}": r.fraud_score for r in rows.collect()}
    assert {r.transaction_id: float(r.fraud_score) for r in scores.collect()} == want
    kept = read_counters(spark, targets_of(root).counters, f"{root}/counters/baseline")
    total = kept.where("metric = 'total_transactions'").agg({"value": "sum"}).first()[0]
    assert total == 996 + scores.count()
    printed = capsys.readouterr().out
    assert "total_transactions" in printed and "quantiles" in printed and "governorate" in printed
    assert "only showing" not in printed


def later(spark, sf_dir):
    rows = source.payments(spark, sf_dir, "event_id")
    rows = rows.withColumn("transaction_id", F.concat(F.lit("later"), "transaction_id"))
    return source.to_wire(rows).selectExpr("CAST(value AS STRING) AS value")


def test_a_topic_is_read_from_its_start_and_through_losses():
    settings = tables.job_options("kafka", {"subscribe": "payments"})
    assert settings == {"startingOffsets": "earliest", "failOnDataLoss": "false", "subscribe": "payments"}
    assert tables.job_options("kafka", {"startingOffsets": "latest"})["startingOffsets"] == "latest"
    assert tables.job_options("text", {"path": "in"}) == {"path": "in"}


def test_a_job_must_be_named():
    with pytest.raises(SystemExit):
        main([])
