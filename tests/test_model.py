from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import model
from tallybrook.sources import payments as source
from tallybrook.sources.tables import table_stream


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return source.payments(spark, sf_dir)


@pytest.fixture(scope="module", autouse=True)
def small_forest():
    patch = pytest.MonkeyPatch()
    patch.setattr(model, "TREES", 5)
    patch.setattr(model, "DEPTH", 4)
    yield
    patch.undo()


@pytest.fixture(scope="module")
def fitted(rows):
    return model.fit_model(rows)


def scores(frame):
    return {row.transaction_id: row.ml_score for row in frame.collect()}


def test_labels_are_numbered_alphabetically(spark, rows):
    encoded = model.encode_labels(rows).select("payment_method", "payment_enc").distinct()
    got = {row.payment_method: row.payment_enc for row in encoded.collect()}
    assert got == {m: float(i) for i, m in enumerate(sorted(source_methods()))}


def source_methods():
    return ["wallet", "debit_card", "credit_card", "bank_transfer", "cash_at_agent"]


def test_columns_of_many_values_are_encoded(spark):
    many = spark.range(5000).select(
        F.format_string("m%05d", "id").alias("service_type"),
        F.lit("Giza").alias("governorate"),
        F.lit(None).cast("string").alias("payment_method"),
    )
    got = model.encode_labels(many).agg(F.sum("service_enc"), F.max("service_enc"), F.max("gov_enc"), F.max("payment_enc"))
    assert tuple(got.first()) == (5000 * 4999 / 2, 4999.0, 0.0, 0.0)


def test_quantiles_are_exact(spark):
    import math

    amounts = [float(i * i % 37) for i in range(250)]
    rows = spark.createDataFrame([("gas", a) for a in amounts], "service_type string, amount_egp double")
    (row,) = model.amount_quantiles(rows).collect()
    ordered = sorted(amounts)
    assert row.quantiles == [ordered[max(1, math.ceil(q * 250 / 100)) - 1] for q in range(101)]


def test_model_does_not_depend_on_the_files(rows):
    def trees(parts):
        fit = model.fit_model(rows.repartition(parts), partitions=4)
        return fit.pipeline.stages[-1].toDebugString.splitlines()[1:]

    assert trees(2) == trees(8)


def test_amount_is_placed_among_the_quantiles_of_its_service(spark):
    history = spark.createDataFrame([("gas", float(x)) for x in range(101)], "service_type string, amount_egp double")
    quantiles = model.amount_quantiles(history)
    new = [("gas", -1.0), ("gas", 0.0), ("gas", 50.0), ("gas", 1e9), ("tea", 50.0), (None, 1.0)]
    placed = model.place_amount(spark.createDataFrame(new, "service_type string, amount_egp double"), quantiles)
    got = {(r.service_type, r.amount_egp): r.amount_pct for r in placed.collect()}
    assert got[("gas", -1.0)] == 0 and got[("gas", 1e9)] == 1
    assert got[("gas", 0.0)] == pytest.approx(1 / 101) and got[("gas", 50.0)] == pytest.approx(51 / 101)
    assert got[("tea", 50.0)] == 0 and got[(None, 1.0)] == 0


def test_saved_model_scores_alike(spark, rows, fitted, folder):
    fitted.save(folder)
    loaded = model.load_model(spark, folder)
    assert scores(model.score_with_model(rows, fitted)) == scores(model.score_with_model(rows, loaded))
    sizes = model.model_files(spark, folder).collect()
    assert any("quantiles" in row.path for row in sizes) and any("pipeline" in row.path for row in sizes)


def test_same_seed_and_data_give_the_same_trees(rows, fitted):
    def trees(fit):
        return fit.pipeline.stages[-1].toDebugString.splitlines()[1:]  # the first line names the object

    assert trees(model.fit_model(rows)) == trees(fitted)


def test_unseen_and_missing_values_are_scored(spark, rows, fitted):
    odd = rows.limit(1).select(
        "transaction_id", "event_time", F.lit("new service").alias("service_type"),
        F.lit(None).cast("double").alias("amount_egp"), F.lit(None).cast("string").alias("governorate"),
        F.lit("barter").alias("payment_method"), "status", "is_fraud",
    )
    (row,) = model.score_with_model(odd, fitted).collect()
    assert 0 <= row.ml_score <= 1 and row.fraud_score == row.ml_score


def test_rules_score_while_there_is_no_model(spark, rows, folder):
    assert model.load_model(spark, f"{folder}/none") is None
    scored = model.score_with_model(rows, None)
    assert scored.where("ml_score IS NOT NULL OR fraud_score <> rule_score").count() == 0


def test_broken_model_raises(spark, fitted, folder):
    fitted.quantiles.write.parquet(f"{folder}/quantiles")
    with pytest.raises(Exception):
        model.load_model(spark, folder)


def test_stream_scores_equal_batch_scores(spark, rows, fitted, sf_dir, folder):
    events = table_stream(spark, f"{sf_dir}/events.parque[t]", source.EVENTS_SCHEMA)
    scored = model.score_with_model(source.to_payments(events), fitted)
    query = (
        scored.select("transaction_id", "ml_score")
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/check")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    streamed = scores(spark.read.parquet(f"{folder}/out"))
    assert streamed == scores(model.score_with_model(rows, fitted))


def test_training_part_and_test_part_are_disjoint(rows):
    _, tested = model.train_and_test(rows)
    known = rows.where("is_fraud IS NOT NULL").count()
    assert abs(tested.count() - known * 0.2) <= 2


def test_partitions_follow_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(model, "TREES", 3)
    monkeypatch.setattr(model, "DEPTH", 3)
    rows = source.payments(spark, sf_dir)
    known = rows.where("is_fraud IS NOT NULL").count()
    monkeypatch.setattr(model, "ROWS_PER_PARTITION", -(-known // 23))
    first, again = (model.fit_model(rows.repartition(parts)) for parts in (2, 7))
    a, b = (fit.pipeline.stages[-1].toDebugString.partition("\n")[2] for fit in (first, again))
    assert first.partitions == 23 and a == b != ""
    monkeypatch.setattr(model, "ROWS_PER_PARTITION", known)
    assert model.fit_model(rows).partitions == model.PARTITIONS
