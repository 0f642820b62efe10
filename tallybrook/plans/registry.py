"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybrook.functions.scoring import FRAUD_THRESHOLD, rule_score
from tallybrook.operators import (
    counters,
    evaluation,
    model,
    nodetable,
    parse,
    quality,
    ranking,
    reports,
    splitting,
    summaries,
    treesplits,
    upsert,
)
from tallybrook.plans import jobs
from tallybrook.schema import MONEY_SUM, TRANSACTION_COLUMNS, WAREHOUSE_COLUMNS
from tallybrook.session import work_dir
from tallybrook.sources import payments as source
from tallybrook.sources.tables import table_stream
from tallybrook.streaming import lateness
from tallybrook.streaming import queries as streams
from tallybrook.streaming.sinks import Targets, committed, read_commits, read_counters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Batches that a table is cut into by time for a stream, and how far an event may come behind
#: later ones: not at all in such batches, but the streams keep their margin.
STREAM_BATCHES = 4
DELAY = "1 day"
#: What the first levels of a tree may split on.
TREE_FEATURES = ("amount_bin", "hour_of_day", *model.ENCODED.values())
TREE_LEVELS = 2
#: State partitions of the registered streams, unless a batch has more files.
STATE_PARTITIONS = 8


def query(function: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[function.__name__] = function
    return function


def naive_time(rows: DataFrame, *columns: str) -> DataFrame:
    """Times without a zone, as the table contract states them."""
    for c in columns or ("event_time",):
        rows = rows.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return rows


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.score(source.payments(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.payments(spark, sf_dir).where(F.col("is_fraud").isNotNull())


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.counter_deltas(parse.score(source.payments_in_batches(spark, sf_dir)))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.batch_sizes(source.payments_in_batches(spark, sf_dir))


def _event_stream(
    spark: SparkSession, sf_dir: str, batches: int = STREAM_BATCHES, deliver=source.events_by_time
) -> DataFrame:
    """The events as a stream of several batches, in the order of their times unless `deliver`
    says otherwise."""
    source.use_utc(spark)
    files = source.files_per_batch(spark, sf_dir, batches)
    own = streams.stream_session(spark, max(STATE_PARTITIONS, files))
    folder = deliver(spark, sf_dir, work_dir(spark, "events"), batches, files)
    return table_stream(own, folder, source.EVENTS_SCHEMA, maxFilesPerTrigger=str(files))


def _run(query: StreamingQuery) -> None:
    """Finish a registered stream: all its batches have run and no row was late."""
    late = streams.finish(query)
    if late:
        raise RuntimeError(f"{late} rows came behind the watermark")


def _message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.with_defects(source.to_payments(_event_stream(spark, sf_dir), "event_id"))


def _redelivered_stream(spark: SparkSession, sf_dir: str, again: bool = False) -> DataFrame:
    batches = STREAM_BATCHES + 1 if again else STREAM_BATCHES
    events = source.redelivered(_event_stream(spark, sf_dir, batches))
    return source.with_defects(source.to_payments(events, "event_id"))


# ---- parsing, cleaning, scoring ----


@query
def parse_transactions(spark, sf_dir):
    parsed = parse.parse_transactions(source.wire_messages(spark, sf_dir))
    return naive_time(parsed.select(*TRANSACTION_COLUMNS))


@query
def null_fill_amount(spark, sf_dir):
    rows = parse.fill_amount(source.payments_missing_amounts(spark, sf_dir))
    return rows.select("transaction_id", "amount_egp")


@query
def rule_fraud_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("transaction_id", "fraud_score")


@query
def fraud_flag(spark, sf_dir):
    return _scored(spark, sf_dir).select("transaction_id", "is_fraud")


@query
def enriched_transactions(spark, sf_dir):
    rows = parse.enrich(parse.parse_transactions(source.wire_messages(spark, sf_dir)))
    stamped = F.col("ingested_at") > F.lit("2024-01-01").cast("timestamp")
    return naive_time(rows.select(*TRANSACTION_COLUMNS, "fraud_score", stamped.alias("stamped")))


@query
def quarantine(spark, sf_dir):
    parsed = parse.parse_transactions(source.wire_messages(spark, sf_dir))
    bad = quality.rejected(quality.with_reject_reason(parsed))
    return bad.select("transaction_id", "merchant_id", "reject_reason")


@query
def dedup_transactions(spark, sf_dir):
    rows = source.with_late_copies(source.payments(spark, sf_dir, "event_id")).drop("event_id")
    return quality.dedup_earliest(rows, ["transaction_id"], ["event_time"])


@query
def dedup_natural_keys(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return quality.dedup_earliest(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query
def silver_transactions(spark, sf_dir):
    rows = source.redelivered(source.payments(spark, sf_dir, "event_id"))
    clean = quality.silver(parse.parse_transactions(source.with_defects(rows)))
    return naive_time(clean.drop("ingested_at"))


# ---- filters, summaries, history ----


#: The day that the daily queries report, as their job's argument would state it.
REPORT_DAY = dt.date(2024, 1, 29)


@query
def daily_slice(spark, sf_dir):
    return summaries.day_slice(source.payments(spark, sf_dir), REPORT_DAY)


@query
def successful_payments(spark, sf_dir):
    return summaries.successful(source.payments(spark, sf_dir))


@query
def merchant_daily_summary(spark, sf_dir):
    return summaries.merchant_daily_summary(_scored(spark, sf_dir))


@query
def governorate_daily_summary(spark, sf_dir):
    return summaries.governorate_daily_summary(_scored(spark, sf_dir))


@query
def service_daily_rollup(spark, sf_dir):
    return summaries.service_daily_rollup(merchant_daily_summary(spark, sf_dir))


@query
def summary_row_counts(spark, sf_dir):
    return summaries.summary_row_counts(
        {
            "merchant": merchant_daily_summary(spark, sf_dir),
            "governorate": governorate_daily_summary(spark, sf_dir),
        }
    )


@query
def service_history(spark, sf_dir):
    return summaries.newest(service_daily_rollup(spark, sf_dir), "service_type")


@query
def governorate_history(spark, sf_dir):
    return summaries.newest(governorate_daily_summary(spark, sf_dir), "governorate")


@query
def fraud_signature_report(spark, sf_dir):
    return reports.fraud_signature_report(source.payments(spark, sf_dir))


@query
def amount_range_violations(spark, sf_dir):
    return reports.amount_range_violations(source.payments(spark, sf_dir))


@query
def summary_upsert(spark, sf_dir):
    """Totals of all days before the report day, then a rerun that covers it and the day before.

    Every 90th payment lacks its governorate: NULL is a key like any other.
    """
    rows = source.payments(spark, sf_dir, "event_id")
    absent = F.col("event_id") % 90 == 1
    place = F.when(~absent, F.col("governorate"))
    rows = rows.withColumn("governorate", place).drop("event_id")
    day = F.to_date("event_time")
    last = F.lit(REPORT_DAY)
    source_rows = summaries.governorate_daily_summary(
        parse.score(rows).where(day >= F.date_sub(last, 1))
    )
    target = summaries.governorate_daily_summary(rows.where(day < last))
    keys = ["summary_date", "governorate"]
    return upsert.upsert(target, source_rows, keys, summaries.MEASURES)


@query
def silver_incremental(spark, sf_dir):
    """The clean table after three deliveries in which ids come back under other dates.

    Every 15th payment is delivered again with an event time two days earlier, every 25th with
    one a day later; of an id the earliest row stays.
    """
    root = work_dir(spark, "silver")
    lake = jobs.lake_at(root)
    event_id = F.col("event_id")
    rows = source.payments(spark, sf_dir, "event_id")
    time = F.col("event_time")
    deliveries = [
        rows,
        rows.where(event_id % 15 == 2).withColumn("event_time", time - F.expr("INTERVAL 2 DAYS")),
        rows.where(event_id % 25 == 3).withColumn("event_time", time + F.expr("INTERVAL 1 DAY")),
    ]
    for number, delivery in enumerate(deliveries):
        messages = source.to_wire(delivery).withColumn("ingested_at", F.current_timestamp())
        jobs.refresh_silver(messages, number, lake)
    clean = spark.read.parquet(lake.silver)
    return naive_time(
        clean.select("transaction_id", "event_time", "amount_egp", "event_date", "source_flag")
    )


# ---- live counters ----


@query
def counter_deltas(spark, sf_dir):
    return _deltas(spark, sf_dir)


@query
def live_kpis(spark, sf_dir):
    return counters.live_kpis(_deltas(spark, sf_dir))


@query
def live_by_service(spark, sf_dir):
    return counters.keyed_counts(_deltas(spark, sf_dir), "by_service", "service_type")


@query
def live_by_governorate(spark, sf_dir):
    return counters.keyed_counts(_deltas(spark, sf_dir), "by_governorate", "governorate")


@query
def revenue_by_service(spark, sf_dir):
    return counters.keyed_revenue(_deltas(spark, sf_dir))


@query
def service_ranking(spark, sf_dir):
    return counters.ranked_counts(live_by_service(spark, sf_dir), "service_type", ascending=True)


@query
def governorate_ranking(spark, sf_dir):
    counts = live_by_governorate(spark, sf_dir)
    return counters.ranked_counts(counts, "governorate", ascending=False)


@query
def batch_sizes(spark, sf_dir):
    return _sizes(spark, sf_dir)


@query
def batch_size_window(spark, sf_dir):
    return counters.newest_batches(_sizes(spark, sf_dir))


@query
def avg_rows_per_batch(spark, sf_dir):
    return counters.avg_rows_per_batch(_sizes(spark, sf_dir))


@query
def rolling_batch_mean(spark, sf_dir):
    return counters.rolling_batch_mean(_sizes(spark, sf_dir))


@query
def batch_audit(spark, sf_dir):
    return counters.batch_audit(parse.score(source.payments_in_batches(spark, sf_dir)))


# ---- features, evaluation, model ----


@query
def amount_percentile(spark, sf_dir):
    ranked = ranking.amount_percentile(source.payments(spark, sf_dir))
    return ranked.select("transaction_id", F.round("amount_pct", 8).alias("amount_pct"))


@query
def label_encoding(spark, sf_dir):
    encoded = model.encode_labels(source.payments(spark, sf_dir))
    return encoded.select(
        "transaction_id", *[F.col(c).cast("int").alias(c) for c in model.ENCODED.values()]
    )


@query
def fraud_features(spark, sf_dir):
    features = model.fraud_features(source.payments(spark, sf_dir))
    codes = {c: F.col(c).cast("int") for c in model.ENCODED.values()}
    return features.withColumns({**codes, "amount_pct": F.round("amount_pct", 8)})


@query
def label_profile(spark, sf_dir):
    profile = splitting.label_profile(_labelled(spark, sf_dir), "is_fraud")
    return profile.withColumn("label_mean", F.round("label_mean", 8))


@query
def stratified_split(spark, sf_dir):
    rows = splitting.stratified_split(_labelled(spark, sf_dir), "is_fraud", "transaction_id")
    return rows.select("transaction_id", "split")


@query
def class_weights(spark, sf_dir):
    weights = splitting.class_weights(_labelled(spark, sf_dir), "is_fraud")
    return weights.withColumn("weight", F.round("weight", 8))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled payments with the rule score and its verdict."""
    rows = _labelled(spark, sf_dir)
    scored = rows.withColumn("fraud_score", rule_score())
    return scored.withColumn("verdict", F.col("fraud_score") >= FRAUD_THRESHOLD)


@query
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(_judged(spark, sf_dir), "is_fraud", "verdict")


@query
def classification_report(spark, sf_dir):
    return evaluation.classification_report(_judged(spark, sf_dir), "is_fraud", "verdict")


@query
def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(_judged(spark, sf_dir), "is_fraud", "fraud_score")


@query
def train_fraud_model(spark, sf_dir):
    """Held-out payments per true label, all with a prediction of the fitted forest."""
    _, tested = model.train_and_test(source.payments(spark, sf_dir))
    cells = evaluation.confusion_matrix(tested, "is_fraud", "predicted_fraud")
    return cells.groupBy("label").agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("prediction").isNotNull(), F.col("n")).otherwise(0)).alias("predicted"),
    )


@query
def fraud_model_confusion(spark, sf_dir):
    """Held-out payments by true label and the forest's verdict."""
    _, tested = model.train_and_test(source.payments(spark, sf_dir))
    return evaluation.confusion_matrix(tested, "is_fraud", "predicted_fraud")


@query
def fraud_tree_splits(spark, sf_dir):
    """The first two levels of a class-weighted decision tree over the labelled payments."""
    return treesplits.first_levels(_tree_rows(_tree_inputs(spark, sf_dir)), TREE_FEATURES)


def _tree_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with what a tree may split on."""
    coded = model.with_time_features(model.encode_labels(source.payments(spark, sf_dir)))
    return coded.withColumn("amount_bin", treesplits.amount_bin())


def _tree_rows(inputs: DataFrame) -> DataFrame:
    """The labelled rows a tree learns from."""
    label = F.col("is_fraud").cast("int").alias("label")
    return inputs.where(F.col("is_fraud").isNotNull()).select(*TREE_FEATURES, label)


@query
def fraud_tree_scores(spark, sf_dir):
    """Every payment scored by the saved nodes of a tree of two levels: leaf, score and flag."""
    path = work_dir(spark, "tree")
    inputs = _tree_inputs(spark, sf_dir)
    rows = _tree_rows(inputs)
    treesplits.first_levels(rows, TREE_FEATURES, TREE_LEVELS).write.parquet(f"{path}/splits")
    splits = spark.read.parquet(f"{path}/splits")
    treesplits.grown_tree(rows, TREE_FEATURES, splits, TREE_LEVELS).write.parquet(f"{path}/nodes")
    nodes = spark.read.parquet(f"{path}/nodes")
    features = F.array(*[F.col(c).cast("double") for c in TREE_FEATURES])
    paths = nodes.agg(F.sort_array(F.collect_list(F.struct("node", "path")))).scalar()
    scored = nodetable.with_trees(inputs, nodes).withColumn("_paths", paths).withColumn(
        "_leaf", nodetable.leaf_of(F.get("_trees", F.lit(0)), features, TREE_LEVELS)
    )
    share = nodetable.mean_share(F.col("_trees"), features, TREE_LEVELS)
    score = F.round(share, model.SCORE_DIGITS)
    return scored.select(
        "transaction_id",
        F.get("_paths", F.col("_leaf"))["path"].alias("leaf"),
        score.alias("fraud_score"),
        F.col("is_fraud").alias("source_flag"),
        (F.col("is_fraud") | (score >= FRAUD_THRESHOLD)).alias("is_fraud"),
    )


@query
def forest_node_scores(spark, sf_dir):
    """The forest's score of every payment, walked in the saved table of its nodes."""
    path = work_dir(spark, "model")
    rows = source.payments(spark, sf_dir)
    model.fit_model(rows).save(path)
    nodes = spark.read.parquet(f"{path}/nodes")
    scored = model.score_from_nodes(rows, model.load_model(spark, path), nodes)
    return scored.select("transaction_id", "ml_score")


@query
def ml_payment_scores(spark, sf_dir):
    """Rule score, the forest's score and the flag of every payment, scored by a saved model."""
    path = work_dir(spark, "model")
    rows = source.payments(spark, sf_dir)
    model.fit_model(rows).save(path)
    asked = rows.withColumn("source_flag", F.col("is_fraud"))
    scored = model.score_with_model(asked, model.load_model(spark, path))
    return scored.select(
        "transaction_id", "rule_score", "ml_score", "fraud_score", "source_flag", "is_fraud"
    )


@query
def ml_fraud_score(spark, sf_dir):
    """Fit, save, load, then score every payment; of the scores what does not depend on trees."""
    path = work_dir(spark, "model")
    rows = source.payments(spark, sf_dir)
    model.fit_model(rows).save(path)
    asked = rows.withColumn("source_flag", F.col("is_fraud"))
    scored = model.score_with_model(asked, model.load_model(spark, path))
    ml = F.col("ml_score")
    raised = F.col("source_flag") | (ml >= FRAUD_THRESHOLD)
    return scored.select(
        "transaction_id",
        "rule_score",
        ml.between(0, 1).alias("in_range"),
        (F.round(ml, model.SCORE_DIGITS) == ml).alias("rounded"),
        (F.col("fraud_score") == ml).alias("used"),
        F.col("is_fraud").eqNullSafe(raised).alias("flag_follows"),
    )


# ---- streams ----


@query
def stream_ingest(spark, sf_dir):
    """Parsed and enriched rows of the message stream, landed by event date."""
    out = work_dir(spark, "ingest")
    rows = streams.clean_stream(_message_stream(spark, sf_dir))
    _run(streams.lake_sink(rows, f"{out}/table", f"{out}/checkpoint", None))
    landed = spark.read.parquet(f"{out}/table")
    return naive_time(landed.select(*TRANSACTION_COLUMNS, "fraud_score"))


@query
def bronze_sink(spark, sf_dir):
    """Raw messages as they landed."""
    out = work_dir(spark, "bronze")
    messages = _message_stream(spark, sf_dir)
    _run(streams.bronze_sink(messages, f"{out}/table", f"{out}/checkpoint", None))
    return naive_time(
        parse.parse_transactions(spark.read.parquet(f"{out}/table")).select(*TRANSACTION_COLUMNS)
    )


@query
def warehouse_sink(spark, sf_dir):
    """Warehouse rows after a stream with redelivered messages ran twice, its checkpoint lost."""
    out = work_dir(spark, "warehouse")
    for run in ("first", "again"):
        # the second time the batches are cut in other places
        rows = streams.clean_stream(_redelivered_stream(spark, sf_dir, again=run == "again"))
        _run(streams.warehouse_sink(rows, f"{out}/table", f"{out}/{run}", None))
    landed = spark.read.parquet(f"{out}/table")
    return naive_time(landed.select(*[c for c in WAREHOUSE_COLUMNS if c != "ingested_at"]))


@query
def stream_fanout(spark, sf_dir):
    """Rows per destination, after one stream fed warehouse, counters and quarantine."""
    out = work_dir(spark, "fanout")
    targets = Targets(f"{out}/warehouse", f"{out}/counters", f"{out}/quarantine")
    messages = _message_stream(spark, sf_dir)
    _run(streams.fan_out_sink(messages, targets, f"{out}/checkpoint", None))
    counted = counters.live_kpis(read_counters(spark, targets.counters)).select(
        F.lit("counters").alias("target"),
        F.col("total_transactions").alias("n_rows"),
        F.col("total_fraud").alias("n_fraud"),
        F.col("total_revenue").cast(MONEY_SUM).alias("amount_egp"),
    )
    stored = spark.read.parquet(targets.warehouse).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_fraud").alias("n_fraud"),
        F.sum("amount_egp").cast(MONEY_SUM).alias("amount_egp"),
    )
    bad = spark.read.parquet(targets.quarantine).agg(F.count(F.lit(1)).alias("n_rows"))
    none = F.lit(0).cast("bigint").alias("n_fraud")
    nothing = F.lit(0).cast(MONEY_SUM).alias("amount_egp")
    return counted.unionByName(stored.select(F.lit("warehouse").alias("target"), "*")).unionByName(
        bad.select(F.lit("quarantine").alias("target"), "n_rows", none, nothing)
    )


@query
def stream_commits(spark, sf_dir):
    """What the log of commits says of a stream's batches, and what a reader of them finds."""
    out = work_dir(spark, "commits")
    targets = Targets(
        f"{out}/warehouse",
        f"{out}/counters",
        f"{out}/quarantine",
        ids=f"{out}/ids",
        commits=f"{out}/commits",
    )
    _run(streams.fan_out_sink(_message_stream(spark, sf_dir), targets, f"{out}/checkpoint", None))
    commits = read_commits(spark, targets.commits)

    def found(path):
        return committed(spark.read.parquet(path), commits).agg(F.count(F.lit(1)).alias("n"))

    stored, refused = found(targets.warehouse), found(targets.quarantine)
    return (
        commits.agg(F.sum("n_read").alias("n_read"), F.sum("n_rejected").alias("n_rejected"))
        .crossJoin(stored.select(F.col("n").alias("n_stored")))
        .crossJoin(refused.select(F.col("n").alias("n_quarantined")))
    )


@query
def stream_dedup(spark, sf_dir):
    """Clean rows, each id once, of a stream with redelivered messages."""
    out = work_dir(spark, "dedup")
    rows = streams.clean_stream(_redelivered_stream(spark, sf_dir))
    once = streams.dedup_stream(rows, DELAY)
    _run(streams.lake_sink(once, f"{out}/table", f"{out}/checkpoint", None))
    landed = spark.read.parquet(f"{out}/table")
    return naive_time(landed.select(*TRANSACTION_COLUMNS, "fraud_score"))


def _streamed_totals(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Totals kept by a stream over the de-duplicated rows of another stream."""
    out = work_dir(spark, "daily")
    rows = streams.clean_stream(_redelivered_stream(spark, sf_dir))
    once = streams.dedup_stream(rows, DELAY)
    _run(streams.lake_sink(once, f"{out}/clean", f"{out}/clean_checkpoint", None))
    landed = spark.read.parquet(f"{out}/clean")
    clean = table_stream(
        streams.stream_session(spark, STATE_PARTITIONS), f"{out}/clean", landed.schema
    )
    totals = streams.daily_totals(clean, keys, DELAY)
    places = (f"{out}/gold", f"{out}/staging", f"{out}/gold_checkpoint")
    _run(streams.daily_totals_sink(spark, totals, keys, *places, None))
    return spark.read.parquet(f"{out}/gold").select("summary_date", *keys, *summaries.MEASURES)


@query
def stream_daily_summary(spark, sf_dir):
    return _streamed_totals(spark, sf_dir, "governorate")


@query
def stream_merchant_summary(spark, sf_dir):
    return _streamed_totals(spark, sf_dir, "merchant_id", "service_type")


@query
def stream_returning_ids(spark, sf_dir):
    """Warehouse rows of a stream in which every 20th payment comes back as two hours later."""
    out = work_dir(spark, "returning")
    events = _event_stream(spark, sf_dir, deliver=source.events_coming_back)
    messages = source.with_defects(source.to_payments(events, "event_id"))
    once = lateness.first_arrivals(streams.clean_stream(messages))
    _run(streams.warehouse_sink(once, f"{out}/table", f"{out}/checkpoint", None))
    landed = spark.read.parquet(f"{out}/table")
    return naive_time(landed.select(*[c for c in WAREHOUSE_COLUMNS if c != "ingested_at"]))


def _straggling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir, deliver=source.events_with_stragglers)
    return source.with_defects(source.to_payments(events, "event_id"))


@query
def stream_late_rows(spark, sf_dir):
    """Payments whose day was closed when they came: every 15th is held back to the end."""
    out = work_dir(spark, "late")
    once = lateness.first_arrivals(streams.clean_stream(_straggling(spark, sf_dir)))
    landing = lateness.landing_at(out)
    _run(lateness.split_sink(once, landing, f"{out}/checkpoint", DELAY, None))
    late = lateness.late_rows(spark, landing, jobs.CLEAN_STREAM_SCHEMA)
    return naive_time(late.select("transaction_id", "event_time", "governorate", "amount_egp"))


@query
def stream_totals_with_late(spark, sf_dir):
    """Daily totals of the streams of the job, those of late payments added."""
    out = work_dir(spark, "totals")
    jobs.stream_totals(spark, _straggling(spark, sf_dir), out, None)
    totals = jobs.streamed_totals(spark, out)
    return totals.select("summary_date", "governorate", *summaries.MEASURES)
