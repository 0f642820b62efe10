"""Fraud model: one feature definition for training and serving, one saved artefact."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.functions.features import amount_ratio, hour_of_day, odd_hour
from tallybrook.functions.scoring import fraud_flag, rule_score
from tallybrook.operators.nodetable import forest_nodes, mean_share_of_forest
from tallybrook.operators.ranking import amount_percentile
from tallybrook.operators.running import data_bucket, running_totals
from tallybrook.operators.splitting import SEED, class_weights, stratified_split
from tallybrook.session import work_dir

# The encoded columns, the model inputs in order, the forest's size.
ENCODED = {"service_type": "service_enc", "governorate": "gov_enc", "payment_method": "payment_enc"}
FEATURES = [
    "amount_egp",
    "service_enc",
    "gov_enc",
    "payment_enc",
    "hour_of_day",
    "amount_pct",
    "odd_hour",
]
TREES = 100
DEPTH = 10
SCORE_DIGITS = 4

QUANTILES = 100

#: Partitions that the training rows are dealt to by id, and the rows of one from which on there are
#: more. The trees depend on their number and on nothing else of the cluster, so it follows from
#: the rows alone and is saved with the model. A task reads about 1.5 kB for a row of 100 trees;
#: each partition also sends its own histograms of all nodes, so they are no smaller than need be.
PARTITIONS = 16
ROWS_PER_PARTITION = 250_000


def category_codes(rows: DataFrame) -> DataFrame:
    """name, label, code: the distinct values of the encoded columns, numbered from 0 in
    alphabetical order. There may be any number of them: the table stays on the cluster."""
    columns = list(ENCODED)
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("label")) for c in columns])
    found = rows.groupBy(*columns).agg(F.count(F.lit(1))).select(F.inline(pairs))
    found = found.where(F.col("label").isNotNull()).distinct()
    numbered = running_totals(
        found.withColumn("one", F.lit(1)),
        {"code": "one"},
        order="label",
        bucket=F.substring("label", 1, 2),
        group=["name"],
    )
    return numbered.select("name", "label", F.col("code").cast("double").alias("code"))


def encode_with(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Add the encoded columns; an unseen or missing label gets the next number.

    Works on a stream too. Spark sends the table of codes to all executors where it is small
    enough and shuffles otherwise.
    """
    names = rows.columns
    for column, encoded in ENCODED.items():
        own = codes.where(F.col("name") == column)
        unseen = own.agg(F.count(F.lit(1)).cast("double")).scalar()
        labels = own.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        rows = (
            rows.join(labels, F.col(column) == F.col("_label"), "left")
            .withColumn(encoded, F.coalesce("_code", unseen))
            .drop("_label", "_code")
        )
    return rows.select(*[c for c in names if c not in ENCODED.values()], *ENCODED.values())


def encode_labels(rows: DataFrame) -> DataFrame:
    """Add the three encoded columns, fitted on the rows themselves."""
    return encode_with(rows, category_codes(rows))


def with_time_features(rows: DataFrame) -> DataFrame:
    """Event hour and night flag."""
    return rows.withColumn("hour_of_day", hour_of_day()).withColumn("odd_hour", odd_hour())


def fraud_features(rows: DataFrame) -> DataFrame:
    """The model inputs of a closed data set, with exact percentile ranks, and the amount ratio."""
    ranked = amount_percentile(with_time_features(encode_labels(rows)))
    return ranked.select("transaction_id", *FEATURES, amount_ratio().alias("amount_ratio"))


def amount_quantiles(rows: DataFrame) -> DataFrame:
    """101 exact amount quantiles per service: what serving needs to place a new amount.

    The amount at share q is the smallest with at least that share of the payments not above
    it. Running totals over the distinct amounts find them, so the result does not
    depend on how rows are partitioned.
    """
    sums = (
        rows.where(
            F.col("service_type").isNotNull()
            & F.col("amount_egp").isNotNull()
            & ~F.isnan("amount_egp")
        )
        .groupBy("service_type", "amount_egp")
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    ranks = running_totals(
        sums,
        {"below": "ties"},
        order="amount_egp",
        bucket=data_bucket(sums, "amount_egp"),
        group=["service_type"],
        overall={"size": "ties"},
    )
    # the quantiles that an amount answers: q with below < max(1, ceil(q * size)) <= upto
    wanted = F.transform(
        F.sequence(F.lit(0), F.lit(QUANTILES)),
        lambda q: F.struct(
            q.alias("q"), F.greatest(F.ceil(q * F.col("size") / QUANTILES), F.lit(1)).alias("rank")
        ),
    )
    upto = F.col("below") + F.col("ties")
    held = F.filter(wanted, lambda w: (w["rank"] > F.col("below")) & (w["rank"] <= upto))
    found = ranks.select("service_type", "amount_egp", F.explode(held).alias("w"))
    listed = F.sort_array(F.collect_list(F.struct("w.q", "amount_egp")))
    return found.groupBy("service_type").agg(
        F.transform(listed, lambda x: x["amount_egp"]).alias("quantiles")
    )


def place_amount(rows: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Add `amount_pct` from a fitted quantile table.

    Share of the service's quantiles not above the amount; 0 for an unknown service.
    """
    held = F.filter("quantiles", lambda q: q <= F.col("amount_egp"))
    share = F.coalesce(F.size(held), F.lit(0)) / F.lit(float(QUANTILES + 1))
    placed = rows.join(quantiles, "service_type", "left")
    return placed.select(
        *[rows[c] for c in rows.columns],
        F.when(F.col("quantiles").isNull(), F.lit(0.0)).otherwise(share).alias("amount_pct"),
    )


@dataclass
class FraudModel:
    """A fitted pipeline (assembler, forest), its category codes and its amount quantiles."""

    pipeline: PipelineModel
    codes: DataFrame
    quantiles: DataFrame
    partitions: int = PARTITIONS

    def inputs(self, rows: DataFrame) -> DataFrame:
        """Add the model's inputs; a missing amount counts as 0."""
        filled = rows.withColumn("amount_egp", F.coalesce("amount_egp", F.lit(0.0)))
        coded = encode_with(with_time_features(filled), self.codes)
        return place_amount(coded, self.quantiles)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add `fraud_probability` and `predicted_fraud`; works on a batch and a stream."""
        scored = self.pipeline.transform(self.inputs(rows))
        return scored.select(
            *rows.columns,
            vector_to_array("probability")[1].alias("fraud_probability"),
            (F.col("prediction") == 1.0).alias("predicted_fraud"),
        )

    def save(self, path: str) -> None:
        """Write all parts below one folder, and the forest's nodes as a table beside them."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        spark = self.codes.sparkSession
        nodes = forest_nodes(spark, f"{path}/pipeline")
        nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        settings = spark.range(1).select(F.lit(self.partitions).alias("partitions"))
        settings.write.mode("overwrite").parquet(f"{path}/settings")
        self.quantiles.write.mode("overwrite").parquet(f"{path}/quantiles")


def load_model(spark: SparkSession, path: str) -> FraudModel | None:
    """The saved model, or None when the folder does not exist; a broken model raises."""
    try:
        quantiles = spark.read.parquet(f"{path}/quantiles")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    codes = spark.read.parquet(f"{path}/codes")
    partitions = spark.read.parquet(f"{path}/settings").first()["partitions"]
    return FraudModel(PipelineModel.load(f"{path}/pipeline"), codes, quantiles, partitions)


def model_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a saved model and their sizes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.round(F.col("length") / 1024, 1).alias("size_kb"))


def fit_model(
    labelled: DataFrame, seed: int = SEED, partitions: int | None = None
) -> FraudModel:
    """Fit on rows with a known `is_fraud`; classes weigh the same in total.

    Rows are dealt to `partitions`, by default as their number asks for, by a hash of their id and
    sorted there: the forest draws its samples by partition and position, so the model does not
    depend on the cluster or the files. Codes and quantiles are written out once, then used here
    and in serving.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col("is_fraud").isNotNull()).select(
        "transaction_id", "event_time", "amount_egp", *ENCODED, "is_fraud"
    )
    if partitions is None:
        partitions = max(PARTITIONS, math.ceil(known.count() / ROWS_PER_PARTITION))
    dealt = known.repartition(partitions, "transaction_id").sortWithinPartitions(*known.columns)
    dealt = dealt.persist()
    try:
        parts = work_dir(spark, "fitted")
        category_codes(dealt).write.parquet(f"{parts}/codes")
        amount_quantiles(dealt).write.parquet(f"{parts}/quantiles")
        codes = spark.read.parquet(f"{parts}/codes")
        quantiles = spark.read.parquet(f"{parts}/quantiles")
        weights = class_weights(dealt, "is_fraud").collect()  # two rows
        weight = F.lit(None).cast("double")
        for row in weights:
            weight = F.when(F.col("is_fraud") == row.is_fraud, row.weight).otherwise(weight)
        frame = place_amount(encode_with(with_time_features(dealt), codes), quantiles)
        frame = frame.withColumns({"weight": weight, "label": F.col("is_fraud").cast("double")})
        prepare = VectorAssembler(
            inputCols=FEATURES, outputCol="features", handleInvalid="keep"
        )
        forest = RandomForestClassifier(
            featuresCol="features",
            labelCol="label",
            weightCol="weight",
            numTrees=TREES,
            maxDepth=DEPTH,
            seed=seed,
            maxMemoryInMB=1024,
            cacheNodeIds=True,  # halves the time at this depth: trees are not sent out each level
        )
        ready = prepare.transform(frame).select("transaction_id", "features", "label", "weight")
        # a join above may have moved rows: deal them out again in the same way
        ready = (
            ready.repartition(partitions, "transaction_id")
            .sortWithinPartitions("transaction_id", vector_to_array("features"), "label")
            .persist()
        )
        try:
            fitted = forest.fit(ready)
        finally:
            ready.unpersist()
    finally:
        dealt.unpersist()
    return FraudModel(PipelineModel([prepare, fitted]), codes, quantiles, partitions)


def train_and_test(labelled: DataFrame) -> tuple[FraudModel, DataFrame]:
    """Fit on the training part of the labelled rows and predict the test part.

    The split is written out once, so that no later pass hashes and cuts again.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col("is_fraud").isNotNull())
    split = work_dir(spark, "split")
    stratified_split(known, "is_fraud", "transaction_id").write.parquet(split)
    parts = spark.read.parquet(split)
    model = fit_model(parts.where(F.col("split") == "train").drop("split"))
    return model, model.predict(parts.where(F.col("split") == "test").drop("split"))


def score_from_nodes(rows: DataFrame, model: FraudModel, nodes: DataFrame) -> DataFrame:
    """Add `ml_score` by walking the saved table of nodes, without the forest's own classes.

    No row is shuffled; the table goes to the tasks once, as one value of bounded size. Batches of
    rows walk it in Python workers: in expressions, each of its copies was longer than a row by far.
    """
    features = F.array(*[F.col(c).cast("double") for c in FEATURES])
    depth = model.pipeline.stages[-1].getMaxDepth()
    scored = model.inputs(rows)
    share = mean_share_of_forest(nodes, features, depth)
    return scored.select(*rows.columns, F.round(share, SCORE_DIGITS).alias("ml_score"))


def score_with_model(rows: DataFrame, model: FraudModel | None) -> DataFrame:
    """Score rows with the model, or with the rules while there is no model, and raise the flag."""
    ruled = rows.withColumn("rule_score", rule_score())
    if model is None:
        scored = ruled.withColumn("ml_score", F.lit(None).cast("double"))
    else:
        probability = F.round("fraud_probability", SCORE_DIGITS).alias("ml_score")
        scored = model.predict(ruled).select(*ruled.columns, probability)
    best = F.coalesce("ml_score", "rule_score")
    return scored.withColumn("fraud_score", best).withColumn("is_fraud", fraud_flag())
