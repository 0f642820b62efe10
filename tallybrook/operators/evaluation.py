"""Evaluation of a score or prediction against the known flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.operators.running import data_bucket, running_totals



def confusion_matrix(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per (label, prediction)."""
    return rows.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support of both classes, 0 where a ratio is undefined."""
    truth, guess = F.col(label), F.col(prediction)
    cells = rows.agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(~truth & ~guess).alias("tn"),
    )
    per_class = F.array(
        *[
            F.struct(
                F.lit(name).alias("class"),
                F.col(hit).cast("double").alias("hit"),
                F.col(wrong).cast("double").alias("wrong"),
                F.col(missed).cast("double").alias("missed"),
            )
            for name, hit, wrong, missed in (("Legit", "tn", "fn", "fp"), ("Fraud", "tp", "fp", "fn"))
        ]
    )

    def ratio(top, bottom):
        return F.round(F.coalesce(F.try_divide(top, bottom), F.lit(0.0)), 6)

    hit, wrong, missed = F.col("hit"), F.col("wrong"), F.col("missed")
    return cells.select(F.inline(per_class)).select(
        "class",
        ratio(hit, hit + wrong).alias("precision"),
        ratio(hit, hit + missed).alias("recall"),
        ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
        (hit + missed).cast("bigint").alias("support"),
    )


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve of a score in [0, 1]; NULL when a class is absent.

    Rank-sum over distinct scores: equal scores count half, rows are aggregated first.
    """
    by_score = rows.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")
    )
    piece = data_bucket(by_score, "score")
    ranked = running_totals(by_score, {"neg_below": "neg"}, order="score", bucket=piece)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    wins = F.sum(pos * (F.col("neg_below") + neg * 0.5))
    area = F.try_divide(wins, F.sum(pos) * F.sum(neg))
    return ranked.agg(F.round(area, 6).alias("auc"))
