"""Label-wise train/test split and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Share of training rows, random seed.
TRAIN_SHARE = 0.8
SEED = 42

#: Rows of a label that share a hash prefix, about: those of one prefix are ranked.
PREFIX_ROWS = 4096


def split_key(row_id: str, seed: int = SEED) -> Column:
    """Pseudo-random order of the rows that any engine can recompute."""
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))


def split_cuts(
    rows: DataFrame, label: str, row_id: str, share: float = TRAIN_SHARE, seed: int = SEED
) -> DataFrame:
    """Per label, the last (hash, id) that belongs to the training part.

    Counts per hash prefix find the prefix in which each label's cut falls; only the rows of
    that prefix, about PREFIX_ROWS whatever the number of all, are then ranked.
    """
    hashed = rows.select(label, row_id, split_key(row_id, seed).alias("hash"))
    total, length = rows.count(), 1
    while 16**length * PREFIX_ROWS < total:
        length += 1
    prefix = F.substring("hash", 1, length)
    by_prefix = W.partitionBy(label).orderBy("prefix")
    wanted = F.floor(F.sum("n").over(W.partitionBy(label)).cast("double") * F.lit(share))
    cut = (
        hashed.groupBy(label, prefix.alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(label, "prefix", "n", F.sum("n").over(by_prefix).alias("upto"), wanted.alias("k"))
        .where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
        .select(label, "prefix", (F.col("k") - F.col("upto") + F.col("n")).alias("rank"))
    )
    # one row per label value; copies of an id count as often as they occur but travel once
    near = hashed.withColumn("prefix", prefix).join(F.broadcast(cut), [label, "prefix"])
    copies = near.groupBy(label, "rank", "hash", row_id).agg(F.count(F.lit(1)).alias("n"))
    position = F.sum("n").over(W.partitionBy(label).orderBy("hash", row_id))
    return (
        copies.withColumn("upto", position)
        .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        .select(label, F.col("hash").alias("cut_hash"), F.col(row_id).alias("cut_id"))
    )


def stratified_split(
    rows: DataFrame, label: str, row_id: str, share: float = TRAIN_SHARE, seed: int = SEED
) -> DataFrame:
    """Add `split`: the exact first share of every label, in hash order, is 'train'.

    `label` is a flag, so the cuts are two rows; the rows themselves are never shuffled.
    """
    cuts = split_cuts(rows, label, row_id, share, seed)
    key = split_key(row_id, seed)
    in_train = (key < F.col("cut_hash")) | (
        (key == F.col("cut_hash")) & (F.col(row_id) <= F.col("cut_id"))
    )
    split = F.when(in_train, "train").otherwise("test").alias("split")
    return rows.join(F.broadcast(cuts), label, "left").select(
        *[rows[c] for c in rows.columns], split
    )


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class: rows / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy()  # over one row per class
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return counts.withColumn("weight", weight)


def label_profile(rows: DataFrame, label: str) -> DataFrame:
    """Row count and share of positive labels."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(label).cast("int")).alias("label_mean")
    )
