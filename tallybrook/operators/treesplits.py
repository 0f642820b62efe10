"""The first levels of a decision tree by class-weighted Gini impurity, grown from histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Payments' amounts fall into bins of this many EGP, up to the last bin.
AMOUNT_BIN = 100
LAST_BIN = 50_000
#: Digits of impurities: what is equal up to here is a tie.
DIGITS = 9


def amount_bin(amount: str = "amount_egp") -> Column:
    """The lower end of an amount's bin; bins are as many whatever the number of rows."""
    value = F.floor(F.col(amount) / AMOUNT_BIN) * AMOUNT_BIN
    return F.least(value, F.lit(LAST_BIN)).cast("double")


def _gini(fraud: Column, other: Column) -> Column:
    whole = fraud + other
    return F.lit(1.0) - (fraud / whole) * (fraud / whole) - (other / whole) * (other / whole)


def class_totals(rows: DataFrame) -> DataFrame:
    """One row: how many rows have label 1 and label 0."""
    return rows.agg(
        F.sum("label").cast("double").alias("_p"),
        F.sum(F.lit(1) - F.col("label")).cast("double").alias("_q"),
    )


def best_splits(rows: DataFrame, features: Sequence[str], totals: DataFrame) -> DataFrame:
    """node, feature, threshold, impurity and gain: the split that most lowers the impurity.

    `rows` has a 0/1 column `label`, the column `node`, and numeric features with few distinct
    values; classes
    weigh as much in total as each other by `totals`, those of the whole tree. Values up to the threshold go left. Rows are
    summed per node, feature and value before any shuffle; windows see these sums only. Equal
    gains fall to the feature and then the threshold that sort first. A null value goes to no
    side; a node whose rows have one label or one value has no split.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
            for f in features
        ]
    )
    long = rows.select("node", "label", F.inline(pairs))
    counts = (
        long.where("value IS NOT NULL")
        .groupBy("node", "feature", "value")
        .agg(
            F.sum("label").alias("fraud"),
            F.sum(F.lit(1) - F.col("label")).alias("other"),
        )
    )
    upto = Window.partitionBy("node", "feature").orderBy("value")
    every = Window.partitionBy("node", "feature")
    sums = counts.select(
        "node",
        "feature",
        F.col("value").alias("threshold"),
        F.sum("fraud").over(upto).alias("lf"),
        F.sum("other").over(upto).alias("lo"),
        F.sum("fraud").over(every).alias("f"),
        F.sum("other").over(every).alias("o"),
        F.max("value").over(every).alias("last"),
    ).where("threshold < last")
    # counts are exact; the weights of the classes, one row, come last
    sums = sums.crossJoin(F.broadcast(totals)).withColumns(
        {
            **{c: F.col(c) / F.nullif("_p", F.lit(0.0)) for c in ("lf", "f")},
            **{c: F.col(c) / F.nullif("_q", F.lit(0.0)) for c in ("lo", "o")},
        }
    )
    lf, lo, f, o = (F.col(c) for c in ("lf", "lo", "f", "o"))
    impurity = _gini(f, o)
    split = ((lf + lo) * _gini(lf, lo) + (f - lf + o - lo) * _gini(f - lf, o - lo)) / (f + o)
    scored = sums.select(
        "node",
        "feature",
        "threshold",
        F.round(impurity, DIGITS).alias("impurity"),
        F.round(impurity - split, DIGITS).alias("gain"),
    ).where("gain > 0")
    first = F.struct((-F.col("gain")).alias("loss"), "feature", "threshold", "impurity")
    best = scored.groupBy("node").agg(F.min(first).alias("s"))
    return best.select(
        "node", "s.feature", "s.threshold", "s.impurity", (-F.col("s.loss")).alias("gain")
    )


def place(rows: DataFrame, splits: DataFrame, features: Sequence[str]) -> DataFrame:
    """Send rows to the children of their nodes: 2 n and 2 n + 1. Rows of nodes without a split
    and rows without the value asked for end here."""
    value = F.coalesce(*[F.when(F.col("feature") == f, F.col(f).cast("double")) for f in features])
    chosen = splits.select("node", "feature", "threshold")
    return (
        rows.join(F.broadcast(chosen), "node")
        .withColumn("_value", value)
        .where("_value IS NOT NULL")
        .withColumn("node", F.col("node") * 2 + (F.col("_value") > F.col("threshold")).cast("int"))
        .select(rows.columns)
    )


def first_levels(rows: DataFrame, features: Sequence[str], levels: int = 2) -> DataFrame:
    """depth, node, feature, threshold, impurity, gain of the first `levels` of the tree.

    A level's splits are at most 2 ** depth rows, which go to all executors to place the rows of
    the next level.
    """
    rows, found = rows.withColumn("node", F.lit(1).cast("bigint")), None
    totals = class_totals(rows)
    for depth in range(levels):
        splits = best_splits(rows, features, totals)
        level = splits.select(F.lit(depth).alias("depth"), *splits.columns)
        found = level if found is None else found.unionByName(level)
        rows = place(rows, splits, features)
    return found


def grown_tree(rows: DataFrame, features: Sequence[str], splits: DataFrame, levels: int) -> DataFrame:
    """The tree of `splits`, as `first_levels` found them in `rows`, as a table of nodes.

    Columns are those of `nodetable` and `path`, the number of a node by which its children are
    2 n and 2 n + 1. A node is a leaf where no split was found or no level is left; `share` weighs
    classes as in the splits. Every window sees at most 2 ** (levels + 1) rows.
    """
    rows, counted = rows.withColumn("node", F.lit(1).cast("bigint")), None
    totals = class_totals(rows)
    for depth in range(levels + 1):
        level = rows.groupBy("node").agg(
            F.sum("label").alias("fraud"), F.sum(F.lit(1) - F.col("label")).alias("other")
        )
        counted = level if counted is None else counted.unionByName(level)
        if depth < levels:
            rows = place(rows, splits.where(F.col("depth") == depth), features)
    number = F.coalesce(
        *[F.when(F.col("feature") == f, F.lit(i)) for i, f in enumerate(features)], F.lit(-1)
    )
    fraud = F.col("fraud") / F.nullif("_p", F.lit(0.0))
    other = F.col("other") / F.nullif("_q", F.lit(0.0))
    known = (
        counted.crossJoin(F.broadcast(totals))
        .select(F.col("node").alias("path"), (fraud / (fraud + other)).alias("share"))
        .join(F.broadcast(splits.withColumnRenamed("node", "path")), "path", "left")
        .withColumn("node", F.row_number().over(Window.orderBy("path")) - 1)
    )
    children = known.select((F.col("path")).alias("_path"), F.col("node").alias("_node"))
    left, right = (
        children.select(F.col("_path").alias(f"_{side}"), F.col("_node").alias(f"{side}_child"))
        for side in ("left", "right")
    )
    split = F.col("feature").isNotNull()
    return (
        known.withColumn("_left", F.when(split, F.col("path") * 2))
        .withColumn("_right", F.when(split, F.col("path") * 2 + 1))
        .join(F.broadcast(left), "_left", "left")
        .join(F.broadcast(right), "_right", "left")
        .select(
            F.lit(0).alias("tree"),
            "node",
            number.alias("feature"),
            "threshold",
            F.coalesce("left_child", F.lit(-1)).alias("left_child"),
            F.coalesce("right_child", F.lit(-1)).alias("right_child"),
            "share",
            "path",
        )
    )
