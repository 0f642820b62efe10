"""Trees as a table of nodes: saved with a model, read by any SQL engine, scored in expressions or,
for a forest, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: tree and node number it from 0 without gaps; the root is node 0. A row whose value of `feature`
#: is at most `threshold` goes to `left_child`, any other, also one without a value, to
#: `right_child`. Both are -1 at a leaf. `share` is the weighted share of fraud at the node.
NODE_COLUMNS = ["tree", "node", "feature", "threshold", "left_child", "right_child", "share"]


def forest_nodes(spark: SparkSession, pipeline: str) -> DataFrame:
    """The node table of the forest in a saved pipeline; `feature` counts the model's inputs."""
    saved = spark.read.parquet(f"{pipeline}/stages/*_RandomForestClassifier_*/data")
    stats = F.col("nodeData.impurityStats")
    return saved.select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("nodeData.leftChild").alias("left_child"),
        F.col("nodeData.rightChild").alias("right_child"),
        (stats[1] / F.nullif(stats[0] + stats[1], F.lit(0.0))).alias("share"),
    )


def with_trees(rows: DataFrame, nodes: DataFrame, name: str = "_trees") -> DataFrame:
    """Add the whole table as one value: an array of trees, each an array of nodes by number.

    Its size is that of the model, at most trees * 2 ** (depth + 1) nodes whatever the number of
    rows it was fitted on or will score. It is found once, but a row carries a copy of it: for
    trees of few nodes.
    """
    node = F.struct("node", *NODE_COLUMNS[2:])
    trees = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    ordered = F.sort_array(F.collect_list(F.struct("tree", "nodes")))
    return rows.withColumn(name, trees.agg(F.transform(ordered, lambda t: t["nodes"])).scalar())


def leaf_of(nodes: Column, features: Column, depth: int) -> Column:
    """The number of the node of one tree, an array of nodes, at which a row ends."""

    def step(at: Column, _: Column) -> Column:
        node = F.get(nodes, at)
        goes_left = F.get(features, node["feature"]) <= node["threshold"]
        onward = F.when(goes_left, node["left_child"]).otherwise(node["right_child"])
        return F.when(node["left_child"] < 0, at).otherwise(onward)

    levels = F.array(*[F.lit(i) for i in range(depth)]).cast("array<int>")
    return F.aggregate(levels, F.lit(0), step)


def mean_share(trees: Column, features: Column, depth: int) -> Column:
    """The mean over all trees of the fraud share of a row's leaf; null without a tree.

    A leaf without rows has no share and counts as 0, as an empty vote does.
    """

    def share(nodes: Column) -> Column:
        return F.coalesce(F.get(nodes, leaf_of(nodes, features, depth))["share"], F.lit(0.0))

    total = F.aggregate(F.transform(trees, share), F.lit(0.0), lambda a, b: a + b)
    return total / F.nullif(F.size(trees), F.lit(0))


def mean_share_of_forest(nodes: DataFrame, features: Column, depth: int) -> Column:
    """What `mean_share` finds, for a table of many nodes: the rows of a batch go down together.

    The table, whose size is that of the model, is sent to every executor once.
    """
    table = nodes.select(*NODE_COLUMNS).orderBy("tree", "node").toArrow()
    columns = {name: table[name].to_numpy() for name in NODE_COLUMNS}
    place = np.arange(table.num_rows)
    root = place - columns["node"]
    leaf = columns["left_child"] < 0
    walk = nodes.sparkSession.sparkContext.broadcast(
        {
            "roots": place[columns["node"] == 0],
            "feature": columns["feature"],
            "threshold": columns["threshold"],
            "left": np.where(leaf, place, root + columns["left_child"]),
            "right": np.where(leaf, place, root + columns["right_child"]),
            "share": np.nan_to_num(columns["share"].astype("float64")),
        }
    )

    @F.arrow_udf("double")
    def mean(rows: pa.Array) -> pa.Array:
        trees = walk.value
        if not len(rows) or not len(trees["roots"]):
            return pa.nulls(len(rows), pa.float64())
        # a missing value is NaN here, and neither is at most a threshold
        values = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        each = np.arange(len(rows))
        total = np.zeros(len(rows))
        for root in trees["roots"]:
            at = np.full(len(rows), root)
            for _ in range(depth):
                goes_left = values[each, trees["feature"][at]] <= trees["threshold"][at]
                at = np.where(goes_left, trees["left"][at], trees["right"][at])
            total += trees["share"][at]
        return pa.array(total / len(trees["roots"]))

    return mean(features)
