"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import stored


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    around = _both(links)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (
        around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    ).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    joined = down.join(least, "a")
    return (
        joined.where("b != least")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .union(least.select("a", F.col("least").alias("b")))
        .distinct()
    )


def smallest_reachable(
    links: DataFrame, nodes: DataFrame, node: str, number: str
) -> DataFrame:
    """`node`, root (the component's smallest node) and component_id, its smallest `number`.

    `links` has columns a and b. Rounds of two stars, each written to the shared folder, halve
    long chains; they end when a round changes nothing, with every node tied to the smallest of
    its component. A hub with many neighbours is reduced before the shuffle.
    """
    edges = stored(links.where("a != b").select("a", "b").distinct(), "links")
    state = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        row = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    root = edges.select(F.col("a").alias(node), F.col("b").alias("_root"))
    rooted = nodes.join(root, node, "left").withColumn("_root", F.coalesce("_root", node))
    least = rooted.groupBy("_root").agg(F.min(number).alias("component_id"))
    return rooted.join(least, "_root").select(
        node, F.col("_root").alias("root"), "component_id"
    )
