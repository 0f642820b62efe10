"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import HASH_BITS, bucket_bits, running_sum, stored

DRAW_BITS = 52


@dataclass(frozen=True)
class Leaf:
    """A shard's place in the tree and its share of the data."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, regions: int = 2, racks: int = 2) -> list[Leaf]:
    """Shards dealt to regions and racks in turn; a place never depends on how many there are."""
    return [Leaf(i % regions, i // regions % racks, i) for i in range(shards)]


def _draw(key: Column, leaf: Leaf) -> Column:
    """An exponential variate with the leaf's weight as its rate, fixed by key and place."""
    place = F.lit(f"{leaf.region}/{leaf.rack}/{leaf.shard}")
    bits = F.shiftrightunsigned(F.xxhash64(key, place), 64 - DRAW_BITS)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << DRAW_BITS))) / F.lit(leaf.weight)


def _smallest(draws: Sequence[tuple[Column, Column]]) -> Column:
    """What belongs to the smallest draw; ties go to the smaller child."""
    return F.array_min(F.array(*[F.struct(d.alias("draw"), c.alias("child")) for d, c in draws]))


def _subtree(number: int, smallest: Column) -> tuple[Column, Column]:
    """The draw of a subtree, and the subtree with what is picked below it."""
    below = F.struct(F.lit(number).alias("number"), smallest["child"].alias("picked"))
    return smallest["draw"], below


def shard_of(key: Column, leaves: Sequence[Leaf]) -> Column:
    """The shard a key lands on, descending from region to rack to shard.

    A subtree's draw is the smallest draw of its leaves, which is again an exponential variate,
    with the subtree's total weight as its rate. So each level picks a child in proportion to its
    weight, and a change of one leaf's weight moves keys only into or out of that leaf: no other
    child's draw changes.
    """
    if not leaves or any(leaf.weight <= 0 for leaf in leaves):
        raise ValueError("every tree needs leaves, and every leaf a positive weight")
    ordered = sorted(leaves, key=lambda leaf: (leaf.region, leaf.rack, leaf.shard))
    regions = []
    for region, in_region in groupby(ordered, key=lambda leaf: leaf.region):
        racks = []
        for rack, in_rack in groupby(in_region, key=lambda leaf: leaf.rack):
            shards = _smallest([(_draw(key, leaf), F.lit(leaf.shard)) for leaf in in_rack])
            racks.append(_subtree(rack, shards))
        regions.append(_subtree(region, _smallest(racks)))
    in_region = _smallest(regions)["child"]["picked"]
    in_rack = in_region["picked"]
    return in_rack.cast("int")


def shard_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Place every row of (doc_id, text) in one of `shards` shards, with a gapless slot in it.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot,
    grown_shard (the shard among one more). Only doc_id and the shard count decide the shard, so a
    further shard takes rows into itself alone. Null ids are a key of their own, a null text
    counts as empty. Repeated rows share a shard and get slots of their own; slots follow a
    hash of the row, so they do not depend on file order. Other columns are ignored; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    # equal rows are counted first: their number is then no burden for one task
    rows = (
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
            crc.alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("shard", shard_of(key, layout(shards)))
        .withColumn("grown_shard", shard_of(key, layout(shards + 1)))
        .withColumn(
            "order_key",
            F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 64 - HASH_BITS),
        )
    )
    rows = stored(rows, "shards")
    bits = bucket_bits(rows.count())
    placed = running_sum(
        rows, ["shard"], "order_key", ["doc_id", "text_crc32", "size"], "copies", bits
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("slot"),
        "grown_shard",
    )
