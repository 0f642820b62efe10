from __future__ import annotations

import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tallybrook.llm import common, sharding
from tallybrook.llm.queries import op10_sharding
from tests.conftest import plan_of


def draw_of(key, leaf):
    """Spark hashes columns one after another, each with the hash before as its seed."""
    seed = xxhash.xxh64_intdigest(key.encode(), 42)
    place = f"{leaf.region}/{leaf.rack}/{leaf.shard}"
    bits = xxhash.xxh64_intdigest(place.encode(), seed) >> 12
    return -math.log((bits + 0.5) / 2**52) / leaf.weight


def shard_by_hand(key, leaves):
    """Level by level: the draw of a subtree is its smallest."""

    def best(group, level):
        children = {}
        for leaf in group:
            name = (leaf.region, leaf.rack, leaf.shard)[level]
            children.setdefault(name, []).append(leaf)
        name = min(children, key=lambda c: (min(draw_of(key, x) for x in children[c]), c))
        return name if level == 2 else best(children[name], level + 1)

    return best(leaves, 0)


def place_all(spark, n, leaves):
    keys = spark.range(n).select(F.col("id").cast("string").alias("key"))
    rows = keys.select("key", sharding.shard_of(F.col("key"), leaves).alias("shard")).collect()
    return {r.key: r.shard for r in rows}


def test_descent_equals_the_rule(spark):
    leaves = sharding.layout(9, regions=3, racks=2)
    got = place_all(spark, 300, leaves)
    assert got == {key: shard_by_hand(key, leaves) for key in got}


def test_shares_follow_weights_and_changes_stay_in_their_leaf(spark):
    leaves = [sharding.Leaf(i % 2, i // 2 % 2, i, 1.0 + i % 3) for i in range(7)]
    before = place_all(spark, 20_000, leaves)
    total = sum(leaf.weight for leaf in leaves)
    for leaf in leaves:
        share = sum(s == leaf.shard for s in before.values()) / len(before)
        assert share == pytest.approx(leaf.weight / total, abs=0.02)
    heavier = [
        sharding.Leaf(x.region, x.rack, x.shard, 4.0 if x.shard == 3 else x.weight) for x in leaves
    ]
    after = place_all(spark, 20_000, heavier)
    moved = [k for k in before if before[k] != after[k]]
    assert moved and all(after[k] == 3 for k in moved)


def test_no_leaves_or_weights(spark):
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("key"), [])
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("key"), [sharding.Leaf(0, 0, 0, 0.0)])


def check(rows, texts, shards=8):
    """Every row once, the law held, and slots without gaps."""
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    want = Counter()
    for doc_id, text in texts:
        data = (text or "").encode()
        want[doc_id, len(data) + 1, zlib.crc32(data)] += 1
    assert got == want
    slots, places = {}, {}
    for r in rows:
        assert r.law == "key" and 0 <= r.shard < shards
        assert r.grown_shard in (r.shard, shards)
        assert places.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        slots.setdefault(r.shard, []).append(r.slot)
    for numbers in slots.values():
        assert sorted(numbers) == list(range(len(numbers)))


def test_rows_with_nulls_copies_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(sharding, "bucket_bits", lambda rows: 5)
    texts = [(i % 70, f"text {i % 9}") for i in range(300)]
    texts += [(None, "a"), (None, None), (1, ""), (2, None), (3, "é" * 40_000)] + [(4, "x")] * 50
    docs = spark.createDataFrame(
        [(*t, "zzz", 1) for t in texts], "doc_id bigint, text string, shard string, size int"
    )
    first = sharding.shard_rows(docs).collect()
    check(first, texts)
    again = sharding.shard_rows(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, first))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.shard_rows(none).collect() == []


def test_query_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frame = op10_sharding(spark, sf_dir)
    assert "Python" not in plan_of(frame) and "Arrow" not in plan_of(frame)
    rows = frame.collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    for r in rows[:50]:
        assert r.shard == shard_by_hand(str(r.doc_id), sharding.layout(8))
        assert r.grown_shard == shard_by_hand(str(r.doc_id), sharding.layout(9))


def test_running_sums_do_not_depend_on_buckets(spark):
    rows = spark.range(500).select(
        (F.col("id") % 3).alias("g"),
        F.shiftrightunsigned(F.xxhash64("id"), 4).alias("key"),
        F.col("id").alias("n"),
    )
    sums = [
        sorted(map(tuple, common.running_sum(rows, ["g"], "key", ["n"], "n", bits).collect()))
        for bits in (0, 4, 9)
    ]
    assert sums[0] == sums[1] == sums[2]
    total = 0
    for g, _, n, before in sorted(sums[0]):
        if g == 1:
            assert before == total
            total += n
