from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from check_queries import compare, connect
from tallybrook.llm import mixing
from tallybrook.llm.queries import ORACLES, op8_mixing
from tests.conftest import plan_of

SCHEMA = "doc_id bigint, text string, source string, size string, target int"


def goals_of(sizes):
    """Targets by raising the level source by source."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            return {s: 2 * sizes[s] if s in full else weight[s] * level for s in names}
        full.update(over)


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "?", 1) for r in rows], SCHEMA).repartition(3)


def rows_of(n=400):
    return [(i, "w " * (1 + i * i % 50), f"s{i % 7}") for i in range(n)]


def words_of(text):
    return len((text or "").split())


def test_targets_equal_the_rising_level(spark):
    for sizes in (
        {"a": 100, "b": 100, "c": 100},
        {"a": 1, "b": 1000, "c": 3, None: 50, "B": 7},
        {"x": 0, "y": 10},
        {"only": 12},
        {f"s{i}": 1 + i * i for i in range(20)},
    ):
        rows = spark.createDataFrame(
            [(s, n, 1) for s, n in sizes.items()], "source string, size bigint, copies bigint"
        )
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        assert got == pytest.approx(goals_of(sizes))


def test_hypergeometric_draws_follow_the_law(spark):
    cases = [(20, 8, 10), (7, 7, 3), (9, 0, 4), (1, 1, 0), (120, 30, 60), (6, 3, 6)]
    n = 800
    for total, marked, drawn in cases:
        uniform = (F.col("id") + F.lit(0.5)) / F.lit(float(n))
        draw = mixing.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), uniform)
        got = Counter(r[0] for r in spark.range(n).select(draw).collect())
        whole = math.comb(total, drawn)
        for k in range(0, marked + 1):
            if drawn - k < 0 or drawn - k > total - marked:
                assert got[k] == 0
                continue
            p = math.comb(marked, k) * math.comb(total - marked, drawn - k) / whole
            assert got[k] / n == pytest.approx(p, abs=2 / n)


def test_splitting_keeps_every_block(spark):
    quotas = [5, 0, 100, 1, 33]
    table = spark.range(1).select(F.array(*[F.lit(q) for q in quotas]).alias("quotas"))
    got = mixing.split_quotas(table, levels=3).collect()
    assert len(got) == 8
    assert [sum(r.quotas[i] for r in got) for i in range(5)] == quotas
    sizes = [sum(r.quotas) for r in got]
    assert max(sizes) - min(sizes) <= 1
    again = mixing.split_quotas(table, levels=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_a_million_blocks_split_without_overflow(spark):
    quotas = [600_000, 400_000, 3_000_000_000, 1]
    table = spark.range(1).select(F.array(*[F.lit(q) for q in quotas]).alias("quotas"))
    got = mixing.split_quotas(table, levels=2).collect()
    assert [sum(r.quotas[i] for r in got) for i in range(4)] == quotas
    for i, quota in enumerate(quotas[:3]):
        for r in got:
            assert r.quotas[i] == pytest.approx(quota / 4, abs=6 * math.sqrt(quota))


def test_columns_with_dots_and_clashing_names_stay(spark):
    docs = spark.createDataFrame(
        [(i, "some words here " * (i + 1), "s", i) for i in range(6)],
        "doc_id bigint, text string, source string, `a.b` bigint",
    ).selectExpr("*", "1 AS shard", "2 AS perm")
    rows = mixing.mixed_rows(docs).collect()
    assert rows and all(r["a.b"] == r.doc_id and r.shard == 1 and r.perm == 2 for r in rows)


def check(rows, mixed):
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += words_of(text)
    goals = goals_of(size)
    taken = Counter()
    longest = Counter()
    for r in mixed:
        assert len(r.drawn) <= 2
        assert r.source_size == size[r.source] and r.target == pytest.approx(goals[r.source])
        taken[r.source] += r.size * r.copies * len(r.drawn)
        longest[r.source] = max(longest[r.source], r.size * r.copies)
    for source in goals:
        assert abs(taken[source] - goals[source]) <= longest[source] / 2 + 1e-6
    assert sum(r.copies for r in mixed) == len(rows)


def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    rows = rows_of()
    mixed = mixing.mix(docs_of(spark, rows)).collect()
    check(rows, mixed)
    shards = Counter(d.shard for r in mixed for d in r.drawn)
    assert len(shards) == 16
    # neither the order of rows nor the buckets of the running sums matter
    monkeypatch.setattr(mixing, "bucket_bits", lambda n: 6)
    again = mixing.mix(docs_of(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_rows_with_nulls_copies_and_clashing_names(spark):
    rows = rows_of(60) + [
        (None, "a b c", None),
        (None, None, None),
        (7, "", "s1"),
        (8, "x " * 5000, "s2"),
        (9, "same text", "s3"),
        (9, "same text", "s3"),
    ]
    docs = docs_of(spark, rows)
    mixed = mixing.mix(docs).collect()
    check(rows, mixed)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += words_of(r.text)
    want = Counter()
    for r in mixed:
        want[r.source] += r.size * r.copies * len(r.drawn)
    assert +words == +want


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).collect() == []
    assert mixing.mixed_rows(none).collect() == []


def test_query_equals_its_sql(spark, sf_dir):
    verdict = compare(spark, connect(sf_dir), sf_dir, "op8", op8_mixing, ORACLES["op8_mixing"])
    assert verdict.startswith("match"), verdict


def test_query_over_the_table(spark, sf_dir):
    frame = op8_mixing(spark, sf_dir)
    assert "Python" not in plan_of(frame) and "Arrow" not in plan_of(frame)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = frame.collect()
    assert len(got) == len(docs)
    size, taken, goal, longest = Counter(), Counter(), {}, Counter()
    for r in got:
        doc = docs[r.doc_id]
        assert r["size"] == words_of(doc.text) and r.taken % max(r["size"], 1) == 0
        assert r.taken <= 2 * r["size"]
        size[doc.source] += r["size"]
        taken[doc.source] += r.taken
        goal[doc.source] = r.target
        longest[doc.source] = max(longest[doc.source], r["size"])
    assert goal == pytest.approx(goals_of(size))
    for source, target in goal.items():
        assert abs(taken[source] - target) <= longest[source] / 2
