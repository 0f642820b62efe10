from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from check_queries import compare, connect
from tallybrook.llm import quality
from tallybrook.llm.queries import ORACLES, op1_quality
from tests.conftest import plan_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, kept string, n_words int"


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
        failed,
    )


def odd_texts():
    draw = random.Random(3)
    texts = [None, "", " ", "\n\n", "one", "a b c d e", "a b c d e a b c d e", "x " * 40, "é ü 😀 b"]
    texts += ["l1\nl2\nl1\n\n \nl1", "#*$%&|<> a\x0bb\x1cc\x85d", "a b\ta\rb\fa b", "w" * 90_000]
    texts += [" ".join(draw.choices("abc", k=draw.randint(4, 60))) for _ in range(200)]
    texts += [" ".join(str(i % 4000) for i in range(9000))]
    return texts


def docs_of(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, "?", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_statistics_equal_brute_force(spark):
    texts = odd_texts()
    got = {r.doc_id: tuple(r)[1:7] for r in quality.quality(docs_of(spark, texts)).collect()}
    assert got == {i: base_of(t) for i, t in enumerate(texts)}


def fitted(spark, points, pool="p"):
    rows = [(pool, *map(int, x)) for x in points]
    vectors = spark.createDataFrame(rows, "pool string, x1 bigint, x2 bigint, x3 bigint, x4 bigint, x5 bigint")
    return quality.covariance_estimates(vectors)


def test_estimates_equal_numpy_and_resist_outliers(spark):
    make = np.random.default_rng(5)
    mixing = make.normal(size=(5, 5)) * 150
    good = make.normal(size=(800, 5)) @ mixing + 2000
    bad = make.normal(size=(150, 5)) * 20 + 6000
    points = np.rint(np.concatenate([good, bad])).astype(int)
    row = fitted(spark, points).first()
    centre = np.array([row[f"m{i}"] for i in range(5)])
    assert np.abs(centre - good.mean(axis=0)).max() < 80
    inverse = np.array([[row[f"p{max(i, j)}{min(i, j)}"] for j in range(5)] for i in range(5)])
    off = points - centre
    distance = np.einsum("ij,jk,ik->i", off, inverse, off)
    assert distance[800:].min() > distance[:800].max()
    # one more step from here: refit to the nearest share, which may not raise the determinant
    bins = np.minimum(np.floor(np.sqrt(distance) * quality.DISTANCE_STEP), quality.MAX_BIN)
    sizes = np.cumsum(np.bincount(bins.astype(int)))
    cut = int(np.argmax(sizes >= quality.COVERED * len(points)))
    assert row["cut"] == cut
    near = points[bins <= cut]
    floors = np.diag([float(f) ** 2 for f in quality.FLOORS])
    refit = np.cov(near.T, bias=True) + floors
    assert np.sqrt(np.linalg.det(refit)) <= row["determinant"] * (1 + 1e-9)
    assert np.linalg.inv(inverse) == pytest.approx(
        np.linalg.inv(inverse).T, rel=1e-6
    ) and np.sqrt(np.linalg.det(np.linalg.inv(inverse))) == pytest.approx(row["determinant"])


def test_equal_rows_have_a_finite_estimate(spark):
    row = fitted(spark, [[2000, 0, 0, 0, 300]] * 100).first()
    assert row["determinant"] == pytest.approx(np.prod([float(f) for f in quality.FLOORS]))


def test_verdicts(spark):
    draw = random.Random(9)
    plain = [
        " ".join("".join(draw.choices("abcdefgh", k=draw.randint(3, 7))) for _ in range(draw.randint(20, 200)))
        for _ in range(150)
    ]
    junk = [t.replace(" ", "### ") for t in plain[:8]]
    got = {r.doc_id: r for r in quality.quality(docs_of(spark, plain + junk)).collect()}
    assert all(got[i].kept for i in range(len(plain)))
    assert not any(got[len(plain) + i].kept for i in range(len(junk)))


def test_rows_with_nulls_ties_and_clashing_names(spark):
    texts = ["word " + " ".join(f"w{i}" for i in range(20))] * 90
    rows = [(i % 3, t, None, None, "?", -1) for i, t in enumerate(texts)]
    rows += [(None, None, "en", None, "?", 1), (None, "", None, "s", "?", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    assert sum(r.kept for r in got) == len(texts)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    assert {r.kept for r in kept.collect()} == {"?"}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality.quality(none).collect() == []
    assert quality.keep_good(none).collect() == []


def test_pools_join_small_groups(spark):
    groups = [("en", "a", 60), ("en", "b", 40), ("en", None, 30), ("fr", "a", 10), (None, "a", 5)]
    rows = [(lang, s) for lang, s, n in groups for _ in range(n)]
    frame = spark.createDataFrame(rows, "lang string, source string")
    got = Counter(r.pool for r in quality._with_pool(frame, quality._pools(frame)).select("pool").collect())
    assert sorted(got.values()) == [15, 60, 70]


def test_query_equals_its_sql(spark, sf_dir):
    verdict = compare(spark, connect(sf_dir), sf_dir, "op1", op1_quality, ORACLES["op1_quality"])
    assert verdict.startswith("match"), verdict


def test_query_over_the_table(spark, sf_dir):
    frame = op1_quality(spark, sf_dir)
    assert "Python" not in plan_of(frame) and "Arrow" not in plan_of(frame)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got) == len(docs)
    for doc in docs:
        row = got[doc.doc_id]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert tuple(row[n] for n in names) == base_of(doc.text)
        assert not (row.kept and row.base_failed)
