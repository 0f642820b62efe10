from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallybrook.llm import jaccardjoin, queries
from tallybrook.llm.jaccardjoin import (
    counted,
    indexed_tokens,
    jaccard_components,
    shingles,
    signatures,
)

SCHEMA = "doc_id bigint, text string"


def word_sets(text) -> frozenset:
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(3, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows) -> dict[int, tuple[int, int]]:
    """n_shingles and component by doc_id, all pairs of texts that share a shingle compared."""
    sets = [word_sets(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    having: dict = {}
    for i, own in enumerate(sets):
        common = Counter(j for shingle in own for j in having.get(shingle, ()))
        for j, n in common.items():
            if 100 * n >= 90 * (len(own) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for shingle in own:
            having.setdefault(shingle, []).append(i)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {
        doc_id: (len(sets[i]), least.get(find(i), doc_id) if sets[i] else doc_id)
        for i, (doc_id, _) in enumerate(rows)
    }


def found(frame) -> dict[int, tuple[int, int]]:
    assert frame.columns == ["doc_id", "n_shingles", "component_id"]
    rows = frame.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def corpus(seed: int, groups: int = 30, copies: int = 25) -> list[tuple[int, str]]:
    """Groups of near copies at several distances, chains, passages in common, single texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    texts = []
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([4, 12, 40, 120, 400]))
        if g % 3 == 0:
            base = passage + base
        texts.append(base)
        for _ in range(rng.randrange(copies)):
            copy = list(rng.choice(texts[-5:]) if g % 2 else base)
            for _ in range(rng.randrange(1 + max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    rng.shuffle(texts)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("classes", [jaccardjoin.CLASSES, (2, 4), (0, 0), (1, 100)])
def test_components_equal_brute_force(spark, classes):
    rows = corpus(7, 20, 15)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 20
    assert found(jaccard_components(docs, 8, classes, 5)) == want


def test_a_large_group_of_near_copies_without_their_origin(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(1500):
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(jaccard_components(docs)) == brute(rows)


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE "), (6, "one two"), (7, "one two three"),
        (8, "one\x0btwo\x0cthree"), (9, "One Two\x85Three"), (10, "a b c " * 9), (11, "a b c " * 5),
        (12, "long text of words " * 30_000), (13, "É a b"), (14, "é a b"), (15, "x y"), (16, "one\x00two"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS node", "2 AS token", "3 AS `a.b`", "4 AS n", "5 AS sig"
    )
    assert found(jaccard_components(docs)) == brute(rows)
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_and_repeated_ids(spark):
    text = "one two three four five"
    rows = [(None, text), (None, text), (9, text), (9, text), (4, "other words are in here"), (9, None)]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(None, 3, 9), (None, 3, 9), (9, 3, 9), (9, 3, 9), (4, 3, 4), (9, 0, 9)], key=str
    )
    only = jaccard_components(spark.createDataFrame([(None, text)] * 2, SCHEMA)).collect()
    assert [tuple(r) for r in only] == [(None, 3, None)] * 2


def test_documents_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op13_jaccard_join(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("classes", [(0, 0), (0, 10**9), (3, 6), (10**9, 10**9)])
@pytest.mark.parametrize("bits", [0, jaccardjoin.COUNTED_BITS])
def test_linked_sets_share_a_signature(classes, bits):
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.choice([1, 2, 5, 9, 11, 12, 20, 50, 130, 400, 700]))
        union = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
        n = len(union)
        cut = int(rng.integers(0, n // 10 + 1))
        out = rng.permutation(n)[:cut]
        side = rng.random(cut) < rng.random()
        both = [np.delete(union, out[side]), np.delete(union, out[~side])]
        known = np.where(counted(union, bits), rng.integers(2, 9, n), jaccardjoin.UNCOUNTED)
        only = out[counted(union[out], bits)]
        known[only[::2]] = 1
        df = dict(zip(union.tolist(), known.tolist()))
        sigs = []
        for own in both:
            order, number = indexed_tokens(own, bits)
            order = sorted(order.tolist(), key=lambda t: (df[t], t))
            tokens = np.array(order, dtype=np.uint64)
            of = np.array([df[t] for t in order])
            sigs.append(signatures(tokens[of > 1], of[of > 1], len(own), number, classes))
        assert len(np.intersect1d(*sigs))


def test_frequencies_stream_over_batches():
    rng = np.random.default_rng(2)
    rows = np.unique(rng.integers(0, 12, (900, 2)) ** 2 * 4, axis=0)
    rows[:, 0] += rows[:, 0] // 4 % 5 == 0
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    rows = np.repeat(rows, rng.integers(1, 3, len(rows)), axis=0)
    df = Counter(t for t, _ in {tuple(r) for r in rows.tolist()})
    for most in (3, 7, 100):
        for size in (1, 2, 5, 50):
            batches = [
                pa.RecordBatch.from_arrays(
                    [pa.array(b[:, 0]), pa.array(b[:, 1]), pa.array(b[:, 0])],
                    names=["token", "node", "sizes"],
                )
                for b in (rows[i : i + size] for i in range(0, len(rows), size))
            ]
            got = [
                tuple(r.values())
                for b in jaccardjoin._frequencies(iter(batches), most, jaccardjoin.COUNTED_BITS)
                for r in b.to_pylist()
            ]
            want = {
                (n, min(df[t], most + 1) if t % 4 == 0 else jaccardjoin.UNCOUNTED, t, t)
                for t, n in map(tuple, rows.tolist())
                if df[t] > 1 or t % 4
            }
            assert len(got) == len(want) and set(got) == want


def test_shingles_are_distinct_and_sorted():
    own = shingles("a b c a b c a b c")
    assert len(own) == 3 and (own[1:] > own[:-1]).all()
    assert not np.intersect1d(shingles("a b"), shingles("a b a")).size


def test_near_copies_that_do_not_link_make_few_pairs(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(700):
        copy = list(base) if i % 10 or i == 0 else rows[rng.randrange(i)][1].split()
        for _ in range(rng.randrange(5, 9) if i % 10 else 1):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(25)}"
        rows.append((i, " ".join(copy)))
    compared = []
    verified = jaccardjoin._verified

    def watched(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(jaccardjoin, "_verified", watched)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows)
    assert found(jaccard_components(docs)) == want
    assert 300 < len({c for _, c in want.values()}) < len(rows)
    assert sum(compared) < 2 * len(rows)


def test_sketches_of_linked_sets_are_near():
    rng = np.random.default_rng(8)
    for n in (1, 9, 20, 130, 400, 3000):
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for cut in {0, 1, n // 20, n // 10}:
            other = np.unique(np.append(own[cut:], rng.integers(0, 1 << 63, cut // 2, dtype=np.uint64)))
            bits = sum(
                int(x).bit_count()
                for x in (jaccardjoin.sketch(own) ^ jaccardjoin.sketch(other)).view(np.uint64)
            )
            assert bits <= len(np.setxor1d(own, other))


def test_sets_of_many_texts_do_not_depend_on_their_place(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " ", "x" * 64, "x" * 65, "x" * 64 + "y", "y" * 200_000 + " one TWO three é\x85É", "a\x0bB\x0cc\x1cd\x1fe f"]
    texts += [" ".join(f"{rng.choice('aB')}{rng.randrange(5000)}" for _ in range(n)) for n in (1, 2, 3, 40_000)]
    sets = jaccardjoin.shingle_sets(texts)
    assert [len(own) for own in sets] == [len(word_sets(t)) for t in texts]
    monkeypatch.setattr(jaccardjoin, "GROUP_BYTES", 100)
    mixed = jaccardjoin.shingle_sets(["ab " * rng.randrange(50) + (t or "") for t in texts[::-1]] + texts)
    for own, again in zip(sets, mixed[len(texts) :]):
        assert (own == again).all()
    assert (sets[-1] == shingles(texts[-1].upper())).all()
    assert len({shingles(t).tobytes() for t in ("x" * 64, "x" * 65, "x" * 64 + "y", "x" * 63)}) == 4
