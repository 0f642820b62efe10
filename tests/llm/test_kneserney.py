from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest

from tallybrook.llm import kneserney as kn

SCHEMA = "doc_id bigint, text string, n_tokens int, lang string"


def docs_of(spark, texts):
    rows = [(i, t, -1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words_of(text):
    return (text or "").encode().lower().split() + [b"</end>"]


def expected(train, texts):
    """Scores by the textbook formulas over plain dictionaries."""
    pairs, words = Counter(), Counter()
    for text in train:
        before = "start"
        for word in words_of(text):
            words[word] += 1
            pairs[before, word] += 1
            before = word
    follow, total = defaultdict(list), Counter()
    for (u, _), n in pairs.items():
        follow[u].append(n)
        total[u] += n
    continued = Counter(w for _, w in pairs)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        ds = [0.0]
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and y else k / 2
            ds.append(min(max(d, 0.0), k))
        return ds

    d2, d1 = discounts(pairs.values()), discounts(continued.values())
    left1 = sum(d1[min(c, 3)] for c in continued.values()) / max(1, len(pairs))
    out = []
    for text in texts:
        before, logs, base, known = "start", 0.0, 0.0, 0
        for word in words_of(text):
            c = continued.get(word, 0)
            lower = max(c - d1[min(c, 3)], 0) / max(1, len(pairs)) + left1 / (len(words) + 1)
            if not words:
                lower = 1.0
            p = lower
            if total.get(before):
                n = pairs.get((before, word), 0)
                left = sum(d2[min(x, 3)] for x in follow[before])
                p = (max(n - d2[min(n, 3)], 0) + left * lower) / total[before]
            logs += math.log10(p)
            count = words.get(word, 0)
            known += count > 0
            base += math.log10((count + 1) / (sum(words.values()) + len(words) + 1))
            before = word
        out.append((len(words_of(text)), known, sum(words.values()), base, logs))
    return out


def check(frame, texts, held):
    train = [t for i, t in enumerate(texts) if not held(i)]
    want = expected(train, texts)
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got) == len(texts)
    for i, (n, known, total, base, logs) in enumerate(want):
        row = got[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (
            held(i),
            n,
            known,
            total,
        )
        assert row.base_score == pytest.approx(base)
        assert row.score == pytest.approx(logs)


def out_of_training(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def corpus():
    texts = [
        " ".join(f"w{(i * i + j * (i % 5)) % (7 + i % 11)}" for j in range(3 + i % 13))
        for i in range(60)
    ]
    return texts + ["the THE the cat", "", None, "unseen words here", "a" * 30000, "the cat\n the"]


def test_scores_equal_the_formulas(spark):
    texts = corpus()
    check(kn.train_and_score(docs_of(spark, texts)), texts, out_of_training)


def test_many_buckets_and_hot_contexts_change_nothing(spark):
    texts = corpus()
    docs = docs_of(spark, texts).selectExpr("doc_id", "false AS held_out", "text")
    model = kn.train(docs, bucket_bytes=2000, hot_tokens=20)
    assert model.buckets >= 8 and len(model.hot_contexts) > 2
    check(kn.score(docs, model), texts, lambda i: False)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "a c", "b b a", "c"]
    docs = docs_of(spark, texts).selectExpr("doc_id", "false AS held_out", "text")
    model = kn.train(docs)
    asked = docs_of(spark, ["a", "b", "c", "zzz", None]).selectExpr(
        "doc_id", "false AS held_out", "text"
    )
    first = {r.doc_id: r.score for r in kn.score(asked, model).collect()}
    # probability of each first word: the score less that of the end after it
    after = docs_of(spark, ["a a", "b b", "c c", "zzz zzz"])
    assert set(first) == {0, 1, 2, 3, 4} and len(after.columns) == 4
    own = kn.reader(model)
    import numpy as np

    total = 0.0
    for word in (b"a", b"b", b"c", b"zzz", None):
        token = kn.END if word is None else kn.xxhash.xxh64_intdigest(word)
        ids, _ = own.words(np.array([token], dtype=np.uint64))
        total += 10 ** kn._log_probabilities(own, ids, np.array([1]))[0]
    assert total == pytest.approx(1.0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert kn.train_and_score(none).collect() == []
    # the only document is held out
    alone = next(i for i in range(100) if out_of_training(i))
    row = kn.train_and_score(spark.createDataFrame([(alone, "a b", 0, "x")], SCHEMA)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (
        3,
        0,
        0,
        0.0,
        0.0,
    )


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b", 0, "x"), (5, "a b", 0, "x"), (5, "a b", 0, "x")]
    got = kn.train_and_score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and sum(r.doc_id is None for r in got) == 1
