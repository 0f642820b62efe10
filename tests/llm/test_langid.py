from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallybrook.llm import langid
from tallybrook.llm.queries import op2_language_id


def trees(texts, order):
    """Counts of next bytes per context, over plain dictionaries."""
    found = defaultdict(Counter)
    for text in texts:
        data = b"\0" * order + text
        for i in range(order, len(data)):
            for k in range(order + 1):
                found[data[i - k : i]][data[i]] += 1
    return found


def bits_of(tree, text, order):
    """Code length by walking from the longest context to the shortest, byte by byte."""
    data, total = b"\0" * order + text, 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = tree.get(data[i - k : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / whole)
                break
            total -= math.log2(len(seen) / whole)
        else:
            total += 8
    return total


def model_of(by_lang, order):
    sizes, langs, wins, counts = [], [], [], []
    names = sorted(by_lang)
    for i, name in enumerate(names):
        for context, seen in trees(by_lang[name], order).items():
            for byte, n in seen.items():
                sizes.append(len(context))
                langs.append(i)
                wins.append(int.from_bytes(context + bytes([byte]), "big"))
                counts.append(n)
    return langid.Model(
        names, np.array(sizes), np.array(langs), np.array(wins, dtype=np.uint64), np.array(counts), order
    )


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_equal_the_walk(order, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK_BYTES", 64)
    draw = random.Random(1)
    by_lang = {
        "a": ["".join(draw.choices("abc d", k=80)).encode() for _ in range(4)],
        "b": ["".join(draw.choices("abxé ", k=60)).encode() for _ in range(5)],
    }
    texts = by_lang["a"][:2] + by_lang["b"][:2]
    texts += [b"", b"z", "né".encode(), b"ab" * 400, "".join(draw.choices("abcxyz", k=300)).encode()]
    model = model_of(by_lang, order)
    got = langid.Model.from_bytes(model.to_bytes()).score(texts)
    for row, text in zip(got, texts):
        for bits, name in zip(row, model.langs):
            tree = trees(by_lang[name], order)
            assert bits == pytest.approx(bits_of(tree, text, order), rel=1e-5, abs=1e-4)


def test_counted_contexts(spark):
    texts = [("x", "abab"), ("x", "ba"), ("y", "né")]
    rows = spark.createDataFrame(texts, "lang string, text string").repartition(2)
    got = Counter()
    for r in langid.count_contexts(rows, 2).collect():
        got[r.lang, r.size, r.win] += r.n
    want = Counter()
    for name in ("x", "y"):
        for context, seen in trees([t.encode() for n, t in texts if n == name], 2).items():
            for byte, n in seen.items():
                want[name, len(context), int.from_bytes(context + bytes([byte]), "big")] += n
    assert got == want


def test_hash_table_finds_only_its_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000, dtype=np.uint64))
    table = langid.HashTable(keys, np.arange(len(keys), dtype=np.float32)[:, None])
    assert (table.find(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(np.arange(20_000, dtype=np.uint64), keys)
    assert (table.find(others) == table.absent).all()


SCHEMA = "doc_id bigint, text string, lang string, score string, held_out int"


def test_rows_with_nulls_and_clashing_names(spark):
    rows = [(i, "the and of to in " * 5, "en", "s", 1) for i in range(20)]
    rows += [(100 + i, "der und die das ist " * 5, "de", "s", 1) for i in range(20)]
    rows += [
        (500, None, "en", "s", 1),
        (501, "", None, None, 1),
        (502, "1234 !!", "de", "s", 1),
        (503, "THE AND OF", None, "s", 1),
        (None, "und die", None, "s", 1),
        (503, "THE AND OF", None, "s", 1),
        (504, "und " * 100_000, None, "s", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[500].lang_pred == by_id[501].lang_pred == by_id[502].lang_pred == "und"
    assert by_id[503].lang_pred == "en" and by_id[504].lang_pred == "de"
    assert by_id[None].lang_pred == "de"
    for r in got:
        assert 0 <= r.score <= 1
        name = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(name.encode()) % 5 == 0)
    sure = langid.recognized(docs, 0.5)
    assert sure.columns == docs.columns
    kept = sorted(str(r) for r in sure.collect())
    assert kept == sorted(str(r) for r in docs.collect() if r.doc_id not in (500, 501, 502))


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert langid.recognized(none, 0.5).collect() == []
    assert langid.identify(none).collect() == []
    row = langid.identify(spark.createDataFrame([(1, "abc", None, None, 1)], SCHEMA)).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs)
    asked = [r for r in got if r.held_out and docs[r.doc_id]]
    right = sum(r.lang_pred == docs[r.doc_id] for r in asked)
    assert len(asked) > 20 and right / len(asked) >= 0.95
