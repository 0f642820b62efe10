from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallybrook.llm import winnowing
from tallybrook.llm.queries import op9_winnowing
from tests.conftest import plan_of

RUN = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    """Words of up to 16 code points; of longer runs the four code points from each one on."""
    tokens = []
    for run in RUN.findall(text or ""):
        tokens += [run] if len(run) <= 16 else [run[i : i + 4] for i in range(len(run))]
    return tokens


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def hash_of(words):
    seed = 42
    for word in words:
        seed = xxhash.xxh64_intdigest(word.encode(), seed)
    return signed(seed)


def print_of(text, gram=winnowing.GRAM, span=winnowing.SPAN):
    """Positions and hashes, window by window."""
    words = tokens_of(text)
    if not words:
        return [], []
    if len(words) < gram:
        hashes = [hash_of(words)]
    else:
        hashes = [hash_of(words[i : i + gram]) for i in range(len(words) - gram + 1)]
    kept = []
    for start in range(max(1, len(hashes) - span + 1)):
        window = range(start, min(start + span, len(hashes)))
        least = min(hashes[i] for i in window)
        place = max(i for i in window if hashes[i] == least)
        if place not in kept:
            kept.append(place)
    return kept, [hashes[i] for i in kept]


def likeness_of(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def edit_of(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def texts_of(n=120):
    draw = random.Random(4)
    texts = [None, "", " \n", "one", "a b c", "a b c d", "x " * 300, "é😀 " * 9, "中" * 3000]
    texts += [" ".join(draw.choices("abcde", k=draw.randint(1, 70))) for _ in range(n)]
    return texts + ["same words in both of them here"] * 3


def check(rows, docs):
    """All rows against brute force; docs are (doc_id, text) in ascending order."""
    assert len(rows) == len(docs)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for i, (doc_id, text) in enumerate(docs):
        text, following = text or "", docs[(i + 1) % len(docs)][1] or ""
        edited = edit_of(text, following)
        (r,) = [x for x in got[doc_id] if x.edited_text == edited and x.n_chars == len(text)]
        places, hashes = print_of(text)
        assert (r.fingerprint.positions, r.fingerprint.hashes) == (places, hashes)
        other = print_of(edited)
        assert (r.edited.positions, r.edited.hashes) == other
        assert r.near_edited == pytest.approx(likeness_of(hashes, other[1]))
        assert r.near_next == pytest.approx(likeness_of(hashes, print_of(following)[1]))


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_all_columns_equal_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 10)
    monkeypatch.setattr(winnowing, "MAX_RANGES", ranges)
    docs = [(i * 7 - 40, t) for i, t in enumerate(texts_of())]
    table = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id bigint, text string, edited string, n_chars int")
    check(winnowing.compare_with_edits(table.repartition(5)).collect(), docs)


def test_rightmost_of_equal_hashes_is_kept(spark):
    table = spark.createDataFrame([("a " * 30,)], "text string")
    row = table.select(winnowing.fingerprint(F.col("text")).alias("p")).first().p
    assert row.positions == list(range(3, 27)) and len(set(row.hashes)) == 1


def test_long_common_runs_always_share_a_hash(spark):
    draw = random.Random(8)
    run = winnowing.GRAM + winnowing.SPAN - 1
    rows = []
    for _ in range(150):
        common = [f"c{draw.random()}" for _ in range(run)]
        rows.append(
            tuple(
                " ".join([f"x{draw.random()}" for _ in range(draw.randint(0, 9))] + common + [f"y{draw.random()}" for _ in range(draw.randint(0, 9))])
                for _ in range(2)
            )
        )
    table = spark.createDataFrame(rows, "a string, b string")
    prints = [winnowing.fingerprint(F.col(c))["hashes"] for c in "ab"]
    assert all(r[0] for r in table.select(F.arrays_overlap(*prints)).collect())


@pytest.mark.parametrize("alphabet", ["的一是不了人我在有他这中大来上国", "abcdefghijklmnop", "😀😁😂é中ñ"])
def test_shifted_passages_without_spaces_are_found(spark, alphabet):
    draw = random.Random(11)
    run = "".join(draw.choices(alphabet, k=2000))
    others = ["".join(draw.choices(alphabet, k=shift)) + run for shift in (1, 3, 4, 8, 15, 16)]
    rows = [(run, other) for other in others]
    rows += [(run, other + " " + "word " * 3) for other in others]
    table = spark.createDataFrame(rows, "a string, b string")
    prints = [winnowing.fingerprint(F.col(c))["hashes"] for c in "ab"]
    got = [r[0] for r in table.select(winnowing.likeness(*prints)).collect()]
    assert min(got) > 0.9


def test_words_and_runs_meet_at_sixteen_code_points(spark):
    texts = ["a" * 16 + " b", "a" * 17 + " b", "é😀" * 8, "é😀" * 9 + " c d", "x" * 40 + "\n" + "y" * 15]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = table.select("text", F.regexp_extract_all("text", F.lit(winnowing.TOKEN), F.lit(1)).alias("t"))
    assert all(r.t == tokens_of(r.text) for r in rows.collect())


def test_one_document_and_none(spark):
    schema = "doc_id bigint, text string"
    row = winnowing.compare_with_edits(spark.createDataFrame([(5, "a b c d e f")], schema)).first()
    assert row.edited_text == edit_of("a b c d e f", "a b c d e f") and row.near_next == 1.0
    assert winnowing.compare_with_edits(spark.createDataFrame([], schema)).collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "c d"), (None, "e f g h i")]
    got = winnowing.compare_with_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    edits = sorted((str(r.doc_id), r.edited_text) for r in got)
    assert edits == [("1", "a " + "a"), ("1", "a " + "c"), ("2", "c " + "e"), ("None", "e f g" + "a b")]


def test_query_over_the_table(spark, sf_dir):
    frame = op9_winnowing(spark, sf_dir)
    assert "Python" not in plan_of(frame) and "Arrow" not in plan_of(frame)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got) == len(docs)
    prints = {}
    for i, (doc_id, text) in enumerate(docs):
        row, following = got[doc_id], docs[(i + 1) % len(docs)][1]
        edited = edit_of(text, following)
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = print_of(text)[1]
        assert row.near_edited == pytest.approx(likeness_of(own, print_of(edited)[1]))
        assert row.near_next == pytest.approx(likeness_of(own, print_of(following)[1]))
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
    assert len(set(prints.values())) == len({str(print_of(t)) for t in prints})
