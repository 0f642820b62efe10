from __future__ import annotations

import random

import pytest

from tallybrook.llm import langid

SCHEMA = "doc_id bigint, text string, lang string"
WORDS = {"en": "the and of to in that is was".split(), "de": "der und die das ist nicht ein".split()}


def text_of(lang, words, seed=0):
    return " ".join(random.Random(f"{lang}{seed}").choices(WORDS[lang], k=words))


@pytest.fixture
def sampled(monkeypatch):
    """Labels and texts of the sample, as counted."""
    found = []
    counting = langid.count_contexts

    def seen(rows, *order):
        found.extend((r.lang, r.text) for r in rows.collect())
        return counting(rows, *order)

    monkeypatch.setattr(langid, "count_contexts", seen)
    return found


def test_language_of_long_texts_only_is_learned(spark, sampled):
    rows = [(i, text_of("en", 50, i), "en") for i in range(10)]
    rows += [(100 + i, text_of("de", 40_000, i), "de") for i in range(10)]
    rows += [(500, "und das ist die", None), (501, "that was the", None)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[500], got[501]) == ("de", "en")
    long = [t for lang, t in sampled if lang == "de"]
    assert 0 < sum(map(len, long)) < 2 * langid.SAMPLE_BYTES
    assert all(len(t.encode()) <= langid.SAMPLE_TEXT_BYTES for t in long)
    whole = [t for _, t, lang in rows if lang == "de"]
    assert all(any(piece in t for t in whole) for piece in long)


def test_all_labelled_texts_long(spark):
    rows = [(i, text_of("en", 20_000, i), "en") for i in range(4)]
    rows += [(100 + i, text_of("de", 20_000, i), "de") for i in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {(r.doc_id < 100, r.lang_pred) for r in langid.identify(docs).collect()} == {(True, "en"), (False, "de")}
    assert langid.recognized(docs, 0.5).count() == len(rows)


def test_null_ids_are_sampled_like_others(spark, sampled, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 20_000)
    rows = [(None, text_of("en", 30, i), "en") for i in range(2000)] + [(None, text_of("en", 30), "en")] * 2000
    langid.train(spark.createDataFrame(rows, SCHEMA.replace("doc_id", "_id")))
    assert 10_000 < sum(len(t) for _, t in sampled) < 40_000


def test_every_label_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 1)
    rows = [(i, text_of("en", 30, i), f"label{i % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "_id bigint, text string, lang string")
    assert len(langid.train(docs).langs) == 40
