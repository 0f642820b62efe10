from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from tallybrook.llm import langid, mixing, quality, queries, simhash

NAMES = ["language", "quality", "near-duplicates", "mix", "tokens"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage gets and returns, stored as the pipeline stores it."""
    from tallybrook.llm.common import stored, table

    docs = table(spark, sf_dir, "documents").persist()
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf_dir), f"test-{name}")
        found[name] = (docs, out)
        docs = out
    return found


def ids(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    for name in NAMES[:-1]:
        docs, out = stages[name]
        assert out.schema.names == docs.schema.names
        assert 0 < out.count()


def test_each_stage_follows_its_operator(stages):
    docs, out = stages["language"]
    judged = langid.identify(docs)
    assert ids(out) == ids(judged.where("lang_pred <> 'und' AND score >= 0.5"))
    docs, out = stages["quality"]
    assert ids(out) == ids(quality.quality(docs).where("kept"))
    assert out.count() < docs.count()
    docs, out = stages["near-duplicates"]
    found = simhash.near_duplicates(docs)
    assert ids(out) == Counter({r[0]: 1 for r in found.select("component_id").distinct().collect()})
    assert out.count() < docs.count()
    docs, out = stages["mix"]
    taken = Counter({r.doc_id: len(r.drawn) for r in mixing.mix(docs).collect()})
    assert ids(out) == +taken and set(taken.values()) == {0, 1, 2}


def test_tokens_of_every_copy(stages):
    docs, out = stages["tokens"]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = Counter()
    for r in docs.collect():
        numbers = library.encode(r.text, add_special_tokens=False).ids
        joined = " ".join(map(str, numbers))
        want[r.doc_id, len(numbers), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out.collect()) == want


def test_texts_stay_as_they_were(stages, spark, sf_dir):
    first = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in stages["mix"][1].collect():
        assert r == first[r.doc_id]


def test_run_is_the_stages_one_after_the_other(stages, spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages["tokens"][1].collect()))


def test_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []
