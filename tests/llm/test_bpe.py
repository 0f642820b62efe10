from __future__ import annotations

import random

import public_tokenizers
import pytest
import tokenizers

from tallybrook.llm import bpe
from tallybrook.llm.queries import TOKENIZER, op7_bpe

PATH = public_tokenizers.path(TOKENIZER)
LETTERS = "aAbB'sS tΣςİßéÉ̈́ÅÅ 12٣½\t\n\x1c\x85  !?.,<|>#$aaaa中文😀ǅŉﬁK"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def odd_texts():
    draw = random.Random(7)
    texts = ["".join(draw.choices(LETTERS, k=draw.randint(0, 60))) for _ in range(800)]
    marks = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|endoftext|", "x<|endoftext|>'s"]
    runs = ["a" * n for n in range(1, 40)] + ["ab" * 500, "", " ", "\n\t"]
    return texts + marks + runs


def test_ids_and_decoded_text_equal_the_library(encoder, library):
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids, counts = encoder.encode([text])
        assert ids.tolist() == want and counts.tolist() == [len(want)]
        decoded = bpe.decode_ids(encoder.vocabulary, want)
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_blocks_and_forgotten_words_change_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    texts = odd_texts()
    found = []
    for start, end in bpe._blocks(texts):
        ids, counts = encoder.encode(texts[start:end])
        ends = counts.cumsum().tolist()
        found += [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_long_text_is_encoded_whole(encoder, library):
    text = " ".join(f"word{i % 977} thing" for i in range(60_000))
    ids, counts = encoder.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, library):
    rows = [
        (1, "Hello, World", 5, [9]),
        (1, "Hello, World", 5, [9]),
        (None, "it's", 5, None),
        (2, None, 5, [9]),
        (3, "", 5, [9]),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, decoded int, ids array<int>")
    got = bpe.encode(docs, PATH, with_decoded=True).collect()
    assert len(got) == 5
    by_id = {r.doc_id: r for r in got}
    for doc_id, text in ((1, "Hello, World"), (None, "it's"), (2, ""), (3, "")):
        want = library.encode(text, add_special_tokens=False).ids
        assert by_id[doc_id].ids == want
        assert by_id[doc_id].decoded == library.decode(want, skip_special_tokens=False)
    decoded = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert {r.doc_id: r.decoded for r in decoded} == {r.doc_id: r.decoded for r in got}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(none, PATH, with_decoded=True).collect() == []


def test_query_over_the_table(spark, sf_dir, library):
    import hashlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in op7_bpe(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        row = got[doc.doc_id]
        joined = " ".join(map(str, ids))
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
