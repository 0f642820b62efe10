from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallybrook.llm import queries
from tallybrook.llm.alignment import Aligner, ByteTokenizer, coalesce, cross_tokenizer_alignment
from tallybrook.llm.bpe import byte_letters

A = public_tokenizers.path(queries.BYTE_TOKENIZER)
B = public_tokenizers.path(queries.PIECE_TOKENIZER)
NAMES = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes(library, text: str):
    """(id, bytes) of both sides, straight from the libraries."""
    tokenizer, model = library
    byte = {c: i for i, c in enumerate(byte_letters())}
    a = [
        (i, bytes(byte[c] for c in tokenizer.id_to_token(i)))
        for i in tokenizer.encode(" " + text, add_special_tokens=False).ids
    ]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        whole = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else None
        b.append((i, whole if whole is not None else piece.replace("▁", " ").encode()))
    return a, b


def brute(library, texts) -> list[tuple]:
    """The rows of all texts, one token after the other."""
    rows, all_links = [], Counter()
    for text in texts:
        a, b = token_bytes(library, text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append((0, 0, 0, [], ""))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for i, x in a:
            at += len(x)
            ends_a[at] = i
        at = 0
        for i, x in b:
            at += len(x)
            ends_b[at] = i
        cuts = sorted(ends_a.keys() & ends_b.keys())
        cut_set = set(cuts)
        links = [(ends_a[c], ends_b[c]) for c in cuts]
        all_links.update(links)
        sides = []
        for ends in (ends_a, ends_b):
            groups = [[]]
            for end, i in ends.items():
                groups[-1].append(str(i))
                if end in cut_set:
                    groups.append([])
            sides.append([",".join(g) for g in groups[:-1]])
        groups = ["|".join(both) for both in zip(*sides)]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        rows.append((len(a), len(b), len(cuts), links, digest))
    best: dict[int, int] = {}
    for (_, b), n in all_links.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (
            n_a,
            n_b,
            n,
            len(links),
            sum(all_links[link] == best[link[1]] for link in links),
            sum(all_links[link] for link in links),
            digest,
        )
        for n_a, n_b, n, links, digest in rows
    ]


TEXTS = [
    "Hello world, hello tokens.",
    "Hello world, hello tokens.",
    None,
    "",
    " ",
    "  two  spaces  ",
    "tab\tand\nlines\r\n\n end ",
    "naïve café – “quotes” … 日本語のテキスト 😀👩‍👩‍👧 Ⅳ ½ ﬁ",
    "a▁b",
    "<s> text </s> <|endoftext|> <unk> <0x41>",
    "\x00\x01 control \x7f",
    "x" * 20_000,
    "word " * 30_000,
    "ab" * 3_000 + " 12345678901234567890 It's they'll I'M",
    "ÀÉÎ é combining, İ ı ẞ",
]


@pytest.mark.parametrize("pairs", [10**6, 20, 0])
def test_rows_equal_brute_force(spark, library, pairs):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    docs = docs.selectExpr("*", "1 AS row", "2 AS links", "3 AS `a.b`", "4 AS pair").repartition(3)
    found = cross_tokenizer_alignment(docs, A, B, max(pairs, 1))
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in found.collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute(library, TEXTS)


def test_documents_of_the_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op12_alignment(spark, sf_dir).collect()
    want = dict(zip((d.doc_id for d in docs), brute(library, [d.text for d in docs])))
    assert {r.doc_id: tuple(r[n] for n in NAMES) for r in found} == want
    assert sum(r.n_links for r in found) > 10_000


def test_empty_table_and_null_ids(spark):
    assert cross_tokenizer_alignment(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (1, None)], SCHEMA)
    rows = cross_tokenizer_alignment(docs, A, B).collect()
    assert sorted((r.doc_id is None, r.n_links, r.count_sum) for r in rows) == [
        (False, 0, 0), (True, 2, 4), (True, 2, 4)
    ]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_byte_tokenizer_equals_its_library(text):
    if not hasattr(test_byte_tokenizer_equals_its_library, "both"):
        tokenizer = Tokenizer.from_file(A)
        tokenizer.encode_special_tokens = True
        test_byte_tokenizer_equals_its_library.both = (ByteTokenizer(A), tokenizer)
    own, tokenizer = test_byte_tokenizer_equals_its_library.both
    text = text.encode("utf-8", "ignore").decode()
    assert own.encode([text])[0] == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=40), st.randoms())
def test_overlaps_equal_all_pairs_compared(sizes, random):
    total, other = sum(sizes), []
    while sum(other) < total:
        other.append(random.randint(1, min(5, total - sum(other))))
    found = coalesce(np.array(sizes, dtype=np.int64), np.array(other, dtype=np.int64))

    def ranges(row):
        ends = np.cumsum(row).tolist()
        return list(zip([0, *ends], ends))

    a, b = ranges(sizes), ranges(other)
    pairs = [
        (i, j, x[1] == y[1])
        for i, x in enumerate(a)
        for j, y in enumerate(b)
        if x[0] < y[1] and y[0] < x[1]
    ]
    got = sorted(zip(found.a.tolist(), found.b.tolist(), found.together.tolist()))
    assert got == sorted(pairs)
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    assert [sum(c < e for c in cuts) for _, e in a] == found.group_a.tolist()
    assert [sum(c < e for c in cuts) for _, e in b] == found.group_b.tolist()


def test_a_text_that_one_side_does_not_spell_out_has_no_tokens():
    tool = Aligner(A, B)
    assert tool.align(["a▁b", "ab"])[0][:4] == (0, 0, 0, "")
