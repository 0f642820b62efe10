from __future__ import annotations

import random

import xxhash

from tallybrook.llm import simhash
from tallybrook.llm.queries import op3_simhash

MASK = (1 << 64) - 1


def fingerprint_of(text):
    """Bit by bit over Python numbers."""
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def components_of(prints, ids):
    """Smallest reachable id by comparing all pairs."""
    reach = list(range(len(prints)))

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                reach[root(i)] = root(j)
    least = {}
    for i, doc_id in enumerate(ids):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [least[root(i)] for i in range(len(prints))]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def chains(seed, starts=12, steps=25):
    """Fingerprints in chains and clouds of up to three flipped bits, and some far ones."""
    draw = random.Random(seed)
    prints = [0, MASK, 7, 15]
    for _ in range(starts):
        at = draw.getrandbits(64)
        for _ in range(steps):
            prints.append(at)
            for bit in draw.sample(range(64), draw.choice([0, 1, 2, 3, 3, 4])):
                at ^= 1 << bit
    return list(dict.fromkeys(prints))


def connected(spark, prints, most=simhash.BUCKET_PAIRS):
    nodes = spark.createDataFrame(
        [(signed(p), i) for i, p in enumerate(prints)], "fp bigint, doc_id bigint"
    )
    found = simhash._components(nodes, most).collect()
    by_print = {r.fp & MASK: r.component_id for r in found}
    return [by_print[p] for p in prints]


def test_fingerprints_of_single_texts():
    texts = ["", None, " \n", "one", "one two", "A b C d", "ä Ö a\x0bb", "x y z " * 50, "w" * 5000]
    for text in texts:
        assert simhash.fingerprint(text) == fingerprint_of(text)


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(str(i * i % 101) for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 7)
    assert simhash.fingerprint(text) == whole == fingerprint_of(text)


def test_components_equal_all_pairs(spark):
    prints = chains(3)
    assert connected(spark, prints) == components_of(prints, range(len(prints)))


def test_crowded_buckets_go_the_exact_way(spark, monkeypatch):
    used = []
    whole = simhash._full_balls
    monkeypatch.setattr(simhash, "_full_balls", lambda p: used.append(p.count()) or whole(p))
    prints = chains(5, starts=6)
    assert connected(spark, prints, most=2) == components_of(prints, range(len(prints)))
    assert used and used[0] > 10


def test_rows_with_nulls_copies_and_clashing_names(spark):
    rows = [
        (5, "a b c d e", 1, 1),
        (3, "a b c d e", 1, 1),
        (3, "a b c d e", 2, 1),
        (None, "a b c d e", 3, 1),
        (9, None, 4, 1),
        (8, "", 4, 1),
        (7, "quite another text of words", 4, 1),
        (None, "something that no other row says", 4, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, component_id int")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted(
        [("5", "3"), ("3", "3"), ("3", "3"), ("None", "3"), ("9", "8"), ("8", "8"), ("7", "7"), ("None", "None")]
    )
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "None"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.one_of_each(none).collect() == []


def test_query_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    prints = [fingerprint_of(d.text) for d in docs]
    ids = [d.doc_id for d in docs]
    want = dict(zip(ids, zip((f"{p:016x}" for p in prints), components_of(prints, ids))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash(spark, sf_dir).collect()}
    assert got == want
