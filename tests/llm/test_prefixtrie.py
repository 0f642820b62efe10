from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tallybrook.llm import oracles, prefixtrie, queries
from tallybrook.llm.prefixtrie import DoubleArray, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = (
    "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
)


def brute(rows) -> set[tuple]:
    """All nodes of (conv_id, turn, role, text) rows by plain dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), key, (role, text)))
    turns = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = (*turns.get(c - int(math.fmod(c, 20)), [])[:h], *t[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        value = (len(convs) - 1) * len(node[-1][1].split()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += value
            leaves[node[:d]] += not children[node]
    return {
        (
            min(convs),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(convs),
            children[node],
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, convs in members.items()
    }


def found(frame) -> list[tuple]:
    return [tuple(r) for r in frame.select(*NAMES).collect()]


ROWS = [
    (0, 0, "user", "a b c"),
    (0, 1, "bot", "d e"),
    (0, 2, "user", "f"),
    (0, 3, "bot", "g h i j"),
    *[(c, t, "user", f"x{t} y") for c in range(1, 60) for t in range(c % 6)],
    *[(c, t, "system", "same turn here") for c in range(100, 160) for t in range(1 + c % 9)],
    (200, None, None, None),
    (200, 1, "user", ""),
    (200, 1, "", "user"),
    (200, 1, "user", "tie"),
    (201, 5, "user", "long " * 20_000),
    (-7, 0, "user", "below zero"),
    (-20, 0, "user", "a donor below zero"),
    (None, 0, "user", "nobody's"),
    (300, 1, "user", "twice"),
    (300, 1, "user", "twice"),
]


@pytest.mark.parametrize("limit", [prefixtrie.SHARD_TURNS, 40, 2])
def test_all_nodes_however_the_paths_are_cut(spark, limit, monkeypatch):
    monkeypatch.setattr(prefixtrie, "LEAST_TURNS", 1)
    rows = found(prefix_trie(spark.createDataFrame(ROWS, SCHEMA), limit))
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(ROWS)


def test_a_hot_start_and_many_equal_conversations(spark):
    rows = [
        (c, t, "user", "hello" if t < 3 else f"{c % 7 if c % 3 else c} {t}")
        for c in range(0, 4000)
        for t in range(6)
    ]
    got = found(prefix_trie(spark.createDataFrame(rows, SCHEMA), 500))
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_ids_of_one_path_are_hashed_in_pieces(spark, monkeypatch):
    rebuilt = spark.range(50_000).selectExpr("'p' AS path", "id - 25000 AS conv_id")
    digest = hashlib.sha256(",".join(str(i - 25000) for i in range(50_000)).encode()).hexdigest()
    assert [tuple(r) for r in prefixtrie.end_digests(rebuilt).collect()] == [("p", digest)]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(prefix_trie(empty)) == []
    rows = spark.createDataFrame(ROWS, SCHEMA)
    more = rows.selectExpr(
        "*", "1 AS path", "'x' AS turns", "2 AS words", "3 AS cut", "4 AS `a.b`", "5 AS digests"
    )
    assert set(found(prefix_trie(more))) == brute(ROWS)


def test_only_conversations_without_turns_of_their_own(spark):
    # 3 has CRC-32 % 4 turns replaced by those of 0, which is absent
    rows = [(c, 0, "user", "one turn") for c in range(1, 20)]
    assert set(found(prefix_trie(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_sql_gives_the_same_rows(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    expected = con.sql(oracles.PREFIX_TRIE).select(", ".join(NAMES)).fetchall()
    got = found(queries.op11_prefix_trie(spark, sf_dir))
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_double_array_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(1)
    paths = {tuple(rng.integers(0, 9, rng.integers(0, 7)).tolist()) for _ in range(2000)}
    paths = sorted(paths)
    lengths = np.array([len(p) for p in paths])
    turns = np.array([t for p in paths for t in p])
    trie = DoubleArray(turns, np.cumsum(lengths) - lengths, lengths)
    prefixes = {p[:d] for p in paths for d in range(1, len(p) + 1)}
    assert (trie.check[1 : trie.top] >= 0).sum() == len(prefixes)
    asked = [tuple(rng.integers(0, 11, rng.integers(1, 8)).tolist()) for _ in range(3000)] + paths
    sizes = np.array([len(p) for p in asked])
    starts = np.cumsum(sizes) - sizes
    states = trie.walk(np.array([t for p in asked for t in p]), starts, sizes)
    seen = {}
    for p, s, n in zip(asked, starts, sizes):
        for d in range(n):
            state = states[s + d]
            assert (state >= 0) == (p[: d + 1] in prefixes)
            if state >= 0:
                assert seen.setdefault(state, p[: d + 1]) == p[: d + 1]
