"""Prefix trie of conversations: a double-array trie per prefix shard, shared nodes merged globally."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import map_arrow, stored

#: Every conversation whose id is DONOR * n + r starts with up to MOST_HEAD turns of DONOR * n.
DONOR = 20
MOST_HEAD = 3

#: A prefix with more turns below it is cut further down, so that no shard outgrows a task.
SHARD_TURNS = 200_000
#: Prefixes with fewer turns are never cut further down.
LEAST_TURNS = 2_000
#: Turns of one task, which holds many shards and one double array.
TASK_TURNS = 500_000
#: Upper nodes that may be broadcast to the tops of shards; more are joined by a shuffle.
BROADCAST_NODES = 500_000
#: Bytes of joined ids that are hashed or sent as one row.
CHUNK_BYTES = 1 << 16

DIGEST = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

INSIDE, TOP, UPPER = 0, 1, 2
NODES = (
    "kind tinyint, node binary, parent binary, above array<binary>, depth bigint, conv_id bigint,"
    " parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint,"
    " n_words bigint, ends string"
)
_ARROW = pa.schema(
    [
        ("kind", pa.int8()),
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("above", pa.list_(pa.binary())),
        ("depth", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved", pa.int64()),
        ("n_words", pa.int64()),
        ("ends", pa.string()),
    ]
)


class DoubleArray:
    """A trie packed into two arrays: the child of state s by code c is t = BASE[s] + c, if
    CHECK[t] is s. Codes are dense and numbered so that siblings lie close together."""

    ROOT = 0

    def __init__(self, turns: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """`turns` are dense turn ids of all sequences on end; a sequence has `lengths` of them."""
        n = int(turns.max()) + 1 if len(turns) else 0
        self.code = np.full(n, -1, dtype=np.int64)
        self.base = np.zeros(len(turns) + 2, dtype=np.int64)
        self.check = np.full(len(turns) + 2, -1, dtype=np.int64)
        self.top, self.codes = 1, 0
        self.holes = np.zeros(0, dtype=np.int64)
        state = np.zeros(len(lengths), dtype=np.int64)
        active = np.flatnonzero(lengths > 0)
        depth = 0
        while len(active):
            turn = turns[starts[active] + depth]
            pair, back = np.unique(state[active] * n + turn, return_inverse=True)
            slots = self._place(pair // n, pair % n)
            state[active] = slots[back]
            depth += 1
            active = active[lengths[active] > depth]

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, dtype=np.int64))
            self.check = np.append(self.check, np.full(more, -1, dtype=np.int64))

    def _place(self, parents: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Slots for the children (parent, turn), which are distinct and sorted by parent."""
        fresh = turns[self.code[turns] < 0]
        if len(fresh):
            first = np.sort(np.unique(fresh, return_index=True)[1])
            self.code[fresh[first]] = self.codes + np.arange(len(first))
            self.codes += len(first)
        codes = self.code[turns]
        starts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        sizes = np.diff(np.append(starts, len(parents)))
        slots = np.empty(len(parents), dtype=np.int64)
        several = np.flatnonzero(sizes > 1)
        for i in several[np.argsort(-sizes[several], kind="stable")].tolist():
            own = slice(starts[i], starts[i] + sizes[i])
            base = self._fit(np.sort(codes[own]))
            slots[own] = base + codes[own]
            self._take(parents[own], codes[own], slots[own])
        if len(several):
            self.holes = 1 + np.flatnonzero(self.check[1 : self.top] < 0)
        single = starts[sizes == 1]
        filled = self.holes[: len(single)]
        self.holes = self.holes[len(single) :]
        rest = np.arange(self.top, self.top + len(single) - len(filled))
        slots[single] = np.append(filled, rest)
        self._take(parents[single], codes[single], slots[single])
        return slots

    def _fit(self, codes: np.ndarray) -> int:
        """The lowest base that puts a node's children into free slots."""
        offsets = codes - codes[0]
        free = self.holes[: max(1, (1 << 22) // len(codes))]
        free = free[self.check[free] < 0]
        at = free[:, None] + offsets
        inside = np.minimum(at, len(self.check) - 1)
        fits = ((at >= len(self.check)) | (self.check[inside] < 0)).all(axis=1)
        first = int(free[fits.argmax()]) if fits.any() else self.top
        return first - int(codes[0])

    def _take(self, parents: np.ndarray, codes: np.ndarray, slots: np.ndarray) -> None:
        if len(slots):
            self._grow(int(slots.max()) + 1)
            self.top = max(self.top, int(slots.max()) + 1)
            self.check[slots] = parents
            self.base[parents] = slots - codes

    def walk(self, turns: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The state after each turn of each sequence, -1 where the trie has none."""
        found = np.full(len(turns), -1, dtype=np.int64)
        state = np.zeros(len(lengths), dtype=np.int64)
        active = np.flatnonzero(lengths > 0)
        depth = 0
        while len(active):
            at = starts[active] + depth
            known = turns[at] < len(self.code)
            code = np.where(known, self.code[np.where(known, turns[at], 0)], -1)
            to = self.base[state[active]] + code
            inside = (to > 0) & (to < len(self.check)) & (code >= 0)
            ok = inside & (self.check[np.where(inside, to, 0)] == state[active])
            active, at, to = active[ok], at[ok], to[ok]
            found[at] = state[active] = to
            depth += 1
            active = active[lengths[active] > depth]
        return found


def _dense(data: bytes) -> np.ndarray:
    """Digests on end, numbered from 0."""
    pairs = np.frombuffer(data, dtype=np.uint64).reshape(-1, 2)
    order = np.lexsort((pairs[:, 0], pairs[:, 1]))
    new = np.append(True, (pairs[order][1:] != pairs[order][:-1]).any(axis=1))
    ids = np.empty(len(pairs), dtype=np.int64)
    ids[order] = np.cumsum(new[: len(pairs)]) - 1
    return ids


def _trie_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node of the trie over the paths of one task."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    blobs = table.column("turns").to_pylist()
    n_convs = table.column("n_convs").to_numpy().astype(np.int64)
    conv = table.column("conv_id").to_numpy().astype(np.int64)
    cut = table.column("cut").to_numpy().astype(np.int64)
    words = pa.chunked_array(table.column("words")).combine_chunks().flatten()
    words = words.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.array([len(b) // DIGEST for b in blobs], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    turns = _dense(b"".join(blobs))
    trie = DoubleArray(turns, starts, lengths)
    at = trie.walk(turns, starts, lengths)

    size = trie.top
    path = np.repeat(np.arange(len(blobs)), lengths)
    depth_at = np.arange(len(turns)) - starts[path] + 1
    count, total = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    np.add.at(count, at, n_convs[path])
    count[0] = n_convs.sum()
    least = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(least, at, conv[path])
    least[0] = conv.min()
    depth, own_words = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    depth[at], own_words[at] = depth_at, words
    node_cut, one_path = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    node_cut[at], one_path[at] = cut[path], path
    node_cut[0] = 1
    ends = np.full(size, -1, dtype=np.int64)
    final = np.where(lengths > 0, at[np.maximum(starts + lengths - 1, 0)] if len(at) else 0, 0)
    ends[final] = np.arange(len(blobs))

    nodes = np.append(0, np.unique(at))
    parent = trie.check
    children = np.bincount(parent[nodes[1:]], minlength=size)
    shared = depth < node_cut
    leaves = np.where(shared, 0, children[:size] == 0).astype(np.int64)
    total = np.where(shared, 0, (count - 1) * own_words)
    by_depth = nodes[np.argsort(-depth[nodes], kind="stable")]
    levels = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in np.split(by_depth, levels):
        if depth[level[0]]:
            np.add.at(leaves, parent[level], leaves[level])
            np.add.at(total, parent[level], total[level])

    digests = table.column("ends").to_pylist()
    for lo in range(0, len(nodes), 1 << 16):
        own = nodes[lo : lo + (1 << 16)]
        kind = np.where(shared[own], UPPER, np.where(depth[own] == node_cut[own], TOP, INSIDE))
        keys: list = [None] * len(own)
        above: list = [None] * len(own)
        parents: list = [None] * len(own)
        for i in np.flatnonzero(kind != INSIDE).tolist():
            d, blob = int(depth[own[i]]), blobs[one_path[own[i]]]
            if d:
                parents[i] = prefix_key(blob, d - 1)
            if kind[i] == UPPER:
                keys[i] = prefix_key(blob, d)
                above[i] = [prefix_key(blob, k) for k in range(d)]
        up = np.maximum(parent[own], 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kind.astype(np.int8)),
                pa.array(keys, type=pa.binary()),
                pa.array(parents, type=pa.binary()),
                pa.array(above, type=pa.list_(pa.binary())),
                pa.array(depth[own]),
                pa.array(least[own]),
                pa.array(least[up], mask=kind != INSIDE),
                pa.array(count[own]),
                pa.array(children[own].astype(np.int64)),
                pa.array(leaves[own]),
                pa.array(total[own]),
                pa.array(own_words[own]),
                pa.array([digests[e] if e >= 0 else NO_ENDS for e in ends[own].tolist()]),
            ],
            schema=_ARROW,
        )


def prefix_key(blob: bytes, depth: int) -> bytes:
    """The key of the node that a sequence reaches after `depth` turns."""
    return hashlib.md5(blob[: DIGEST * depth] + b"%d" % depth, usedforsecurity=False).digest()


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (path, conv_id) as rows (path, least, ids): ids joined by commas, in pieces."""
    arrow = pa.schema([("path", pa.string()), ("least", pa.int64()), ("ids", pa.string())])
    path, least, ids, size = None, 0, [], 0
    done: list[tuple] = []
    for batch in batches:
        for key, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
            if key != path or size >= CHUNK_BYTES:
                if ids:
                    done.append((path, least, ",".join(ids)))
                path, least, ids, size = key, conv, [], 0
                if len(done) >= 1024:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done))), schema=arrow)
                    done = []
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        done.append((path, least, ",".join(ids)))
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done))), schema=arrow)


def _chunk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (path, least, ids) as rows (path, ends): the digest of all ids of a path."""
    path, digest, done = None, None, []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done))), names=["path", "ends"])

    for batch in batches:
        for key, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist()):
            if key != path:
                if path is not None:
                    done.append((path, digest.hexdigest()))
                path, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(done) >= 4096:
            yield rows()
            done = []
    if path is not None:
        done.append((path, digest.hexdigest()))
        yield rows()


def end_digests(rebuilt: DataFrame) -> DataFrame:
    """path and ends, the SHA-256 of the ids of all conversations equal to the path.

    Ids are sorted and joined in ranges, so that of a path that a third of all conversations
    share, one task only hashes pieces that others have joined, one after the other.
    """
    ids = rebuilt.select("path", "conv_id").repartitionByRange("path", "conv_id")
    joined = map_arrow(
        ids.sortWithinPartitions("path", "conv_id"),
        _id_chunks,
        "path string, least bigint, ids string",
    )
    dealt = joined.repartition("path").sortWithinPartitions("path", "least")
    return map_arrow(dealt, _chunk_digests, "path string, ends string")


def turn_digest(role: Column, text: Column) -> Column:
    """The MD5 of a turn as hex digits; the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, digests and words: the turns of each conversation in order.

    Order is by turn, null first, then by digest. Rows without a conv_id belong to no
    conversation. Texts are read here only; a turn is 16 bytes and a number from here on.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            turn_digest(F.col("role"), F.col("text")).alias("digest"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
        ).alias("t"),
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select(
        "conv_id", F.col("t.digest").alias("digests"), F.col("t.words").alias("words")
    )


def rebuilt_sequences(own: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the conversation of its twenty."""
    heads = own.where(F.col("conv_id") % DONOR == 0).select(
        F.col("conv_id").alias("_donor"),
        F.slice("digests", 1, MOST_HEAD).alias("_digests"),
        F.slice("words", 1, MOST_HEAD).alias("_words"),
    )
    n = (F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)).cast("int")
    joined = own.withColumn("_n", n).join(
        heads, F.col("conv_id") - F.col("conv_id") % DONOR == F.col("_donor"), "left"
    )

    def built(name: str, kind: str) -> Column:
        head = F.coalesce(F.col(f"_{name}"), F.array().cast(kind))
        rest = F.slice(name, F.col("_n") + 1, F.greatest(F.size(name), F.lit(1)))
        return F.concat(F.slice(head, F.lit(1), F.col("_n")), rest)

    return joined.select(
        "conv_id",
        F.unhex(F.array_join(built("digests", "array<string>"), "")).alias("turns"),
        built("words", "array<bigint>").alias("words"),
    ).withColumn("path", F.md5("turns"))


def _prefix(depth) -> Column:
    return F.substring("turns", F.lit(1), F.lit(DIGEST) * depth)


def with_cuts(paths: DataFrame, most: int) -> DataFrame:
    """Add `cut`: the depth at which a path's shard starts.

    Shards start at depth 1. A prefix with over `most` turns below it is hot, and its paths are
    cut at twice the depth. Distinct paths part somewhere, so this ends.
    """
    paths = paths.withColumn("cut", F.lit(1).cast("bigint"))
    depth = 1
    while True:
        sizes = paths.where(F.col("cut") == depth).groupBy(_prefix(F.lit(depth)).alias("_hot"))
        hot = sizes.agg(
            F.sum(F.octet_length("turns") / DIGEST).alias("n"), F.count(F.lit(1)).alias("m")
        )
        hot = stored(hot.where((F.col("n") > most) & (F.col("m") > 1)).select("_hot"), "trie-hot")
        if hot.isEmpty():
            return paths
        cut = F.when(F.col("_hot").isNotNull(), F.lit(2 * depth)).otherwise(F.col("cut"))
        paths = paths.join(hot, _prefix(F.lit(depth)) == F.col("_hot"), "left")
        paths = paths.withColumn("cut", cut.cast("bigint")).drop("_hot")
        depth *= 2


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie of all rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered by turn (null first, equal turns by the MD5 of role and text) and
    rebuilt; a null role or text is empty, a row without conv_id belongs to no conversation, other
    columns are ignored and an empty table gives no rows, not even a root. Equal conversations are
    one path with a count before any trie is built. Paths are dealt by a prefix that is longer
    below hot prefixes; each task packs its paths into a double array and traverses it. Nodes
    above a shard's cut may stand in several shards: their sums are merged globally.
    """
    own = stored(sequences(conversations), "trie-own")
    rebuilt = stored(rebuilt_sequences(own), "trie-rebuilt")
    paths = rebuilt.groupBy("path").agg(
        F.first("turns").alias("turns"),
        F.first("words").alias("words"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
    )
    paths = stored(paths.join(end_digests(rebuilt), "path").drop("path"), "trie-paths")
    total = paths.agg(F.sum(F.octet_length("turns") / DIGEST)).first()[0] or 0
    least = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, int(total) // TASK_TURNS + 1)
    # a quarter of a task's share at most, so that one hot prefix fills no task by itself
    most = min(shard_turns, max(LEAST_TURNS, int(total) // (4 * tasks)))
    dealt = with_cuts(paths, most).repartition(tasks, _prefix(F.col("cut")))
    nodes = stored(map_arrow(dealt, _trie_rows, NODES), "trie-nodes")
    uppers = stored(_merged_uppers(nodes), "trie-uppers")
    names = uppers.select(F.col("node").alias("parent"), F.col("conv_id").alias("_conv"))
    if uppers.count() <= BROADCAST_NODES:
        names = F.broadcast(names)
    inside = nodes.where(F.col("kind") == INSIDE)
    tops = nodes.where(F.col("kind") == TOP).join(names, "parent", "left")
    outer = uppers.join(names, "parent", "left")
    found = inside.unionByName(
        tops.withColumn("parent_conv_id", F.col("_conv")).select(inside.columns)
    ).unionByName(
        outer.withColumn("parent_conv_id", F.col("_conv")).drop("_conv"), allowMissingColumns=True
    )
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def _merged_uppers(nodes: DataFrame) -> DataFrame:
    """Each node above the shards once, its sums taken over all shards."""
    parts = nodes.where(F.col("kind") == UPPER)
    merged = parts.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("above").alias("above"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"),
        F.first("n_words").alias("n_words"),
        F.max(F.when(F.col("ends") != NO_ENDS, F.col("ends"))).alias("ends"),
    )
    merged = stored(merged, "trie-merged")
    below = nodes.where(F.col("kind") == TOP).select("parent")
    below = below.unionByName(merged.where("parent IS NOT NULL").select("parent"))
    children = below.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = merged.join(children, "node", "left").fillna({"n_children": 0})
    counted = counted.withColumn("_leaf", (F.col("n_children") == 0).cast("bigint")).withColumn(
        "_saved", (F.col("n_convs") - 1) * F.col("n_words")
    )
    sums = (
        counted.select(
            F.explode(F.concat("above", F.array("node"))).alias("node"), "_leaf", "_saved"
        )
        .groupBy("node")
        .agg(F.sum("_leaf").alias("_leaves"), F.sum("_saved").alias("_all"))
    )
    return counted.join(sums, "node").select(
        "node",
        "parent",
        "depth",
        "conv_id",
        "n_convs",
        "n_children",
        (F.col("n_leaves") + F.col("_leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("_all")).alias("saved"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"),
    )
