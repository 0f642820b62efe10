"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.llm.common import map_arrow, renamed, restored, slices, stored
from tallybrook.llm.components import smallest_reachable

SHINGLE = 3
SEED = 42
RADIUS = 3

#: One of the three blocks of bits is left out of a key. Three differing bits put at least one
#: into some block, so without that block at most two are left, one from either side.
BLOCKS = ((0, 21), (21, 42), (42, 64))

#: Rows of one partition of variants: they are sorted in memory.
PARTITION_ROWS = 1_000_000

#: Fingerprints of one bucket whose pairs are compared one by one; larger buckets go another way.
BUCKET_PAIRS = 512

#: Shingles hashed before their bits are added up.
BLOCK_SHINGLES = 1 << 16

EDGES = "a bigint, b bigint"


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (np.append(0, ends[:-1] + 1)).tolist()
    ends = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), len(ends)
    for lo in range(0, n, BLOCK_SHINGLES):
        hi = min(n, lo + BLOCK_SHINGLES)
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[lo:hi], ends[lo:hi])]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64), type=pa.int64())


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def with_fingerprint(rows: DataFrame, text: str, keep_text: bool = True) -> DataFrame:
    """The rows plus `fp`, the fingerprint of the column `text` as a signed number.

    Letters A to Z are lowered; words are runs without white space; a text of fewer words than
    a shingle counts as one shingle. Null and empty texts have fingerprint 0.
    """
    kept = [c for c in rows.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(t) for t in batch.column(text).to_pylist()]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, _signed(prints)], [*kept, "fp"])

    fields = [rows.schema[c] for c in kept]
    return map_arrow(rows, run, T.StructType([*fields, T.StructField("fp", T.LongType())]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row of (doc_id, text)."""
    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    return with_fingerprint(rows, "text", keep_text=False)


def _variants(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Variants within one flipped bit, and whose they are, with one block after another cleared."""
    for lo, hi in BLOCKS:
        kept = np.uint64((1 << 64) - 1 - ((1 << hi) - (1 << lo)))
        bits = np.array([0] + [1 << i for i in range(64) if not lo <= i < hi], dtype=np.uint64)
        yield ((prints & kept)[:, None] ^ bits).ravel(), np.repeat(prints, len(bits))


def ball_variants(distinct: DataFrame) -> DataFrame:
    """Rows (key, block, fp): every variant of every fingerprint within half the radius."""
    arrow = pa.schema([("key", pa.int64()), ("block", pa.int8()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                prints = _unsigned(batch.column("fp").slice(lo, 4096))
                for number, (keys, owners) in enumerate(_variants(prints)):
                    block = pa.array(np.full(len(keys), number, dtype=np.int8))
                    columns = [_signed(keys), block, _signed(owners)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return map_arrow(distinct.select("fp"), run, "key bigint, block tinyint, fp bigint")


def _links_within(members: np.ndarray) -> np.ndarray:
    """Pairs (a, b) of a spanning forest of the links among a bucket's fingerprints."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= RADIUS
    left = np.arange(len(members))
    edges = []
    while len(left):
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            touch = near[np.ix_(wave, left)]
            hit = touch.any(axis=0)
            edges.append(np.stack([members[wave[touch.argmax(axis=0)[hit]]], members[left[hit]]]))
            wave, left = left[hit], left[~hit]
    return np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), dtype=np.uint64)


def _bucket_links(most: int):
    """Finds links inside the buckets of one partition; a = b marks a member of a bucket of more
    than `most`."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("key"), b.column("block"), b.column("fp")) for b in batches]
        if not parts:
            return
        key, block, fp = (pa.concat_arrays(list(c)).to_numpy() for c in zip(*parts))
        del parts
        order = np.lexsort((fp, key, block))
        key, block, fp = key[order], block[order], fp[order].view(np.uint64)
        starts = np.flatnonzero(
            np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1]))
        )
        sizes = np.diff(np.append(starts, len(key)))
        pair = starts[sizes == 2]
        a, b = fp[pair], fp[pair + 1]
        near = np.bitwise_count(a ^ b) <= RADIUS
        found = [np.stack([a[near], b[near]])]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            members = fp[start : start + size]
            found.append(_links_within(members) if size <= most else np.stack([members, members]))
        links = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([_signed(links[0]), _signed(links[1])], schema=arrow)

    return run


def _full_balls(prints: DataFrame) -> DataFrame:
    """Links among fingerprints of large buckets, in proportion to their number.

    Each emits all its variants within one flipped bit and, marked as far, within two. Any near
    and any far owner of one variant differ in three bits at most, and any two fingerprints so
    close share a variant that is near to one and far from the other; so all owners of a
    variant with a near one are linked through the smallest of these, and no pair is compared.
    """
    arrow = pa.schema([("key", pa.int64()), ("far", pa.int8()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        upper = np.triu_indices(64, 1)
        flips = np.concatenate([[np.uint64(0)], bits, bits[upper[0]] | bits[upper[1]]])
        far = np.repeat(np.array([0, 1], dtype=np.int8), [65, len(flips) - 65])
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                owners = _unsigned(batch.column("fp").slice(lo, 64))
                keys = (owners[:, None] ^ flips).ravel()
                columns = [
                    _signed(keys),
                    pa.array(np.tile(far, len(owners))),
                    _signed(np.repeat(owners, len(flips))),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    balls = map_arrow(prints, run, "key bigint, far tinyint, fp bigint")
    hubs = balls.where("far = 0").groupBy("key").agg(F.min("fp").alias("a"))
    return balls.join(hubs, "key").select("a", F.col("fp").alias("b")).where("a != b").distinct()


def links(distinct: DataFrame, count: int, most: int = BUCKET_PAIRS) -> DataFrame:
    """Links a, b that connect all of `count` distinct fingerprints within RADIUS bits.

    Buckets of up to `most` fingerprints are compared; members of larger ones are linked over
    all their variants. Not every link is returned, but two fingerprints are connected through the returned ones
    exactly if they are connected through all.
    """
    spark = distinct.sparkSession
    per_print = sum(65 - (hi - lo) for lo, hi in BLOCKS)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, -(-count * per_print // PARTITION_ROWS))
    variants = ball_variants(distinct).repartition(partitions, "key", "block")
    found = stored(map_arrow(variants, _bucket_links(most), EDGES), "simhash-links")
    close = found.where("a != b").distinct()
    crowded = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return close
    return close.union(_full_balls(stored(crowded, "simhash-crowded")))


def _components(printed: DataFrame, most: int = BUCKET_PAIRS) -> DataFrame:
    """fp, root and component_id of the distinct fingerprints among rows (doc_id, fp)."""
    nodes = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-nodes")
    return smallest_reachable(links(nodes, nodes.count(), most), nodes, "fp", "doc_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for every row of (doc_id, text).

    Rows whose fingerprints differ in RADIUS bits or fewer are linked; component_id is the
    smallest doc_id reachable over links, null only if all ids there are null. Rows with equal
    fingerprints, such as copies or texts without words, are one node, so thousands of copies
    cost no pairs. Other columns are ignored; an empty table gives no rows.
    """
    printed = stored(fingerprints(docs), "simhash-prints")
    return printed.join(_components(printed), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with all its columns as they were.

    It is the row with the component's id; among rows that repeat this id, the smallest one.
    Fingerprints are taken once for the components and once more where rows are let through,
    so that whole texts are shuffled once and never stored.
    """
    printed = stored(fingerprints(docs), "simhash-prints")
    found = printed.join(_components(printed), "fp").where(
        F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
    first = found.groupBy("root").agg(F.min("fp").alias("fp"), F.first("doc_id").alias("doc_id"))
    kept = stored(first.select("fp", *_null_free("doc_id")), "simhash-kept")
    columns, text = renamed(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), *columns)
    own = [f"_c{i}" for i in range(len(columns))]
    keyed = with_fingerprint(rows, text).select("fp", *_null_free("_id"), *own)
    # after the join, rows that repeat an id lie together
    chosen = keyed.join(kept, _KEYS, "left_semi")
    least = chosen.groupBy(*_KEYS).agg(F.min(F.struct(*own)).alias("_row")).select("_row.*")
    return restored(least, docs)


_KEYS = ["fp", "_number", "_missing"]


def _null_free(doc_id: str) -> list[Column]:
    """An id as two columns that are never null, so that joins and groups share a partitioning."""
    return [
        F.coalesce(doc_id, F.lit(0)).cast("bigint").alias("_number"),
        F.col(doc_id).isNull().alias("_missing"),
    ]
