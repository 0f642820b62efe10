"""Alignment of two tokenizers over the same bytes, by interval coalescing."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.bpe import byte_letters
from tallybrook.llm.common import map_arrow, stored

#: Texts are encoded and aligned in blocks of about this many characters, a longer one by itself.
BLOCK_CHARS = 1_000_000

#: Pairs of ids whose counts are sent to all workers; beyond, only those that hold over
#: 1 / BROADCAST_PAIRS of all links, which are fewer, and links of others are joined.
BROADCAST_PAIRS = 500_000

#: Code points on which all regular expression engines agree what a letter or digit is.
_PLAIN = re.compile("[^\x00-ɏ]").search

ALIGNED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string,"
    " links array<bigint>"
)


class ByteTokenizer:
    """A byte-level BPE file: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self._library = path, None
        byte = {letter: number for number, letter in enumerate(byte_letters())}
        special = {t["content"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        ranks = {
            bytes(byte[letter] for letter in token): number
            for token, number in vocabulary.items()
            if token not in special
        }
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, number in ranks.items():
            self.bytes[number] = token
        from public_tokenizers import PATTERN

        self._fast = tiktoken.Encoding(
            "byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of the texts. The library that reads the file itself takes texts with characters
        whose class may depend on an engine's Unicode version; its ids are the same elsewhere."""
        found = [None if _PLAIN(t) else self._fast.encode_ordinary(t) for t in texts]
        rest = [i for i, ids in enumerate(found) if ids is None]
        if rest:
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path)
                self._library.encode_special_tokens = True
                self._library.no_padding()
                self._library.no_truncation()
            for i in rest:
                found[i] = self._library.encode(texts[i], add_special_tokens=False).ids
        return found


class PieceTokenizer:
    """A sentencepiece file: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        for number in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(number)
            if self._model.is_byte(number):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode("utf-8"))

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self._model.encode(list(texts), num_threads=1)


class Side:
    """One tokenizer with the tables that turn ids into bytes and numbers on end."""

    def __init__(self, tokenizer, ends: tuple[str, ...]):
        self.tokenizer = tokenizer
        self.pieces = pa.array(tokenizer.bytes, type=pa.binary())
        self.sizes = np.array([len(b) for b in tokenizer.bytes], dtype=np.int64)
        self.numbers = [f"{i}{end}" for end in ends for i in range(len(tokenizer.bytes))]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(texts)
        counts = np.array([len(ids) for ids in found], dtype=np.int64)
        flat = np.fromiter(
            (i for ids in found for i in ids), dtype=np.int32, count=int(counts.sum())
        )
        return flat, counts

    def joined(self, ids: np.ndarray) -> memoryview:
        """The bytes of all ids on end."""
        data = self.pieces.take(pa.array(ids)).buffers()[2]
        return memoryview(data).cast("B") if data is not None else memoryview(b"")


@dataclass
class Alignment:
    """Tokens of both sides in groups, and the pairs of tokens that share bytes.

    `a`, `b`, `group` have one entry per overlapping pair, in order: indices of the tokens and of
    their group; `together` tells whether the two end at the same byte. `group_a` and `group_b`
    are the groups of all tokens.
    """

    a: np.ndarray
    b: np.ndarray
    group: np.ndarray
    together: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def coalesce(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Alignment:
    """Align two rows of tokens of the given byte sizes (1 at least) that cover the same bytes.

    All tokens are sorted by start; a group ends where a start reaches the largest end so far.
    Within a group, each distinct start begins one stretch of bytes that belongs to one token of
    either side, so the stretches are the overlapping pairs.
    """
    n_a = len(sizes_a)
    ends = np.concatenate([np.cumsum(sizes_a), np.cumsum(sizes_b)])
    starts = ends - np.concatenate([sizes_a, sizes_b])
    side = np.zeros(len(ends), dtype=bool)
    side[n_a:] = True
    order = np.lexsort((side, starts))
    start, is_b = starts[order], side[order]
    reached = np.maximum.accumulate(ends[order])
    breaks = np.append(True, start[1:] >= reached[:-1]) if len(start) else np.zeros(0, dtype=bool)
    group = np.cumsum(breaks) - 1
    last = np.append(start[1:] != start[:-1], True) if len(start) else breaks
    seen_b = np.cumsum(is_b)
    b = seen_b[last] - 1
    a = (np.arange(1, len(start) + 1) - seen_b)[last] - 1
    together = ends[:n_a][a] == ends[n_a:][b]
    return Alignment(a, b, group[last], together, group[~is_b], group[is_b])


class Aligner:
    """Two tokenizers and what a worker needs to align texts under both."""

    def __init__(self, path_a: str, path_b: str):
        # a number is followed by a comma, by what ends its side of a group, or by nothing
        self.a = Side(ByteTokenizer(path_a), (",", "|"))
        self.b = Side(PieceTokenizer(path_b), (",", ";", ""))
        self.numbers = pa.array(self.a.numbers + self.b.numbers)
        self.n_a, self.n_b = len(self.a.sizes), len(self.b.sizes)

    def same_bytes(self, spaced: list[bytes], side: Side, ids, counts) -> np.ndarray:
        """Which texts the ids spell out in full."""
        data = side.joined(ids)
        upto = np.append(0, np.cumsum(side.sizes[ids]))[np.append(0, np.cumsum(counts))].tolist()
        return np.array(
            [data[lo:hi] == text for text, lo, hi in zip(spaced, upto, upto[1:])], dtype=bool
        )

    def align(self, texts: Sequence[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, digest of the groups, links) of each text.

        A link is a pair of tokens that end together, as id_a * size of B's vocabulary + id_b.
        """
        spaced = [" " + t for t in texts]
        raw = [t.encode("utf-8") for t in spaced]
        ids_a, counts_a = self.a.encode(spaced)
        ids_b, counts_b = self.b.encode(texts)
        good = np.array([len(t) > 0 for t in texts], dtype=bool)
        good &= self.same_bytes(raw, self.a, ids_a, counts_a)
        good &= self.same_bytes(raw, self.b, ids_b, counts_b)
        ids_a, ids_b = ids_a[np.repeat(good, counts_a)], ids_b[np.repeat(good, counts_b)]
        counts_a, counts_b = counts_a[good], counts_b[good]
        found = coalesce(self.a.sizes[ids_a], self.b.sizes[ids_b])
        ids = self._groups(found, ids_a, ids_b, counts_b)
        text = self.numbers.take(pa.array(ids))
        data = memoryview(text.buffers()[2]) if len(text) else memoryview(b"")
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[: len(text) + 1]
        tokens = np.append(0, np.cumsum(counts_a + counts_b))
        cuts = offsets[tokens].tolist()
        links = ids_a[found.a].astype(np.int64) * self.n_b + ids_b[found.b]
        links, group = links[found.together], found.group[found.together]
        # the first group of each text
        first = found.group_a[np.cumsum(counts_a) - counts_a] if len(counts_a) else counts_a
        groups = np.append(first, found.group_a[-1] + 1 if len(found.group_a) else 0)
        at = np.searchsorted(group, groups)
        rows, k = [], 0
        for ok in good.tolist():
            if not ok:
                rows.append((0, 0, 0, "", links[:0]))
                continue
            digest = hashlib.sha256(data[cuts[k] : cuts[k + 1]]).hexdigest()
            n_groups = int(groups[k + 1] - groups[k])
            own = links[at[k] : at[k + 1]]
            rows.append((int(counts_a[k]), int(counts_b[k]), n_groups, digest, own))
            k += 1
        return rows

    def _groups(self, found: Alignment, ids_a, ids_b, counts_b) -> np.ndarray:
        """Places in `numbers` of all ids, group by group, those of A before those of B."""
        n = int(found.group_a[-1]) + 1 if len(found.group_a) else 0
        in_a = np.bincount(found.group_a, minlength=n)
        in_b = np.bincount(found.group_b, minlength=n)
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        ids = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        end_a = np.zeros(len(ids_a), dtype=np.int64)
        end_a[upto_a - 1] = 1
        ids[np.arange(len(ids_a)) + (upto_b - in_b)[found.group_a]] = ids_a + end_a * self.n_a
        end_b = np.zeros(len(ids_b), dtype=np.int64)
        end_b[upto_b - 1] = 1
        end_b[np.cumsum(counts_b) - 1] = 2
        at_b = np.arange(len(ids_b)) + upto_a[found.group_b]
        ids[at_b] = ids_b + end_b * self.n_b + 2 * self.n_a
        return ids


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two tokenizer files."""
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b)
    return _aligners[key]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Token counts, groups and links of every row of (doc_id, text), under a number `row`.

    links holds id_a * (size of B's vocabulary) + id_b for each two tokens that end together.
    """
    arrow = pa.schema(
        [
            ("row", pa.int64()),
            ("doc_id", pa.int64()),
            ("n_a", pa.int64()),
            ("n_b", pa.int64()),
            ("n_groups", pa.int64()),
            ("groups_sha256", pa.string()),
            ("links", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for batch in batches:
            sizes = pa.compute.utf8_length(batch.column("text")).fill_null(0).to_pylist()
            for start, end in _spans(sizes):
                part = batch.slice(start, end - start)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n_a, n_b, n_groups, digest, links = zip(*tool.align(texts))
                offsets = np.append(0, np.cumsum([len(own) for own in links]))
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, type=pa.int32()), pa.array(np.concatenate(links))
                )
                columns = [part.column("row"), part.column("doc_id")]
                columns += [pa.array(c, type=pa.int64()) for c in (n_a, n_b, n_groups)]
                columns += [pa.array(digest, type=pa.string()), lists]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").alias("text"),
    )
    return map_arrow(rows, run, ALIGNED)


def _spans(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about BLOCK_CHARS characters; a longer text is a range of its own."""
    start, chars = 0, 0
    for i, size in enumerate(sizes):
        if chars and chars + size > BLOCK_CHARS:
            yield start, i
            start, chars = i, 0
        chars += size
    if start < len(sizes):
        yield start, len(sizes)


def cross_tokenizer_alignment(
    docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

    A encodes a space and the text, B the text, to which it adds the space itself. Null and empty
    texts, and texts that either side does not spell out byte by byte, have no tokens: zeros and
    an empty digest. Links are the pairs of tokens that end together; the count of a pair of ids
    is the number of its links in all texts; n_best counts the links whose pair is the most
    frequent one of its B id, ties included. Repeated rows count each; other columns are
    ignored; an empty table gives no rows. The files lie on every machine.

    Each text is encoded once; its links are stored. Pairs of ids are as many as two vocabularies
    allow at most. Where they are few enough, all counts go to the workers; else those of
    frequent pairs do, and the remaining links are summed per text and joined with theirs.
    """
    spark = docs.sparkSession
    rows = stored(aligned(docs, path_a, path_b), "align-rows")
    n_b = aligner(path_a, path_b).n_b
    counts = rows.select(F.explode("links").alias("pair")).groupBy("pair")
    counts = stored(counts.agg(F.count(F.lit(1)).alias("n")), "align-pairs")
    pairs, links = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = 0 if pairs <= broadcast_pairs else links // broadcast_pairs
    known = counts.where(F.col("n") > least).orderBy("pair").toArrow()
    best = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("n")).toArrow()
    table = np.zeros(n_b, dtype=np.int64)
    table[best.column("b").to_numpy()] = best.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(
        (known.column("pair").to_numpy(), known.column("n").to_numpy(), table)
    )
    totals = map_arrow(
        rows, _totals(shared), "row bigint, doc_id bigint, n_a bigint, n_b bigint,"
        " n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )
    if least:
        rare = map_arrow(rows.select("row", "links"), _rare(shared), "row bigint, pair bigint, k bigint")
        tops = counts.groupBy((F.col("pair") % n_b).alias("_b")).agg(F.max("n").alias("_top"))
        more = (
            rare.join(counts.where(F.col("n") <= least), "pair")
            .join(F.broadcast(tops), F.col("pair") % n_b == F.col("_b"))
            .groupBy("row")
            .agg(
                F.sum(F.col("k") * F.col("n")).alias("_sum"),
                F.sum(F.when(F.col("n") == F.col("_top"), F.col("k")).otherwise(0)).alias("_best"),
            )
        )
        totals = (
            totals.join(more, "row", "left")
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
            .withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0)))
        )
    return totals.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def _looked_up(links: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each link's pair, 0 for pairs that were not sent."""
    if not len(pairs):
        return np.zeros(len(links), dtype=np.int64)
    at = np.minimum(np.searchsorted(pairs, links), len(pairs) - 1)
    return np.where(pairs[at] == links, counts[at], 0)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch on end, and how many each row has."""
    column = batch.column("links")
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), sizes.astype(np.int64)


def _totals(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                links, sizes = _flat(batch)
                n = _looked_up(links, pairs, counts)
                top = (n > 0) & (n == best[links % len(best)])
                ends = np.cumsum(sizes)
                upto, tops = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(top))
                columns = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups")]
                columns.append(pa.array(sizes))
                columns.append(pa.array(tops[ends] - tops[ends - sizes]))
                columns.append(pa.array(upto[ends] - upto[ends - sizes]))
                columns.append(batch.column("groups_sha256"))
                yield pa.RecordBatch.from_arrays(
                    columns,
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                           "count_sum", "groups_sha256"],
                )

    return run


def _rare(shared):
    """Links whose pair was not sent, summed per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, _ = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                links, sizes = _flat(batch)
                at = np.repeat(np.arange(batch.num_rows), sizes)
                rest = _looked_up(links, pairs, counts) == 0
                both, k = np.unique(
                    np.stack([at[rest], links[rest]]), axis=1, return_counts=True
                )
                row = batch.column("row").to_numpy()[both[0]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), pa.array(both[1]), pa.array(k.astype(np.int64))],
                    names=["row", "pair", "k"],
                )

    return run
