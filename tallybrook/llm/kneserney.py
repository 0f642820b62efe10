"""Interpolated modified Kneser-Ney bigram model in memory-mapped sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import sharedfiles
from tallybrook.llm.common import map_arrow, ship_package, stored
from tallybrook.llm.langid import held_out
from tallybrook.session import work_dir

#: Tokens that are handled at a time, and entries that a task gathers before it hands them on.
BLOCK_TOKENS = 1 << 20
GATHERED = 4_000_000
#: Bytes of training text per bucket of the model, about; each bucket is a file of each kind.
BUCKET_BYTES = 24 << 20
#: A context with more tokens is dealt to several buckets by the word that follows.
HOT_TOKENS = 2_000_000

#: No word holds white space, so these stand for the end of a text and what is before its start.
END = xxhash.xxh64_intdigest(b"\n")
START = np.uint64(0xFFFFFFFF)
ID_BITS = np.uint64(32)


def tokens(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of whole texts: the hashes of all words, an END after each text, and the number
    of tokens of each text. A text of more than a block is a block of its own."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts: list[int] = []
    for text in texts:
        words = (text or "").encode("utf-8").lower().split()
        hashes.extend(map(digest, words))
        hashes.append(END)
        counts.append(len(words) + 1)
        if len(hashes) >= BLOCK_TOKENS:
            yield np.array(hashes, dtype=np.uint64), np.array(counts)
            hashes, counts = [], []
    if counts:
        yield np.array(hashes, dtype=np.uint64), np.array(counts)


class Gathered:
    """Distinct keys and their counts, merged whenever many have come together."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = self.merged = 0

    def add(self, values: np.ndarray) -> None:
        keys, counts = np.unique(values, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 2 * self.merged + GATHERED // 2:
            self._set(*merge(self.keys, self.counts))

    def _set(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = [keys], [counts]
        self.size = self.merged = len(keys)

    def full(self) -> bool:
        return self.merged > GATHERED

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = merge(self.keys, self.counts)
        self.__init__()
        return keys, counts


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts added up."""
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    every, number = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, number = every[order], number[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[first], np.add.reduceat(number, first) if len(every) else number


_PAYLOAD = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
PAYLOAD = "bucket int, keys binary, counts binary"


def _rows(buckets: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per bucket with its keys, as differences, and counts; keys are sorted."""
    order = np.argsort(buckets, kind="stable")
    buckets, keys, counts = buckets[order], keys[order], counts[order].astype(np.int64)
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(keys) else []
    for lo, hi in zip(starts, np.append(starts[1:], len(keys)) if len(keys) else []):
        steps = np.diff(keys[lo:hi], prepend=np.uint64(0))
        small = np.uint32 if counts[lo:hi].max() < 1 << 32 else np.uint64
        narrow = counts[lo:hi].astype(small)
        if narrow.max() < 255:
            narrow = narrow.astype(np.uint8)
        row = [
            pa.array([buckets[lo]], type=pa.int32()),
            pa.array([steps.tobytes()], type=pa.binary()),
            pa.array([narrow.dtype.char.encode() + narrow.tobytes()], type=pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(row, schema=_PAYLOAD)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The merged keys and counts of all rows of a bucket."""
    keys, counts = [], []
    for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist()):
        keys.append(np.cumsum(np.frombuffer(k, dtype=np.uint64), dtype=np.uint64))
        counts.append(np.frombuffer(c, dtype=np.dtype(c[:1].decode()), offset=1).astype(np.int64))
    return merge(keys, counts)


def _compact(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else np.uint64)


@dataclass
class Model:
    """What is known of a model besides its files: all of fixed size or one entry per bucket."""

    folder: str
    buckets: int
    offsets: list[int]
    total: int = 0
    vocabulary: int = 0
    hot: dict[int, int] = field(default_factory=dict)
    pair_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    pairs: int = 0
    word_left: float = 1.0
    hot_contexts: dict[int, tuple[int, ...]] = field(default_factory=dict)
    without_pairs: frozenset[int] = frozenset()


def _bucket_of_hash(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of equal length; `buckets` is a power of two."""
    bits = buckets.bit_length() - 1
    if not bits:
        return np.zeros(len(hashes), dtype=np.int32)
    return (hashes >> np.uint64(64 - bits)).astype(np.int32)


class Reader:
    """A worker's view of a model's files."""

    def __init__(self, model: Model):
        self.model = model
        self.offsets = np.array(model.offsets, dtype=np.int64)
        self.files: dict[str, np.ndarray] = {}
        self.hot_ids = np.array(sorted(model.hot), dtype=np.uint64)
        self.hot_spread = np.array([model.hot[i] for i in sorted(model.hot)], dtype=np.uint64)

    def file(self, kind: str, bucket: int) -> np.ndarray:
        name = f"{kind}-{bucket:06d}"
        if name not in self.files:
            self.files[name] = sharedfiles.load(self.model.folder, name)
        return self.files[name]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of each hash in the sorted arrays, -1 for unknown words, and its count."""
        known, row = np.unique(hashes, return_inverse=True)
        ids = np.full(len(known), -1, dtype=np.int64)
        counts = np.zeros(len(known), dtype=np.int64)
        bucket = _bucket_of_hash(known, self.model.buckets)
        for b, lo, hi in _runs(bucket):
            if self.offsets[b + 1] == self.offsets[b]:
                continue
            place, found = _search(self.file("words", b), known[lo:hi])
            ids[lo:hi][found] = self.offsets[b] + place[found]
            counts[lo:hi][found] = self.file("counts", b)[place[found]]
        return ids[row], counts[row]

    def bucket_of_pair(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The bucket of its context, or for a hot context one of several, by the word."""
        last = self.model.buckets - 1
        own = np.searchsorted(self.offsets, before.astype(np.int64), side="right") - 1
        own = np.minimum(own, last)
        if len(self.hot_ids):
            at = np.minimum(np.searchsorted(self.hot_ids, before), len(self.hot_ids) - 1)
            hot = np.flatnonzero(self.hot_ids[at] == before)
            spread = self.hot_spread[at[hot]]
            mixed = (word[hot] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            own[hot] = (own[hot] + (mixed % spread).astype(np.int64)) % self.model.buckets
        return own

    def pairs(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How often each pair of ids stands in the training texts."""
        key = (before << ID_BITS) | word
        bucket = self.bucket_of_pair(before, word)
        order = np.lexsort((key, bucket)) if self.model.buckets > 1 else np.argsort(key)
        counts = np.zeros(len(key), dtype=np.int64)
        sorted_key = key[order]
        for b, lo, hi in _runs(bucket[order]):
            if b not in self.model.without_pairs:
                place, found = _search(self.file("pairs", b), sorted_key[lo:hi])
                counts[order[lo:hi][found]] = self.file("paircounts", b)[place[found]]
        return counts

    def statistics(self, ids: np.ndarray) -> np.ndarray:
        """Rows (tokens after it, followers seen once, twice, more often, words before it)."""
        known, row = np.unique(ids, return_inverse=True)
        rows = np.zeros((len(known), 5))
        inside = known < np.uint64(self.offsets[-1])
        bucket = np.searchsorted(self.offsets, known.astype(np.int64), side="right") - 1
        for b, lo, hi in _runs(np.where(inside, bucket, -1)):
            if b >= 0:
                at = known[lo:hi].astype(np.int64) - self.offsets[b]
                if b not in self.model.without_pairs:
                    rows[lo:hi, :4] = self.file("contexts", b)[at]
                rows[lo:hi, 4] = self.file("continuations", b)[at]
        for i, extra in self.model.hot_contexts.items():
            rows[known == np.uint64(i), :4] = extra
        return rows[row]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of each run of equal values."""
    if not len(values):
        return
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    for lo, hi in zip(starts.tolist(), np.append(starts[1:], len(values)).tolist()):
        yield int(values[lo]), lo, hi


def _search(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


_readers: dict[str, Reader] = {}


def reader(model: Model) -> Reader:
    if model.folder not in _readers or _readers[model.folder].model != model:
        _readers.clear()
        _readers[model.folder] = Reader(model)
    return _readers[model.folder]


def _pair_ids(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the id before it, START for a text's first, and its own id."""
    before = np.empty(len(ids), dtype=np.uint64)
    before[1:] = ids[:-1].astype(np.uint64)
    before[np.cumsum(counts) - counts] = START
    return before, ids.astype(np.uint64)


def _count_words(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered()
        for batch in batches:
            for hashes, _ in tokens(batch.column("text").to_pylist()):
                gathered.add(hashes)
                if gathered.full():
                    keys, counts = gathered.take()
                    yield from _rows(_bucket_of_hash(keys, buckets), keys, counts)
        keys, counts = gathered.take()
        yield from _rows(_bucket_of_hash(keys, buckets), keys, counts)

    return map_arrow(rows.select("text"), run, PAYLOAD)


def _count_pairs(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gathered = reader(model), Gathered()

        def handed_on() -> Iterator[pa.RecordBatch]:
            keys, counts = gathered.take()
            buckets = own.bucket_of_pair(keys >> ID_BITS, keys & START)
            yield from _rows(buckets, keys, counts)

        for batch in batches:
            for hashes, counts in tokens(batch.column("text").to_pylist()):
                before, word = _pair_ids(own.words(hashes)[0], counts)
                gathered.add((before << ID_BITS) | word)
                if gathered.full():
                    yield from handed_on()
        yield from handed_on()

    return map_arrow(rows.select("text"), run, PAYLOAD)


def _discounts(times: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more from how many keys have counts 1 to 4.

    Where a small corpus leaves one undefined, it is half of the count.
    """
    n1, n2, n3, n4 = times
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = []
    for k, (here, above) in enumerate([(n1, n2), (n2, n3), (n3, n4)], 1):
        d = k - (k + 1) * y * above / here if here and y else k / 2
        out.append(min(max(d, 0.0), float(k)))
    return tuple(out)


def _times(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _save_words(folder: str, hot_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, counts = _unpack(table)
        sharedfiles.save(folder, f"words-{bucket:06d}", keys)
        sharedfiles.save(folder, f"counts-{bucket:06d}", _compact(counts))
        hot = np.flatnonzero(counts > hot_tokens)
        return pa.table(
            {
                "bucket": pa.array([bucket], type=pa.int32()),
                "n": pa.array([len(keys)], type=pa.int64()),
                "total": pa.array([int(counts.sum())], type=pa.int64()),
                "hot": pa.array([hot.tolist()], type=pa.list_(pa.int64())),
                "hot_counts": pa.array([counts[hot].tolist()], type=pa.list_(pa.int64())),
            }
        )

    return run, "bucket int, n bigint, total bigint, hot array<bigint>, hot_counts array<bigint>"


def _save_pairs(model: Model):
    """Saves a bucket's pairs and the statistics of its contexts; returns how often each word
    follows a context here, and the statistics of hot contexts, which other buckets add to."""

    def run(table: pa.Table) -> pa.Table:
        own = reader(model)
        bucket = table.column("bucket")[0].as_py()
        keys, counts = _unpack(table)
        sharedfiles.save(model.folder, f"pairs-{bucket:06d}", keys)
        sharedfiles.save(model.folder, f"paircounts-{bucket:06d}", _compact(counts))
        before, word = keys >> ID_BITS, keys & START
        first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        context = before[first]
        stats = np.stack(
            [
                np.add.reduceat(x.astype(np.int64), first)
                for x in (counts, counts == 1, counts == 2, counts > 2)
            ],
            axis=1,
        )
        is_hot = np.isin(context, own.hot_ids)
        lo, hi = model.offsets[bucket], model.offsets[bucket + 1]
        dense = np.zeros((hi - lo, 4), dtype=np.int64)
        dense[context[~is_hot].astype(np.int64) - lo] = stats[~is_hot]
        sharedfiles.save(model.folder, f"contexts-{bucket:06d}", _compact(dense))
        hot = [[int(c), *row] for c, row in zip(context[is_hot], stats[is_hot].tolist())]
        words, follows = np.unique(word, return_counts=True)
        target = np.searchsorted(own.offsets, words.astype(np.int64), side="right") - 1
        parts = list(_rows(target, words, follows))
        out = pa.Table.from_batches(parts, schema=_PAYLOAD)
        empty = [[]] * (out.num_rows - 1)
        added = {
            "made_in": pa.array([bucket] * out.num_rows, type=pa.int32()),
            "times": pa.array([_times(counts), *empty], type=pa.list_(pa.int64())),
            "hot": pa.array([hot, *empty], type=pa.list_(pa.list_(pa.int64()))),
        }
        for name, column in added.items():
            out = out.append_column(name, column)
        return out

    return run, f"{PAYLOAD}, made_in int, times array<bigint>, hot array<array<bigint>>"


def _save_continuations(model: Model):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words, follows = _unpack(table)
        lo, hi = model.offsets[bucket], model.offsets[bucket + 1]
        dense = np.zeros(hi - lo, dtype=np.int64)
        dense[words.astype(np.int64) - lo] = follows
        sharedfiles.save(model.folder, f"continuations-{bucket:06d}", _compact(dense))
        return pa.table(
            {
                "bucket": pa.array([bucket], type=pa.int32()),
                "pairs": pa.array([int(follows.sum())], type=pa.int64()),
                "times": pa.array([_times(follows)], type=pa.list_(pa.int64())),
                "more": pa.array([int((follows > 2).sum())], type=pa.int64()),
            }
        )

    return run, "bucket int, pairs bigint, times array<bigint>, more bigint"


def train(
    rows: DataFrame, bucket_bytes: int = BUCKET_BYTES, hot_tokens: int = HOT_TOKENS
) -> Model:
    """A model of all rows (text), in files of the shared folder.

    Words are counted per task and bucket, buckets merged into sorted arrays of hashes; a word's
    place among them is its id. Pairs of ids are counted the same way, in the bucket of the
    first, or of several buckets if that is a hot context. The driver gets sums and, for every
    context with over `hot_tokens` tokens, five numbers per bucket it is dealt to.
    """
    spark = rows.sparkSession
    ship_package(spark)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(0, int(size // bucket_bytes).bit_length())
    folder = work_dir(spark, "llm-lm")
    run, schema = _save_words(folder, hot_tokens)
    saved = _count_words(rows, buckets).groupBy("bucket").applyInArrow(run, schema).collect()
    sizes = [0] * buckets
    for row in saved:
        sizes[row.bucket] = row.n
    offsets = np.append(0, np.cumsum(sizes)).tolist()
    model = Model(folder, buckets, offsets)
    model.total = sum(row.total for row in saved)
    model.vocabulary = offsets[-1]
    if not model.total:
        return model
    if model.vocabulary >= int(START):
        raise ValueError("more distinct words than ids")
    for row in saved:
        for place, n in zip(row.hot, row.hot_counts):
            model.hot[offsets[row.bucket] + place] = min(buckets, -(-n // hot_tokens))
    # the start is a context as often as there are texts
    model.hot[int(START)] = min(buckets, -(-model.total // hot_tokens))
    run, schema = _save_pairs(model)
    paired = stored(_count_pairs(rows, model).groupBy("bucket").applyInArrow(run, schema), "lm")
    made = {row.made_in for row in paired.select("made_in").distinct().collect()}
    model.without_pairs = frozenset(range(buckets)) - made
    times = paired.select(F.posexplode("times").alias("k", "n")).groupBy("k").agg(F.sum("n"))
    counted = dict(map(tuple, times.collect()))
    model.pair_discounts = _discounts([counted.get(k, 0) for k in range(4)])
    hot = paired.select(F.explode("hot").alias("h")).groupBy(F.col("h")[0])
    sums = hot.agg(*[F.sum(F.col("h")[k]) for k in range(1, 5)])
    model.hot_contexts = {row[0]: tuple(row)[1:] for row in sums.collect()}
    run, schema = _save_continuations(model)
    finished = (
        paired.select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(run, schema)
    ).collect()
    model.pairs = sum(row.pairs for row in finished)
    times = [sum(row.times[k] for row in finished) for k in range(4)]
    model.word_discounts = _discounts(times)
    d1, d2, d3 = model.word_discounts
    more = sum(row.more for row in finished)
    model.word_left = (d1 * times[0] + d2 * times[1] + d3 * more) / model.pairs
    return model


def _log_probabilities(own: Reader, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 of each token's probability after the one before it."""
    model = own.model
    uniform = 1.0 / (model.vocabulary + 1)
    if not model.total:
        return np.full(len(ids), np.log10(uniform))
    known = ids >= 0
    before, word = _pair_ids(ids, counts)
    known_before = np.append(True, known[:-1]) | (before == START)
    stats = np.zeros((len(ids), 5))
    stats[known] = own.statistics(word[known])
    followers = np.zeros((len(ids), 5))
    followers[known_before] = own.statistics(before[known_before])
    continued = stats[:, 4]
    discount = np.array([0.0, *model.word_discounts])[np.minimum(continued, 3).astype(int)]
    lower = np.maximum(continued - discount, 0) / model.pairs + model.word_left * uniform
    seen = np.zeros(len(ids), dtype=np.int64)
    both = known & known_before
    seen[both] = own.pairs(before[both], word[both])
    discount = np.array([0.0, *model.pair_discounts])[np.minimum(seen, 3)]
    total = followers[:, 0]
    d1, d2, d3 = model.pair_discounts
    left = d1 * followers[:, 1] + d2 * followers[:, 2] + d3 * followers[:, 3]
    with np.errstate(divide="ignore", invalid="ignore"):
        higher = (np.maximum(seen - discount, 0) + left * lower) / total
    return np.log10(np.where(total > 0, higher, lower))


_SCORED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("train_tokens", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)
SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Scores of every row of (doc_id, held_out, text) under a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(model)
        for batch in batches:
            done = 0
            for hashes, counts in tokens(batch.column("text").to_pylist()):
                ids, times = own.words(hashes)
                starts = np.cumsum(counts) - counts
                base = np.log10((times + 1.0) / (model.total + model.vocabulary + 1.0))
                likely = _log_probabilities(own, ids, counts)
                n = len(counts)
                columns = [
                    batch.column("doc_id").slice(done, n),
                    batch.column("held_out").slice(done, n),
                    pa.array(counts.astype(np.int64)),
                    pa.array(np.add.reduceat((times > 0).astype(np.int64), starts)),
                    pa.array(np.full(n, model.total, dtype=np.int64)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(likely, starts)),
                ]
                done += n
                yield pa.RecordBatch.from_arrays(columns, schema=_SCORED)

    return map_arrow(rows.select("doc_id", "held_out", "text"), run, SCORED)


def train_and_score(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Scores of every row of (doc_id, text) under a model of those outside the held-out fold.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams)
    and score, both log10 probabilities of the whole text with its end. A null text counts as
    empty: its one token is the end. Words unknown to the model share one unknown word. With no
    training rows every probability is 1 over 1. Repeated rows are counted and scored each;
    other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "text",
    )
    return score(rows, train(rows.where(~F.col("held_out"))))
