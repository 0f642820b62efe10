"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.llm.common import map_arrow, renamed, restored, slices

#: Longest context in bytes; a window of one more byte must fit a 64-bit key.
ORDER = 4

#: Bytes of text that a language's statistics are fitted on, about, and the longest piece among
#: them; longer texts are cut into pieces. A bounded sample: pieces are taken by a hash of id, text
#: and number until the bytes suffice, one at least.
SAMPLE_BYTES = 400_000
SAMPLE_TEXT_BYTES = 40_000
#: A character has four bytes at most.
PIECE_CHARS = SAMPLE_TEXT_BYTES // 4

#: Labels with totals that are sent to all executors; with more, rows are shuffled instead.
MAX_SENT_LANGS = 10_000

#: Bytes scored at a time.
BLOCK_BYTES = 1 << 20

UNKNOWN = "und"


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a document is kept out of training; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def windows(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For every byte a key of itself (lowest) and the `order` bytes before it.

    Before the start of a text lie zero bytes.
    """
    key = data.astype(np.uint64)
    ends = np.append(starts[1:], len(data))
    for back in range(1, order + 1):
        shifted = np.zeros(len(data), dtype=np.uint64)
        shifted[back:] = data[:-back] if back < len(data) else 0
        for j in range(back):
            at = starts + j
            shifted[at[at < ends]] = 0
        key |= shifted << np.uint64(8 * back)
    return key


def count_contexts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts per language, order and window (context and byte) of sample rows (lang, text)."""
    fields = [("lang", pa.string()), ("size", pa.int8()), ("win", pa.int64()), ("n", pa.int64())]
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(folded(text))
            for lang, texts in by_lang.items():
                texts = [t for t in texts if t]
                if not texts:
                    continue
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
                full = windows(data, starts, order)
                for size in range(order + 1):
                    win, n = np.unique(full & _mask(size + 1), return_counts=True)
                    columns = [
                        pa.array([lang] * len(win), type=pa.string()),
                        pa.array(np.full(len(win), size, dtype=np.int8)),
                        pa.array(win.view(np.int64)),
                        pa.array(n.astype(np.int64)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    schema = "lang string, size tinyint, win bigint, n bigint"
    partial = map_arrow(rows.select("lang", "text"), run, schema)
    return partial.groupBy("lang", "size", "win").agg(F.sum("n").alias("n"))


def _mask(octets: int) -> np.uint64:
    return np.uint64((1 << (8 * octets)) - 1)


class HashTable:
    """Sorted distinct keys and their rows of values, found by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.values = np.concatenate([values, np.zeros((1, values.shape[1]), values.dtype)])
        bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.wrap = (1 << bits) - 1
        self.slots = np.full(1 << bits, len(keys), dtype=np.int32)
        self.keys = np.append(keys, np.uint64(0))
        self.absent = len(keys)
        at, item = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(item):
            free = self.slots[at] == self.absent
            self.slots[at[free]] = item[free]
            lost = self.slots[at] != item
            at, item = (at[lost] + 1) & self.wrap, item[lost]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        return mixed.astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; `absent` where there is none."""
        at = self._home(keys)
        row = self.slots[at]
        open_ = np.flatnonzero((row != self.absent) & (self.keys[row] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.wrap
            row[open_] = self.slots[at]
            missed = (row[open_] != self.absent) & (self.keys[row[open_]] != keys[open_])
            open_, at = open_[missed], at[missed]
        return row


class Model:
    """Frozen context trees of all languages: code lengths in bits by window.

    A byte seen in its context costs -log2(n / (total + distinct)); else the escape costs
    -log2(distinct / (total + distinct)) and the next shorter context goes on; a context a
    language has not seen is passed over. Below the empty context every byte costs 8 bits.
    Since the statistics are frozen, the cost of a known window is looked up whole.
    """

    def __init__(self, langs: list[str], sizes, lang_of, wins, counts, order: int = ORDER):
        self.langs, self.order = langs, order
        width = len(langs)
        self.costs: list[HashTable] = []
        self.escapes: list[HashTable] = []
        for size in range(order + 1):
            here = sizes == size
            win, lang, n = wins[here], lang_of[here], counts[here].astype(np.float64)
            keys, row = np.unique(win, return_inverse=True)
            contexts, context_row = np.unique(win >> np.uint64(8), return_inverse=True)
            total = np.zeros((len(contexts), width))
            distinct = np.zeros((len(contexts), width))
            np.add.at(total, (context_row, lang), n)
            np.add.at(distinct, (context_row, lang), 1)
            seen = total > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(seen, -np.log2(distinct / (total + distinct)), 0.0)
            escapes = HashTable(contexts, escape.astype(np.float32))
            below = self._shorter(keys, size)
            context = np.searchsorted(contexts, keys >> np.uint64(8))
            cost = escape[context] + below
            known = total[context_row, lang] + distinct[context_row, lang]
            cost[row, lang] = -np.log2(n / known)
            self.escapes.append(escapes)
            self.costs.append(HashTable(keys, cost.astype(np.float32)))

    def _shorter(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Costs of windows with contexts of `size` bytes from the next shorter context on."""
        if size == 0:
            return np.full((len(keys), len(self.langs)), 8.0, dtype=np.float32)
        return self.cost(keys & _mask(size), size - 1)

    def cost(self, keys: np.ndarray, size: int | None = None) -> np.ndarray:
        """Bits of each window in each language."""
        size = self.order if size is None else size
        table = self.costs[size]
        row = table.find(keys)
        bits = table.values[row]
        new = np.flatnonzero(row == table.absent)
        if len(new):
            escapes = self.escapes[size]
            context = escapes.find(keys[new] >> np.uint64(8))
            bits[new] = escapes.values[context] + self._shorter(keys[new], size)
        return bits

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits: a row per text, a column per language."""
        bits = np.zeros((len(texts), len(self.langs)))
        for first, last in _spans(texts):
            part = texts[first:last]
            if len(part) == 1 and len(part[0]) > BLOCK_BYTES:
                bits[first] = self._score_long(part[0])
                continue
            data = np.frombuffer(b"".join(part), dtype=np.uint8)
            if not len(data):
                continue
            lengths = np.array([len(t) for t in part])
            filled = np.flatnonzero(lengths)
            starts = (np.cumsum(lengths) - lengths)[filled]
            cost = self.cost(windows(data, starts, self.order))
            bits[first + filled] = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return bits

    def _score_long(self, text: bytes) -> np.ndarray:
        """Code lengths of one text in pieces, each with the bytes before it as context."""
        data, bits = np.frombuffer(text, dtype=np.uint8), np.zeros(len(self.langs))
        for lo in range(0, len(data), BLOCK_BYTES):
            lead = min(lo, self.order)
            piece = data[lo - lead : lo + BLOCK_BYTES]
            keys = windows(piece, np.zeros(1, dtype=np.int64), self.order)[lead:]
            bits += self.cost(keys).sum(axis=0, dtype=np.float64)
        return bits

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language of the shortest code and its share among all, taking each as likely."""
        bits = self.score(texts)
        best = bits.argmin(axis=1)
        gap = bits - bits.min(axis=1, keepdims=True)
        share = 1.0 / np.exp2(-np.minimum(gap, 1000.0)).sum(axis=1)
        return [self.langs[i] for i in best], share

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {"langs": np.array(self.langs), "order": np.array(self.order)}
        for kind in ("costs", "escapes"):
            for size, t in enumerate(getattr(self, kind)):
                arrays[f"{kind}{size}k"] = t.keys[: t.absent]
                arrays[f"{kind}{size}v"] = t.values[: t.absent]
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as f:
            model = cls.__new__(cls)
            model.langs, model.order = f["langs"].tolist(), int(f["order"])
            for kind in ("costs", "escapes"):
                sizes = range(model.order + 1)
                tables = [HashTable(f[f"{kind}{s}k"], f[f"{kind}{s}v"]) for s in sizes]
                setattr(model, kind, tables)
        return model


def _spans(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK_BYTES together; a longer text is a run of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def folded(text: str) -> bytes:
    """What is learned from and scored: letters lowered."""
    return text.lower().encode("utf-8")


def train(docs: DataFrame) -> Model | None:
    """A model from labelled rows (text, lang) with an `_id`; None when there is nothing to learn.

    Totals per language over all texts fix which share of its pieces the bounded sample takes;
    the piece with the lowest draw is always in it, so every label with text is learned. Rows
    that repeat an id (or a null) and its text count once.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    size = F.octet_length("text")
    cut = F.ceil(F.char_length("text") / F.lit(PIECE_CHARS)).cast("int")
    rows = rows.where(size > 0).select(
        "lang",
        "text",
        F.xxhash64("_id", "text").alias("_hash"),
        F.when(size <= SAMPLE_TEXT_BYTES, F.lit(1)).otherwise(cut).alias("_pieces"),
    )

    def draw(piece: Column) -> Column:
        hashed = F.xxhash64(F.col("_hash"), piece)
        return F.shiftrightunsigned(hashed, 12) / F.lit(float(1 << 52))

    def piece_of(piece: Column) -> Column:
        slice_ = F.substr("text", piece * PIECE_CHARS + 1, F.lit(PIECE_CHARS))
        text = F.when(F.col("_pieces") == 1, F.col("text")).otherwise(slice_)
        return F.struct(piece.alias("piece"), text.alias("text"))

    numbers = F.sequence(F.lit(0), F.col("_pieces") - 1)
    least = F.array_min(F.transform(numbers, draw))
    different = rows.groupBy("lang", "_hash").agg(
        F.max(size).alias("_bytes"), F.min(least).alias("_least")
    )
    totals = (
        different.groupBy("lang")
        .agg(F.sum("_bytes").alias("_total"), F.min("_least").alias("_first"))
        .persist()
    )
    # a row per language; only a table of junk labels is too long to send to all
    small = totals.count() <= MAX_SENT_LANGS
    taken = F.filter(
        numbers,
        lambda k: (draw(k) * F.col("_total") < F.lit(float(SAMPLE_BYTES)))
        | (draw(k) == F.col("_first")),
    )
    sample = (
        rows.join(F.broadcast(totals) if small else totals, "lang")
        .select("lang", "_hash", F.explode(F.transform(taken, piece_of)).alias("_piece"))
        .select("lang", "_hash", "_piece.piece", "_piece.text")
        .dropDuplicates(["lang", "_hash", "piece"])
        .select("lang", "text")
        .repartition("lang")  # bounded per language; one count of a window, not one per task
    )
    # Arrow columns: as rows, the driver would hold an object for every field
    counted = count_contexts(sample).toArrow()
    if not len(counted):
        return None
    found = counted["lang"].combine_chunks().dictionary_encode()
    langs = sorted(found.dictionary.to_pylist())
    number = {v: i for i, v in enumerate(langs)}
    place = np.array([number[v] for v in found.dictionary.to_pylist()], dtype=np.int64)
    return Model(
        langs,
        counted["size"].to_numpy(),
        place[found.indices.to_numpy()],
        counted["win"].to_numpy().view(np.uint64),
        counted["n"].to_numpy(),
    )


_models: dict[str, Model] = {}


def _with_prediction(rows: DataFrame, text: str, model: Model | None) -> DataFrame:
    """rows plus lang_pred and score of the column `text`, where `_letters` says it has any."""
    if model is None:
        return rows.drop("_letters").withColumns(
            {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0).cast("double")}
        )
    shared, name = rows.sparkSession.sparkContext.broadcast(model.to_bytes()), uuid.uuid4().hex
    kept = [c for c in rows.columns if c != "_letters"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models.clear()
            _models[name] = Model.from_bytes(shared.value)
        own = _models[name]
        for batch in slices(batches):
            known = batch.column("_letters").to_pylist()
            texts = batch.column(text).to_pylist()
            texts = [folded(t) if letters else b"" for t, letters in zip(texts, known)]
            langs, share = own.predict(texts)
            langs = [lang if letters else UNKNOWN for lang, letters in zip(langs, known)]
            share = np.where(np.array(known, dtype=bool), share, 0.0)
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(langs, type=pa.string()), pa.array(share, type=pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_arrow(rows, run, T.StructType([rows.schema[c] for c in kept] + added))


def _fitted(docs: DataFrame, folds: int, fold: int) -> Model | None:
    out = held_out(F.col("doc_id"), folds, fold)
    return train(docs.where(~out).select(F.col("doc_id").alias("_id"), "text", "lang"))


def _letters() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")


def identify(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of (doc_id, text, lang).

    Learns from text and non-null lang of the documents outside the held-out fold; predictions
    see the text alone. Texts that are null or without a letter are `und` with score 0, as is
    everything when there is nothing to learn from. Letters are lowered first. Repeated rows are
    scored each; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "text",
        _letters(),
    )
    return _with_prediction(rows, "text", _fitted(docs, folds, fold)).drop("text")


def recognized(docs: DataFrame, least: float, folds: int = 5, fold: int = 0) -> DataFrame:
    """The rows of docs whose language is known with a score of `least` or more, all columns
    as they were."""
    columns, text = renamed(docs)
    judged = _with_prediction(
        docs.select(*columns, _letters()), text, _fitted(docs, folds, fold)
    )
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= F.lit(least))
    return restored(judged.where(sure), docs)
