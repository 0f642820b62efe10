"""Byte-pair encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallybrook.llm.common import map_arrow

#: Texts are encoded in blocks of about this many characters, and a worker remembers the ids of
#: at most this many words; both bound its memory and change no result.
BLOCK_CHARS = 4_000_000
CACHE_WORDS = 200_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [], 0x100
    for byte in range(256):
        if byte in plain:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class Vocabulary:
    """Tokens, ranked merges and text rules of a tokenizer file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids.update(self.special)
        self.tokens = [""] * (max(self.ids.values()) + 1)
        for token, number in self.ids.items():
            self.tokens[number] = token
        self.suffix = model["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([self.ids[c + self.suffix] for c in letters], dtype=np.int64)
        self.size = len(self.tokens)
        left = np.array([self.ids[a] for a, _ in model["merges"]], dtype=np.int64)
        right = np.array([self.ids[b] for _, b in model["merges"]], dtype=np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in model["merges"]], dtype=np.int64)
        codes = left * self.size + right
        self.by_code = np.argsort(codes)
        self.codes = codes[self.by_code]
        # ranks may be applied to all words at once only if no merge makes a pair of a lower rank
        born = np.full(self.size, -1)
        born[self.merged] = np.arange(len(codes))
        if (np.maximum(born[left], born[right]) >= np.arange(len(codes))).any():
            raise ValueError("a merge uses a token that a later merge makes")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that are never merged."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.by_code[at], -1)

    def words(self, text: str) -> list[str]:
        """Special tokens and normalized pieces of a text, in order."""
        if "<|" not in text:
            return self._pieces(text)
        found = []
        for part in self.splitter.split(text):
            found.extend([part] if part in self.special else self._pieces(part))
        return found

    def _pieces(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # lower case is per character: no final form of sigma
        return self.pieces(text.replace("Σ", "σ").lower())


class PairIndex:
    """The symbols of many words in one array, and for each mergeable pair all its positions."""

    def __init__(self, vocabulary: Vocabulary, words: Sequence[str]):
        self.vocabulary = vocabulary
        raw = [word.encode("utf-8") for word in words]
        self.lengths = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.ends = np.cumsum(self.lengths)
        n = len(data)
        self.symbols = vocabulary.inner[data]
        self.symbols[self.ends - 1] = vocabulary.last[data[self.ends - 1]]
        self.next = np.arange(1, n + 1)
        self.next[self.ends - 1] = -1
        self.previous = np.arange(-1, n - 1)
        self.previous[self.ends - self.lengths] = -1
        self.positions: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._add(np.flatnonzero(self.next >= 0))

    def _add(self, at: np.ndarray) -> None:
        """List the pairs that start at these positions under their ranks."""
        rank = self.vocabulary.ranks(self.symbols[at], self.symbols[self.next[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, some in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts)):
            if r not in self.positions:
                self.positions[r] = []
                heapq.heappush(self.active, r)
            self.positions[r].append(some)

    def merge_all(self) -> None:
        """Apply the active ranks in ascending order until no pair is left."""
        symbols, following, previous = self.symbols, self.next, self.previous
        while self.active:
            rank = heapq.heappop(self.active)
            at = np.unique(np.concatenate(self.positions.pop(rank)))
            # positions may have gone stale: keep those where the pair still stands
            at = at[(symbols[at] >= 0) & (following[at] >= 0)]
            other = following[at]
            still = self.vocabulary.ranks(symbols[at], symbols[other]) == rank
            at, other = at[still], other[still]
            if not len(at):
                continue
            if symbols[at[0]] == symbols[other[0]]:
                at = self._every_second(at, other)
                other = following[at]
            after = following[other]
            symbols[at] = self.vocabulary.merged[rank]
            symbols[other] = -1
            following[at] = after
            inside = after >= 0
            previous[after[inside]] = at[inside]
            before = previous[at]
            self._add(np.unique(np.concatenate([before[before >= 0], at[inside]])))

    @staticmethod
    def _every_second(at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Of pairs that overlap, as in a run of one symbol, each second one from the left."""
        starts = np.append(True, at[1:] != other[:-1])
        number = np.arange(len(at))
        return at[(number - np.maximum.accumulate(np.where(starts, number, 0))) % 2 == 0]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words on end, and how many each word has."""
        alive = self.symbols >= 0
        total = np.append(0, np.cumsum(alive))
        return self.symbols[alive], total[self.ends] - total[self.ends - self.lengths]


class Encoder:
    """Encodes texts; the ids of recent words are kept."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.forget()

    def forget(self) -> None:
        """Drop all words: a worker that goes on to other work holds no more than the vocabulary."""
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        special = self.vocabulary.special
        ordinary = [w for w in words if w not in special]
        marks = [w for w in words if w in special]
        ids, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if ordinary:
            index = PairIndex(self.vocabulary, ordinary)
            index.merge_all()
            ids, counts = index.result()
        ids = np.append(ids, [special[w] for w in marks]).astype(np.int32)
        counts = np.append(counts, np.ones(len(marks), dtype=np.int64)).astype(np.int64)
        known = len(self.number)
        self.number.update((w, known + i) for i, w in enumerate(ordinary + marks))
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.starts = np.append(self.starts, starts)
        self.counts = np.append(self.counts, counts)
        self.ids = np.append(self.ids, ids)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each text has."""
        pieces = [self.vocabulary.words(t) for t in texts]
        if len(self.number) > CACHE_WORDS:
            self.forget()
        fresh = set().union(*pieces).difference(self.number)
        if fresh:
            self._learn(sorted(fresh))
        get = self.number.__getitem__
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        word = np.fromiter(
            (i for p in pieces for i in map(get, p)), dtype=np.int64, count=int(sizes.sum())
        )
        counts = self.counts[word]
        upto = np.cumsum(counts)
        total = int(upto[-1]) if len(upto) else 0
        at = np.arange(total) + np.repeat(self.starts[word] - (upto - counts), counts)
        bounds = np.append(0, upto)[np.append(0, np.cumsum(sizes))]
        return self.ids[at], np.diff(bounds)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def decode_ids(vocabulary: Vocabulary, ids: Sequence[int]) -> str:
    """The text of ids as a file without a decoder gives it: tokens joined by spaces."""
    return " ".join(map(vocabulary.tokens.__getitem__, ids))


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about BLOCK_CHARS characters; a longer text is a block of its own."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > BLOCK_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, with_decoded: bool = False) -> DataFrame:
    """Token ids of every whole text: doc_id, ids (array<int>), and decoded if asked for.

    Equals the tokenizers library with `add_special_tokens=False`; strings of special tokens
    in a text become these tokens. A null or empty text has no ids and decodes to an empty text.
    Repeated rows are encoded each; other columns are ignored; an empty table gives no rows.
    A word is encoded once per block of texts, whatever number of texts have it. The file at
    `path` lies on every machine.
    """
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
    if with_decoded:
        fields.append(("decoded", pa.string()))
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, end in _blocks(texts):
                ids, counts = coder.encode(texts[start:end])
                offsets = pa.array(np.append(0, np.cumsum(counts)), type=pa.int32())
                columns = [
                    batch.column("doc_id").slice(start, end - start),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, type=pa.int32())),
                ]
                if with_decoded:
                    ends = np.cumsum(counts).tolist()
                    columns.append(
                        pa.array(
                            [
                                decode_ids(coder.vocabulary, ids[a:b].tolist())
                                for a, b in zip([0, *ends], ends)
                            ],
                            type=pa.string(),
                        )
                    )
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        coder.forget()

    schema = "doc_id bigint, ids array<int>" + (", decoded string" if with_decoded else "")
    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    return map_arrow(rows, run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """The text of each row's `ids`: doc_id, decoded. Null ids give an empty text."""
    arrow = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            texts = [decode_ids(vocabulary, ids or []) for ids in batch.column("ids").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(texts, type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return map_arrow(rows.select("doc_id", "ids"), run, "doc_id bigint, decoded string")
