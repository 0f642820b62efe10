"""Jaccard self-join of shingle sets with token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import map_arrow, slices, stored
from tallybrook.llm.components import smallest_reachable

SHINGLE = 3
#: Hundredths of the union that two sets must share.
PERCENT = 90

#: Classes of tokens by the number of sets that have them: up to the first bound a token is
#: indexed by itself, up to the second in combinations of two, beyond in combinations of three.
CLASSES = (20, 400)
#: Tokens of a prefix up to which combinations of two and of three are made; longer prefixes
#: would have too many combinations and index single tokens instead.
PAIR_PREFIX, TRIPLE_PREFIX = 64, 16
#: Sets of a size share a key only with sets up to this factor larger, a bit over 100 / PERCENT.
SIZE_STEP = 1.12
#: Below this size a link may not share enough tokens for a combination.
LEAST_COMBINED = 10

#: In a first pass over all sets, tokens whose last bits are 0 come first in the order of tokens, by
#: frequency, and only they are counted: a prefix is a tenth of a set and seldom reaches beyond a
#: quarter of its tokens. Sets that share no signature have no link. The others, as a rule few,
#: are then ordered by the frequency of all their tokens.
COUNTED_BITS = 3
#: In place of a frequency, that of a token beyond these. It is indexed by itself.
UNCOUNTED = 1 << 62

#: Sets of one token that are held until all are counted; tokens of more are equally frequent.
HELD_SETS = 1_000_000
#: Members of a bucket that are compared with all others in one round.
ROUND_HUBS = 1024
#: Members that one task compares with a hub.
TASK_MEMBERS = 2_000
#: Candidate sets whose ids may be broadcast; more are joined by a shuffle.
BROADCAST_SETS = 1_000_000
#: Bytes that are hashed at a time, and the length of words from which they are hashed one by one.
PIECE_BYTES = 1 << 16
LONG_WORD = 64
#: Bytes of texts whose words are found at a time, or one longer text.
GROUP_BYTES = 1 << 22
#: Longs of a set's sketch. Its bits are the parities of the tokens that fall on them, so sketches
#: differ in no more bits than sets in tokens.
SKETCH_LONGS = 8

_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64
)
_MIX = np.uint64(0xFF51AFD7ED558CCD)

SIGNATURES = "sig bigint, node bigint, n bigint, alone bigint"


def _powers(base: int) -> np.ndarray:
    """The powers of a number modulo 2 ** 64, one for each byte of a piece and a word beyond."""
    bases = np.full(PIECE_BYTES + LONG_WORD + 1, base % (1 << 64), dtype=np.uint64)
    bases[0] = 1
    return np.multiply.accumulate(bases)


#: A word's hash is that of the sum of its bytes' codes, each times the power of its place.
_BASE = 0x9FB21C651E98DF2B
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_CODES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)
_IN_WORD = np.array([not bytes([b]).isspace() for b in range(256)])


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in data, and their hashes. Data starts with white space and ends with
    more of it than a word of LONG_WORD bytes is long."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = _IN_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    hashes = np.zeros(len(starts), dtype=np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(raw) + PIECE_BYTES, PIECE_BYTES))
    for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
        if i == j:
            continue
        low = int(starts[i])
        at = np.empty(2 * (j - i), dtype=np.int64)
        at[::2] = starts[i:j] - low
        at[1::2] = np.minimum(ends[i:j] - low, at[::2] + LONG_WORD)
        values = _CODES[raw[low : low + int(at[-1]) + 1]]
        values *= _UP[: len(values)]
        hashes[i:j] = np.add.reduceat(values, at)[::2] * _DOWN[at[::2]]
    hashes = _mixed(hashes + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]])
    return starts, hashes


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles.

    Letters A to Z are lowered; words are runs without white space. A text with fewer words than
    a shingle has one for all its words, a text without words has none.
    """
    sets, held, size = [], [], 0
    for text in texts:
        held.append((text or "").encode("utf-8"))
        size += len(held[-1])
        if size >= GROUP_BYTES:
            sets += _sets_of(held)
            held, size = [], 0
    return sets + _sets_of(held)


def _sets_of(encoded: list[bytes]) -> list[np.ndarray]:
    starts, hashes = _words(b" " + b" ".join(encoded).lower() + b" " * (LONG_WORD + 1))
    lengths = np.array([len(e) + 1 for e in encoded], dtype=np.int64)
    cuts = np.append(np.searchsorted(starts, np.cumsum(lengths) - lengths), len(starts))
    whole = _joined(hashes, SHINGLE)
    sets = []
    for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
        if j - i >= SHINGLE:
            own = np.sort(whole[i : j - SHINGLE + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            sets.append(_joined(hashes[i:j], j - i))
    return sets


def shingles(text: str | None) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text])[0]


def _joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hashes of all runs of so many words."""
    n = len(hashes) - width + 1
    if not width or n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        total += hashes[i : i + n] * _FACTORS[i]
    return _mixed(total)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(33))) * _MIX
    return value ^ (value >> np.uint64(29))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _digest(own: np.ndarray, seed: int) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a set."""
    raw = xxhash.xxh3_128_digest(own.tobytes(), seed)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(
        raw[8:], "little", signed=True
    )


def signed_rows(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, n_shingles, node and check of every row: node and check stand for its set."""
    arrow = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_shingles", "node", "check")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            node, check = zip(*[_digest(own, seed) for own in sets])
            columns = [batch.column("doc_id"), pa.array([len(own) for own in sets])]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(node), pa.array(check)], schema=arrow
            )

    rows = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    return map_arrow(rows, run, "doc_id bigint, n_shingles bigint, node bigint, check bigint")


def counted(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens & tokens.dtype.type(bits)) == 0


def indexed_tokens(own: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """The tokens of a set that may lie in its prefix, and how many of them are counted."""
    first = counted(own, bits)
    number = int(first.sum())
    # two more than the prefix of single tokens, for combinations of three
    missing = len(own) + (-PERCENT * len(own) // 100) + 3 - number
    if missing <= 0:
        return own[first], number
    rest = own[~first].view(np.int64)
    return np.append(own[first], np.sort(rest)[:missing].view(np.uint64)), number


def _token_batches(sets: list[np.ndarray], nodes: list[int], bits: int) -> pa.RecordBatch:
    """Rows (token, node, sizes) of some sets. sizes holds the size of the set and, in its lower
    half, how many counted tokens it has."""
    found = [indexed_tokens(own, bits) for own in sets]
    count = np.array([len(tokens) for tokens, _ in found])
    sizes = np.array([(len(own) << 32) + k for own, (_, k) in zip(sets, found)], dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            _signed(np.concatenate([tokens for tokens, _ in found])),
            pa.array(np.repeat(np.array(nodes, dtype=np.int64), count)),
            pa.array(np.repeat(sizes, count)),
        ],
        names=["token", "node", "sizes"],
    )


TOKENS = "token bigint, node bigint, sizes bigint"


def _token_rows(docs: DataFrame, seed: int) -> DataFrame:
    """Tokens of the sets of all texts; equal sets of one task come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            sets, nodes = [], []
            for own in shingle_sets(batch.column("text").to_pylist()):
                node = _digest(own, seed)[0]
                if len(own) and node not in seen:
                    seen.add(node)
                    sets.append(own)
                    nodes.append(node)
            if sets:
                yield _token_batches(sets, nodes, COUNTED_BITS)

    return map_arrow(docs.select("text"), run, TOKENS)


def _tokens_of(sets: DataFrame) -> DataFrame:
    """All tokens of stored sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in batch.column("own")]
            if own:
                yield _token_batches(own, batch.column("node").to_pylist(), 0)

    return map_arrow(sets, run, TOKENS)


def _starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, values[1:] != values[:-1]))


def _frequencies(
    batches: Iterator[pa.RecordBatch], most: int, bits: int
) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, node), each once, plus how many sets have the token; counted tokens
    of one set are left out. A token of more than `most` sets passes without being held."""
    arrow = pa.schema(
        [(c, pa.int64()) for c in ("node", "df", "token", "sizes")]
    )

    def rows(token, node, sizes, df) -> Iterator[pa.RecordBatch]:
        df = np.where(counted(token, bits), df, UNCOUNTED)
        out = df > 1
        if out.any():
            columns = [pa.array(c[out]) for c in (node, df, token, sizes)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    held = [np.zeros(0, dtype=np.int64)] * 3
    frequent, latest = None, None
    for batch in batches:
        token, node, size = (
            np.concatenate([h, batch.column(c).to_numpy()])
            for h, c in zip(held, ("token", "node", "sizes"))
        )
        if not len(token):
            continue
        new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        if latest is not None and (token[0], node[0]) == latest:
            new &= ~((token == latest[0]) & (node == latest[1]))
        token, node, size = token[new], node[new], size[new]
        if not len(token):
            held = [token, node, size]
            continue
        starts = _starts(token)
        runs = np.diff(np.append(starts, len(token)))
        df = runs.copy()
        if frequent is not None and token[0] == frequent:
            df[0] = most + 1
        full = len(token) if df[-1] > most else int(starts[-1])
        if full == len(token):
            frequent, latest = token[-1], (token[-1], node[-1])
        df = np.repeat(np.minimum(df, most + 1), runs)
        yield from rows(token[:full], node[:full], size[:full], df[:full])
        held = [token[full:], node[full:], size[full:]]
    if len(held[0]):
        yield from rows(*held, np.full(len(held[0]), len(held[0])))


def size_class(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(SIZE_STEP)))


def most_combined(key_class: int) -> int:
    """Tokens of a combination under a size class key, which sets of this class and the one below
    share: the same for all of them, so that both sides of a link index the same."""
    if SIZE_STEP ** (key_class - 1) < LEAST_COMBINED:
        return 1
    longest = SIZE_STEP ** (key_class + 1) * (100 - PERCENT) / 100 + 3
    return 3 if longest <= TRIPLE_PREFIX else 2 if longest <= PAIR_PREFIX else 1


def signatures(
    tokens: np.ndarray,
    df: np.ndarray,
    n: int,
    counted: int,
    classes: tuple[int, int] = CLASSES,
) -> np.ndarray:
    """What a set of `n` tokens, of them `counted` ones that are counted, is indexed under.

    `tokens` are those that come after the counted ones that no other set has, rarest first.

    With o = 90 % of n, any partner shares o tokens. Of n - o + k tokens in the order of
    frequency, linked sets share k, and the first shared one lies among the n - o + 1 first. If
    it is rare, both index it alone. If its class takes combinations of k, all later ones are as
    frequent, and both index the combination of the first k they share.
    """
    need = -(-PERCENT * n // 100)
    beyond = df == UNCOUNTED
    alone = counted - int(len(df) - beyond.sum())
    first = n - need + 1 - alone
    if first <= 0:
        return np.zeros(0, dtype=np.uint64)
    rare = (df[:first] <= classes[0]) | beyond[:first]
    found = [_mixed(tokens[:first][rare])]
    own = size_class(n)
    for key in (own, own + 1):
        most = most_combined(key)
        salt = np.uint64((key + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for i in np.flatnonzero(~rare).tolist():
            k = min(most, 2 if df[i] <= classes[1] else 3)
            base = _mixed(tokens[i : i + 1] ^ salt) + np.uint64(k)
            rest = tokens[i + 1 : first + k - 1]
            if k == 1:
                found.append(base)
            elif k == 2:
                found.append(_mixed(base * _FACTORS[1] + rest))
            else:
                two = np.array(list(combinations(range(len(rest)), 2)), dtype=np.int64)
                if len(two):
                    step = _mixed(base * _FACTORS[1] + rest[two[:, 0]])
                    found.append(_mixed(step * _FACTORS[2] + rest[two[:, 1]]))
    return np.unique(np.concatenate(found))


def _signature_rows(classes: tuple[int, int]):
    """Turns rows sorted by (node, df, token) into rows (sig, node, n, alone)."""
    arrow = pa.schema(
        [("sig", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("alone", pa.int64())]
    )

    def of(node, df, token, sizes) -> Iterator[pa.RecordBatch]:
        new = np.append(True, (node[1:] != node[:-1]) | (token[1:] != token[:-1]))
        node, df, token, sizes = node[new], df[new], token[new], sizes[new]
        starts = _starts(node)
        total, number = sizes[starts] >> 32, sizes[starts] & 0xFFFFFFFF
        alone = number - np.add.reduceat((df != UNCOUNTED).astype(np.int64), starts)
        ends = np.append(starts[1:], len(node))
        found, owner = [], []
        for i in np.flatnonzero(total + (-PERCENT * total // 100) + 1 > alone).tolist():
            own = slice(starts[i], ends[i])
            sig = signatures(
                token[own].view(np.uint64), df[own], int(total[i]), int(number[i]), classes
            )
            found.append(sig)
            owner.append(np.full(len(sig), i))
        if found:
            at = np.concatenate(owner)
            columns = [_signed(np.concatenate(found))]
            columns += [pa.array(c[at]) for c in (node[starts], total, alone)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("node", "df", "token", "sizes")]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            # the last set may go on in the next batch
            cut = int(_starts(columns[0])[-1]) if len(columns[0]) else 0
            if cut:
                yield from of(*[c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
        if held is not None and len(held[0]):
            yield from of(*held)

    return run


def _sets(docs: DataFrame, seed: int, wanted: DataFrame) -> DataFrame:
    """node and its set as bytes, once for each wanted (node, doc_id).

    Only texts of the ids named are read, of any id where too many are named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            sets = {}
            for own in shingle_sets(batch.column("text").to_pylist()):
                node = _digest(own, seed)[0]
                if len(own) and node not in seen:
                    seen.add(node)
                    sets[node] = own.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets.keys(), type=pa.int64()), pa.array(sets.values(), type=pa.binary())],
                names=["node", "own"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text")
    ids = wanted.select(F.col("doc_id").alias("_wanted")).distinct()
    wanted = wanted.select("node")
    if wanted.count() <= BROADCAST_SETS:
        wanted = F.broadcast(wanted)
        named = F.col("_id").eqNullSafe(F.col("_wanted"))
        texts = texts.join(F.broadcast(ids), named, "left_semi")
    found = map_arrow(texts.select("text"), run, "node bigint, own binary")
    return found.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("own").alias("own"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt, node), the hub's own first: each member as (a, b, near, far),
    near if it links to the hub a, far its Jaccard distance."""
    arrow = pa.schema(
        [("a", pa.int64()), ("b", pa.int64()), ("near", pa.bool_()), ("far", pa.float64())]
    )
    hub, own = None, None
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            hubs = batch.column("hub").to_numpy()
            member = batch.column("member").to_numpy(zero_copy_only=False).astype(bool)
            nodes = batch.column("node").to_numpy()
            sets = batch.column("own")
            found = []
            heads = np.flatnonzero(~member)
            edges = np.unique(np.concatenate([[0], heads, heads + 1, [len(hubs)]]))
            for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
                if not member[lo]:
                    hub, own = hubs[lo], np.frombuffer(sets[lo].as_py(), dtype=np.uint64)
                    continue
                if hubs[lo] != hub:
                    raise ValueError("members without their hub")
                others = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in sets.slice(lo, hi - lo)]
                sizes = np.array([len(o) for o in others])
                tokens = np.concatenate(others)
                at = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
                common = np.add.reduceat(own[at] == tokens, np.cumsum(sizes) - sizes)
                union = len(own) + sizes - common
                found.append(
                    (
                        np.full(hi - lo, hub),
                        nodes[lo:hi],
                        100 * common >= PERCENT * union,
                        1 - common / union,
                    )
                )
            if found:
                columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (hub, node) as (a, b, near, far). Members of a hub are dealt to tasks of at most
    about TASK_MEMBERS, each of which gets the hub's set."""
    count = pairs.groupBy(F.col("hub").alias("_hub")).agg(F.count(F.lit(1)).alias("_m"))
    large = count.where(F.col("_m") > TASK_MEMBERS)
    salts = F.coalesce(F.ceil(F.col("_m") / TASK_MEMBERS), F.lit(1))
    salted = pairs.join(large, F.col("hub") == F.col("_hub"), "left").select(
        "hub", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), "node"
    )
    members = salted.join(sets, "node").select("hub", "salt", F.lit(True).alias("member"), "node", "own")
    hubs = salted.select("hub", "salt").distinct().join(
        sets.withColumnRenamed("node", "hub"), "hub"
    )
    rows = members.unionByName(
        hubs.select("hub", "salt", F.lit(False).alias("member"), F.col("hub").alias("node"), "own")
    )
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    return map_arrow(dealt, _linked, "a bigint, b bigint, near boolean, far double")


def _may_link() -> Column:
    """Whether a member and a hub can share enough: at most all but their tokens of their own."""
    common = F.least(F.col("n") - F.col("alone"), F.col("hub_n") - F.col("hub_alone"))
    return 100 * common >= PERCENT * (F.col("n") + F.col("hub_n") - common)


SKETCH = [f"_sketch{i}" for i in range(SKETCH_LONGS)]


def sketch(own: np.ndarray) -> np.ndarray:
    """The parities of a set's tokens, dealt by their upper bits."""
    places = (own >> np.uint64(32)) % np.uint64(64 * SKETCH_LONGS)
    odd = np.bincount(places.view(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [sketch(np.frombuffer(s.as_py(), dtype=np.uint64)) for s in batch.column("own")]
            if own:
                longs = [pa.array(column) for column in np.stack(own, axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), *longs], names=["node", *SKETCH]
                )

    return map_arrow(sets, run, ", ".join(["node bigint", *(f"{c} bigint" for c in SKETCH)]))


def _sketches_near() -> Column:
    """Whether a member's and a hub's sketch differ in no more bits than linked sets do in tokens:
    with common tokens >= PERCENT / (100 + PERCENT) of both sizes, the others are so many."""
    bits = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub{c}"))) for c in SKETCH)
    return (100 + PERCENT) * bits <= (100 - PERCENT) * (F.col("n") + F.col("hub_n"))


def _distinct_buckets(sigs: DataFrame) -> DataFrame:
    """The rows of one bucket among those with the same members: near copies share many
    signatures, and each pair is to come from few of them."""
    wide = "decimal(38,0)"
    buckets = sigs.groupBy("sig").agg(
        F.count(F.lit(1)).alias("m"),
        F.sum(F.xxhash64("node").cast(wide)).alias("s"),
        F.sum(F.xxhash64(F.lit("again"), "node").cast(wide)).alias("t"),
    )
    first = buckets.where("m > 1").groupBy("m", "s", "t").agg(F.min("sig").alias("sig"))
    return sigs.join(first.select("sig"), "sig", "left_semi")


def set_links(sigs: DataFrame, sets: DataFrame, hubs_per_round: int = ROUND_HUBS) -> DataFrame:
    """Links a, b that connect all sets in common buckets with the similarity asked for.

    Of each bucket, the member with the fewest tokens of its own is compared with all others; in
    a group of near copies most are linked then. By the triangle inequality, members whose distances
    from it differ by over a tenth cannot link. Later rounds compare, in buckets whose members
    are not all connected, those outside the largest connected part with all members of other
    parts, some per bucket and round. Only pairs whose sketches are as near as those of linked sets
    leave the join, so a group of near copies that do not link makes few. A member compared leaves its buckets. Rounds end when every
    bucket is connected or used up, so pairs that stay uncompared are connected already.
    """
    sigs = stored(_distinct_buckets(sigs), "join-buckets")
    order = F.struct("alone", "node", "n")
    hubs = sigs.groupBy("sig").agg(F.min(order).alias("h"), F.count(F.lit(1)).alias("m"))
    hubs = hubs.where("m > 1").select(
        "sig",
        F.col("h.node").alias("hub"),
        F.col("h.n").alias("hub_n"),
        F.col("h.alone").alias("hub_alone"),
    )
    hubs = stored(hubs, "join-hubs")
    open_sigs = stored(sigs.join(hubs.select("sig"), "sig", "left_semi"), "join-sigs")
    pairs = open_sigs.join(hubs, "sig").where(
        (F.col("node") != F.col("hub")) & _may_link()
    )
    pairs = stored(pairs.select("hub", "node").distinct(), "join-pairs")
    first = stored(_verified(pairs, sets), "join-links")
    links = first.where("near").select("a", "b")
    parts, compared = _parts(links), pairs
    # how far each member is from the first hub of its bucket: Jaccard distance is a metric
    away = first.select(F.col("a").alias("hub"), F.col("b").alias("node"), "far")
    away = open_sigs.join(hubs.select("sig", "hub"), "sig").join(away, ["hub", "node"], "left")
    open_sigs = stored(away.drop("hub"), "join-sigs")
    apart = F.abs(F.col("far") - F.col("hub_far"))
    near_enough = F.coalesce(apart <= 1 - PERCENT / 100 + 1e-9, F.lit(True))
    while True:
        left = open_sigs.join(
            hubs.select("sig", F.col("hub").alias("node")), ["sig", "node"], "left_anti"
        )
        placed = left.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
        spread = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        spread = spread.where("lo != hi").select("sig")
        open_sigs = stored(placed.join(spread, "sig", "left_semi"), "join-sigs")
        if open_sigs.isEmpty():
            return links
        if SKETCH[0] not in open_sigs.columns:
            open_sigs = stored(open_sigs.join(_sketches(sets), "node"), "join-sigs")
        largest = (
            open_sigs.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("m"))
            .groupBy("sig").agg(F.max(F.struct("m", "root")).alias("most"))
            .select("sig", F.col("most.root").alias("_largest"))
        )
        outside = open_sigs.join(largest, "sig").where(F.col("root") != F.col("_largest"))
        some = Window.partitionBy("sig").orderBy("alone", "node")
        hubs = outside.withColumn("_i", F.row_number().over(some)).where(
            F.col("_i") <= hubs_per_round
        )
        hubs = stored(
            hubs.select(
                "sig",
                F.col("node").alias("hub"),
                F.col("n").alias("hub_n"),
                F.col("alone").alias("hub_alone"),
                F.col("far").alias("hub_far"),
                F.col("root").alias("hub_root"),
                *[F.col(c).alias(f"hub{c}") for c in SKETCH],
            ),
            "join-hubs",
        )
        pairs = open_sigs.join(hubs, "sig").where(
            (F.col("root") != F.col("hub_root")) & _may_link() & near_enough & _sketches_near()
        )
        pairs = pairs.select("hub", "node").distinct()
        pairs = stored(pairs.join(compared, ["hub", "node"], "left_anti"), "join-pairs")
        compared = compared.union(pairs)
        more = stored(_verified(pairs, sets), "join-links").where("near").select("a", "b")
        if not more.isEmpty():
            links = links.union(more)
            parts = _parts(links)
        open_sigs = open_sigs.drop("root")


def _parts(links: DataFrame) -> DataFrame:
    """node and root, the smallest node it is connected with, of all nodes with links."""
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    parts = smallest_reachable(links, nodes.withColumn("number", F.col("node")), "node", "number")
    return stored(parts.select("node", "root"), "join-parts")


def _shared_signatures(
    tokens: DataFrame, classes: tuple[int, int], held_sets: int, bits: int
) -> DataFrame:
    """Rows (sig, node, n, alone) of all signatures that several sets have, stored."""
    known = map_arrow(
        tokens.repartition("token").sortWithinPartitions("token", "node"),
        lambda batches: _frequencies(batches, held_sets, bits),
        "node bigint, df bigint, token bigint, sizes bigint",
    )
    dealt = known.repartition("node").sortWithinPartitions("node", "df", "token")
    sigs = stored(map_arrow(dealt, _signature_rows(classes), SIGNATURES), "join-signatures")
    several = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return stored(sigs.join(several.select("sig"), "sig", "left_semi"), "join-shared")


def jaccard_components(
    docs: DataFrame,
    hubs_per_round: int = ROUND_HUBS,
    classes: tuple[int, int] = CLASSES,
    held_sets: int = HELD_SETS,
) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of (doc_id, text).

    Rows link when their sets share PERCENT hundredths of their union. component_id is the
    smallest doc_id reachable over links, null only if all ids there are null. A null text or one
    without words has an empty set and is linked with nothing: its component is its own id. Equal
    sets are one node whatever their number; repeated rows share it; other columns are ignored;
    an empty table gives no rows.

    Tokens are counted over all sets, and of those counted only the ones of two sets or more go on. Sets are read
    from the texts once more for nodes that share a bucket with another, so that texts are never
    shuffled or stored. Nodes are 64-bit digests; if two sets ever share one, others are drawn.
    """
    seed = 0
    while True:
        rows = stored(signed_rows(docs, seed), "join-rows")
        shared = rows.groupBy("node").agg(
            F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("doc_id").alias("doc_id"),
            F.min("n_shingles").alias("n"),
        )
        nodes = stored(shared.where("n > 0 OR lo != hi"), "join-nodes")
        if nodes.where("lo != hi").isEmpty():
            break
        seed += 1
    found = _shared_signatures(_token_rows(docs, seed), classes, held_sets, COUNTED_BITS)
    wanted = stored(found.select("node").distinct().join(nodes, "node"), "join-wanted")
    sets = stored(_sets(docs, seed, wanted.select("node", "doc_id")), "join-sets")
    sigs = _shared_signatures(_tokens_of(sets), classes, held_sets, 0)
    links = set_links(sigs, sets, hubs_per_round)
    found = smallest_reachable(links, nodes.select("node", "doc_id"), "node", "doc_id")
    some = rows.where("n_shingles > 0").join(found.select("node", "component_id"), "node")
    return some.select("doc_id", "n_shingles", "component_id").unionByName(
        rows.where("n_shingles = 0").select(
            "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
        )
    )
