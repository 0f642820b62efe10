"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import (
    HASH_BITS,
    bucket_bits,
    let,
    md5_key,
    running_sum,
    stored,
    words,
)

WEIGHTS = (5.0, 2.0, 1.0)
#: Words in the mix over words in all sources, and the most copies of a document.
TOTAL_SHARE = 1.5
MAX_COPIES = 2
#: Passes that fill what the document at the cut leaves open with shorter ones.
FILLS = 3
#: Words of a block, about, and levels of the splitting tree: 2 ** LEVELS output shards.
BLOCK_WORDS = 20_000
LEVELS = 4
#: Standard deviations around the mean that a hypergeometric draw can reach.
REACH = 12


def units(docs: DataFrame) -> DataFrame:
    """Distinct rows (doc_id, source, size, perm) and `copies`, how often each stands in docs.

    `perm` is a hash of id and text that puts the documents of a source in random order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    rows = docs.select(
        "doc_id",
        "source",
        F.size(words(F.col("text"))).cast("bigint").alias("size"),
        md5_key(name).alias("perm"),
    )
    return rows.groupBy("doc_id", "source", "size", "perm").agg(F.count(F.lit(1)).alias("copies"))


def targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """source, source_size and target words per source.

    Sources by code point, null last, take the weights in turn. Their shares of the total rise
    with a common level until a source has MAX_COPIES times its size; the rest goes on. The
    level is found from running sums over the sources in the order in which they fill up.
    """
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(listed, F.pmod(F.col("place"), F.lit(len(weights))))
    )
    cap = F.lit(float(MAX_COPIES)) * F.col("source_size")
    order = [F.col("full_at"), F.col("place")]
    filled = (
        ranked.withColumn("cap", cap)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn(
            "level",
            (
                F.sum("source_size").over(Window.partitionBy()) * F.lit(TOTAL_SHARE)
                - F.coalesce(
                    F.sum("cap").over(
                        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
                    ),
                    F.lit(0.0),
                )
            )
            / F.sum("weight").over(
                Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
            ),
        )
    )
    first = Window.partitionBy()
    level = F.min(
        F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "place", "level"))
    ).over(first)["level"]
    return filled.withColumn("common", level).select(
        "source",
        "place",
        "source_size",
        F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("common")), F.col("cap")).alias(
            "target"
        ),
    )


def _same_source(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """rows joined with a table of one row per source."""
    right = per_source.withColumnRenamed("source", "_source")
    return rows.join(right, _same_source(F.col("source"), F.col("_source"))).drop("_source")


def selected(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows plus `taken`, the copies of each unit in the mix.

    Every unit gets the whole copies that the target holds of its source. For the rest, units
    in hash order are taken while their words fit; then shorter ones that still fit; and in the
    end the shortest one left, if that brings the words closer to the target.
    """
    whole = F.when(
        F.col("source_size") > 0,
        F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_COPIES)),
    ).otherwise(F.lit(0))
    per_source = goals.select(
        "source",
        whole.cast("int").alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("rest"),
    )
    state = _with_source(rows, per_source).withColumn("words", F.col("size") * F.col("copies"))
    bits = bucket_bits(rows.count())
    state = state.withColumn("extra", F.lit(0))
    for _ in range(1 + FILLS):
        may = (F.col("extra") == 0) & (F.col("words") > 0) & (F.col("words") <= F.col("rest"))
        open_, shut = state.where(may), state.where(~may)
        counted = running_sum(open_, ["source"], "perm", ["doc_id", "size"], "words", bits)
        fits = F.col("before") + F.col("words") <= F.col("rest")
        chosen = counted.withColumn("extra", F.when(fits, 1).otherwise(0)).drop("before")
        state = stored(chosen.unionByName(shut), "mix-state")
        used = state.groupBy("source").agg(
            F.sum(F.when(F.col("extra") == 1, F.col("words")).otherwise(0)).alias("used")
        )
        left = used.join(
            goals.select(F.col("source").alias("_s"), "target", "source_size"),
            _same_source(F.col("source"), F.col("_s")),
        )
        left = left.select(
            "source", (F.col("target") - whole * F.col("source_size") - F.col("used")).alias("rest")
        )
        state = _with_source(state.drop("rest"), left)
    key = F.struct("words", "perm", F.col("doc_id").isNull().alias("null"), "doc_id")
    close = state.where(
        (F.col("extra") == 0) & (F.col("words") > 0) & (F.col("words") < F.col("rest") * 2)
    )
    shortest = close.groupBy("source").agg(F.min(key).alias("_shortest"))
    state = state.join(
        shortest.withColumnRenamed("source", "_source"),
        _same_source(F.col("source"), F.col("_source")),
        "left",
    )
    last = F.when(key.eqNullSafe(F.col("_shortest")), 1).otherwise(F.col("extra"))
    return state.withColumn("taken", F.col("whole") + last).select(*rows.columns, "taken")


def _uniform(*parts: Column) -> Column:
    """A fixed number between 0 and 1 for these values."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 12)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `marked` among `total` items are among `drawn` items, by inversion.

    Logarithms of neighbouring probabilities' ratios are summed over the range within REACH
    deviations of the mean, so that the range grows with the root of the numbers.
    """
    given = F.struct(
        total.cast("bigint").alias("total"),
        marked.cast("bigint").alias("marked"),
        drawn.cast("bigint").alias("drawn"),
        uniform.alias("uniform"),
    )
    # every value is bound once: as nested expressions they would be repeated in the plan
    return let(given, _within_reach)


def _within_reach(given: Column) -> Column:
    total, marked, drawn = given["total"], given["marked"], given["drawn"]
    share = marked / F.greatest(total, F.lit(1))

    def bounded(mean: Column) -> Column:
        reach = F.sqrt(F.greatest(mean * (F.lit(1.0) - share), F.lit(0.0))) * REACH
        return F.struct(
            F.greatest(F.lit(0), drawn - total + marked, F.floor(mean - reach)).alias("low"),
            F.least(marked, drawn, F.ceil(mean + reach)).alias("high"),
        )

    return let(let(drawn * share, bounded), lambda range_: _inverted(given, range_))


def _inverted(given: Column, range_: Column) -> Column:
    total, marked, drawn, uniform = (given[c] for c in ("total", "marked", "drawn", "uniform"))
    low, high = range_["low"], range_["high"]
    nothing = F.array().cast("array<bigint>")
    later = F.when(high > low, F.sequence(low + 1, high)).otherwise(nothing)

    def ratio(k: Column) -> Column:
        # of the probabilities of k and k - 1, in doubles: products of counts leave 64 bits
        up = (marked - k + 1).cast("double") * (drawn - k + 1)
        return F.log(up / (k.cast("double") * (total - marked - drawn + k)))

    def sums(top: Column, first, add) -> Column:
        """Folds the shares exp(log - top) of all k, the lowest included."""
        start = F.struct(F.lit(0.0).alias("log"), first(F.exp(-top)).alias("sum"))

        def step(state: Column, k: Column) -> Column:
            return let(
                state["log"] + ratio(k),
                lambda log: F.struct(
                    log.alias("log"), add(state["sum"], F.exp(log - top)).alias("sum")
                ),
            )

        return F.aggregate(later, start, step, lambda s: s["sum"])

    def invert(top: Column) -> Column:
        whole = sums(top, lambda x: x, lambda a, x: a + x)

        def below(whole: Column) -> Column:
            def count(upto: Column, share: Column, k: Column) -> Column:
                upto = upto + share
                more = F.when(upto < uniform * whole, 1).otherwise(0)
                return F.struct(upto.alias("upto"), (k + more).cast("bigint").alias("k"))

            return sums(
                top,
                lambda x: count(F.lit(0.0), x, F.lit(0)),
                lambda s, x: count(s["upto"], x, s["k"]),
            )["k"]

        return F.least(low + let(whole, below), high)

    # the largest logarithm, so that no share is lost to underflow
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("top"))

    def climb(state: Column, k: Column) -> Column:
        return let(
            state["log"] + ratio(k),
            lambda log: F.struct(log.alias("log"), F.greatest(state["top"], log).alias("top")),
        )

    return let(F.aggregate(later, zero, climb, lambda s: s["top"]), invert)


def _source_draw(seed: int, level: int):
    """The step of a node's draw: state and number of the next source to the next state."""

    def draw(state: Column, i: Column) -> Column:
        uniform = _uniform(F.lit(seed), F.lit(level), state["shard"], i)
        part = hypergeometric(state["total"], state["all"][i], state["open"], uniform)
        return let(
            part,
            lambda x: F.struct(
                state["all"].alias("all"),
                state["shard"].alias("shard"),
                (state["total"] - state["all"][i]).alias("total"),
                (state["open"] - x).alias("open"),
                F.concat(state["left"], F.array(x)).alias("left"),
            ),
        )

    return draw


def split_quotas(quotas: DataFrame, levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """shard and quotas (array<bigint>): one row with `quotas` cut into 2 ** levels shards.

    At each node of a binary tree the left child gets half of the node's blocks; how many of
    each source follows the multivariate hypergeometric law, drawn source by source from
    what is left. Every block goes to exactly one shard.
    """
    nodes = quotas.select(
        F.lit(0).alias("shard"), F.col("quotas").cast("array<bigint>").alias("quotas")
    )
    for level in range(levels):
        total = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda a, x: a + x)
        start = let(
            total,
            lambda t: F.struct(
                F.col("quotas").alias("all"),
                F.col("shard").alias("shard"),
                t.alias("total"),
                F.floor(t / 2).alias("open"),
                F.array().cast("array<bigint>").alias("left"),
            ),
        )
        each = F.when(
            F.size("quotas") > 0, F.sequence(F.lit(0), F.size("quotas") - 1)
        ).otherwise(F.array().cast("array<int>"))
        left = F.aggregate(each, start, _source_draw(seed, level), lambda s: s["left"])
        parted = nodes.withColumn("left", left)
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        children = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("quotas")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("quotas")),
        )
        nodes = stored(parted.select(F.inline(children)), "mix-nodes")
    return nodes


def shards_of_blocks(blocks: DataFrame, goals: DataFrame, levels: int, seed: int) -> DataFrame:
    """blocks (source, copy, block) plus `shard`.

    A source's blocks, permuted by a hash, are dealt out in the numbers the splitting tree
    gives each shard.
    """
    permuted = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "copy", "block"), 64 - HASH_BITS)
    keyed = blocks.withColumn("key", permuted).withColumn("one", F.lit(1))
    bits = bucket_bits(blocks.count())
    numbered = running_sum(keyed, ["source"], "key", ["copy", "block"], "one", bits)
    numbered = numbered.withColumn("number", F.col("before") + 1)
    per_source = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    placed = _with_source(goals.select("source", "place"), per_source)
    by_place = F.sort_array(F.collect_list(F.struct("place", "n", "source")))
    gathered = placed.agg(by_place.alias("all"))
    quotas = gathered.select(F.transform("all", lambda x: x["n"]).alias("quotas"))
    cells = split_quotas(quotas, levels, seed).select("shard", F.posexplode("quotas").alias("i", "quota"))
    named = gathered.select(F.posexplode("all").alias("i", "s")).select("i", "s.source")
    upto = Window.partitionBy("source").orderBy("shard")
    ranges = (
        cells.join(named, "i")
        .withColumn("end", F.sum("quota").over(upto))
        .select(F.col("source").alias("_source"), "shard", "quota", "end")
        .where("quota > 0")
    )
    mine = (
        _same_source(F.col("source"), F.col("_source"))
        & (F.col("number") <= F.col("end"))
        & (F.col("number") > F.col("end") - F.col("quota"))
    )
    return numbered.join(ranges, mine).select("source", "copy", "block", "shard")


def mix(docs: DataFrame, levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """Every unit of docs (doc_id, text, source) with its place in the mix.

    Returns doc_id, source, size (words), perm, copies (equal rows), source_size, target, and
    `drawn`, an array with the shard and the local order of each copy taken (none for units
    left out). Equal rows are one unit and share their fate. Null ids and sources are values
    like any other; a null text has no words; other columns are ignored; an empty table gives
    no rows. All numbers follow from the rows, so reruns agree.
    """
    rows = stored(units(docs), "mix-units")
    goals = stored(targets(rows), "mix-targets")
    chosen = selected(rows, goals)
    # blocks of about equal size: slices of the hash range, per source and copy
    slices = F.greatest(F.floor(F.col("source_size") / BLOCK_WORDS), F.lit(1))
    per_source = goals.select("source", "place", "source_size", "target", slices.alias("slices"))
    placed = stored(
        _with_source(chosen, per_source).withColumn(
            "block",
            F.floor(
                F.col("perm") / F.lit(float(1 << HASH_BITS)) * F.col("slices").cast("double")
            ),
        ),
        "mix-chosen",
    )
    copies = F.when(F.col("taken") > 0, F.sequence(F.lit(1), F.col("taken")))
    drawn = placed.withColumn("copy", F.explode_outer(copies))
    blocks = (
        drawn.where(F.col("copy").isNotNull()).groupBy("source", "copy", "block").count()
    )
    dealt = stored(
        shards_of_blocks(blocks.select("source", "copy", "block"), goals, levels, seed),
        "mix-blocks",
    ).select(
        F.col("source").alias("_source"),
        F.col("copy").alias("_copy"),
        F.col("block").alias("_block"),
        "shard",
    )
    at = (
        _same_source(F.col("source"), F.col("_source"))
        & (F.col("copy") == F.col("_copy"))
        & (F.col("block") == F.col("_block"))
    )
    found = drawn.join(dealt, at, "left").withColumn(
        "_draw",
        F.when(
            F.col("shard").isNotNull(),
            F.struct("shard", F.xxhash64(F.lit(seed), "copy", "perm").alias("order")),
        ),
    )
    keys = ["doc_id", "source", "size", "perm", "copies", "source_size", "target"]
    # nulls are left out of the list
    return found.groupBy(*keys).agg(F.sort_array(F.collect_list("_draw")).alias("drawn"))


def mixed_rows(docs: DataFrame, levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all columns as they were.

    Rows lie in partitions by output shard, in each shard's local order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    names = docs.columns
    keyed = docs.select(md5_key(name).alias("_perm"), "source", F.struct(*[F.col(f"`{name}`") for name in names]).alias("_row"))
    plan = mix(docs, levels, seed).where(F.size("drawn") > 0)
    plan = plan.select(F.col("perm").alias("_p"), F.col("source").alias("_source"), "drawn")
    same = (F.col("_perm") == F.col("_p")) & _same_source(F.col("source"), F.col("_source"))
    copies = keyed.join(plan, same).select("_row", F.explode("drawn").alias("_draw"))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        copies.repartitionByRange(max(least, 1 << levels), "_draw.shard", "_draw.order")
        .sortWithinPartitions("_draw.shard", "_draw.order")
        .select("_row.*")
    )
