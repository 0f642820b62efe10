"""Quality rules: text statistics, base rules and robust multivariate outliers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import let, stored, words

#: Words in a window whose repeats count, and the base rules.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Statistics are kept as whole thousandths, so that sums over them are exact in any order.
SCALE = 1000
COORDINATES = ("x1", "x2", "x3", "x4", "x5")
#: The smallest spread that counts as one, per coordinate, in thousandths: word length, symbols,
#: repeated lines, repeated words, capitals.
FLOORS = (50, 35, 100, 100, 60)

#: Share of a pool that the estimates are fitted to, and steps towards the smallest determinant.
COVERED = 0.75
STEPS = 5
#: Pools of (lang, source) with fewer rows are joined to their language's, then to a common one.
MIN_POOL = 60
#: Distances are compared in sixteenths of a spread, up to 256.
DISTANCE_STEP = 16
MAX_BIN = 4096
#: Chi-squared with 5 degrees of freedom at COVERED, and at a millionth from above.
CHI_COVERED = 6.6257
CHI_REJECT = 35.8882


def _repeat_words(tokens: Column) -> Column:
    """How many words lie in windows of words that occur twice or more in the text."""
    last = F.size(tokens) - WINDOW

    def at(i: Column, j: int) -> Column:
        return F.get(tokens, i + j)

    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)]))

    def exact(i: Column) -> Column:
        window = F.concat_ws(" ", *[at(i, j) for j in range(WINDOW)])
        return F.struct(window.alias("window"), i.alias("at"))

    def covered(ordered: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.get(ordered, a)["window"] == F.get(ordered, b)["window"]

        n = F.size(ordered)
        twice = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: ((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1)),
        )
        places = F.array_sort(F.transform(twice, lambda i: F.get(ordered, i)["at"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.sequence(F.lit(0), F.size(p) - 1),
                F.lit(0),
                lambda total, i: total
                + F.coalesce(F.least(F.get(p, i + 1) - F.get(p, i), F.lit(WINDOW)), F.lit(WINDOW)),
            ),
        )

    # hashes only tell which texts need the exact comparison
    repeated = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(
        repeated, let(F.array_sort(F.transform(starts, exact)), covered)
    ).otherwise(F.lit(0))


def _chars_of(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def with_statistics(docs: DataFrame, kept: Sequence[str]) -> DataFrame:
    """The `kept` columns, the statistics of the whole text, and the coordinates x1 to x5."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        *kept,
        let(
            words(F.col("text")),
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.aggregate(
                    w, F.lit(0).cast("bigint"), lambda n, one: n + F.length(one)
                ).alias("word_chars"),
                _repeat_words(w).cast("bigint").alias("n_repeat_words"),
            ),
        ).alias("_w"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")
            ),
        ).alias("_lines"),
        _chars_of(text, r"[#*$%&|<>]").alias("n_symbols"),
        _chars_of(text, r"\p{Lu}+").alias("n_capitals"),
    )
    flat = counted.select(
        *kept,
        F.col("_w.n_words").alias("n_words"),
        F.col("_w.word_chars").alias("word_chars"),
        "n_symbols",
        F.col("_lines.again").cast("bigint").alias("n_dup_lines"),
        F.col("_w.n_repeat_words").alias("n_repeat_words"),
        F.col("_lines.n").cast("bigint").alias("n_lines"),
        "n_capitals",
    )
    # shares with a few made-up ordinary words or lines added, so that short texts vary little
    ratios = [
        (F.col("word_chars") + 100) / (F.col("n_words") + 20),
        F.col("n_symbols") / (F.col("word_chars") + 200),
        F.col("n_dup_lines") / (F.col("n_lines") + 5),
        F.col("n_repeat_words") / (F.col("n_words") + 50),
        F.col("n_capitals") / (F.col("word_chars") + 200),
    ]
    return flat.withColumns(
        {
            x: F.floor(F.sqrt(ratio.cast("double")) * F.lit(float(SCALE)) + F.lit(0.5))
            for x, ratio in zip(COORDINATES, ratios)
        }
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT),
    )


def _pools(rows: DataFrame) -> DataFrame:
    """_lang, _source, pool: each language and source, or what it is joined to when small."""
    key = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    lang_key = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    by_both = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    wide = by_both.select(
        "lang",
        "source",
        "n",
        F.sum(F.when(F.col("n") < MIN_POOL, F.col("n")).otherwise(0))
        .over(Window.partitionBy("lang"))
        .alias("in_lang"),
    )
    return wide.select(
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.when(F.col("n") >= MIN_POOL, key)
        .when(F.col("in_lang") >= MIN_POOL, lang_key)
        .otherwise("all")
        .alias("pool"),
    )


def _with_pool(rows: DataFrame, pools: DataFrame) -> DataFrame:
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(pools, same).drop("_lang", "_source")


def _median(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The lower median of a whole-numbered column per key, from counts of its values."""
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys).orderBy(value)
    total = Window.partitionBy(*keys)
    ranked = counts.select(
        *keys, value, F.sum("n").over(upto).alias("upto"), F.sum("n").over(total).alias("all")
    )
    half = ranked.where(F.col("upto") * 2 >= F.col("all"))
    return half.groupBy(*keys).agg(F.min(value).alias("median"))


def _first_distances(vectors: DataFrame) -> DataFrame:
    """Three ways to start per row: start, x1 to x5 and bin, from medians and their deviations."""
    long = vectors.select(
        "pool",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("x")) for i, x in enumerate(COORDINATES)])
        ).alias("c"),
    ).select("pool", "c.i", "c.x")
    middle = _median(long, ["pool", "i"], "x")
    off = long.join(middle, ["pool", "i"]).withColumn("off", F.abs(F.col("x") - F.col("median")))
    spread = _median(off, ["pool", "i"], "off").withColumnRenamed("median", "mad")
    floors = F.array(*[F.lit(float(f)) for f in FLOORS])
    fitted = (
        middle.join(spread, ["pool", "i"])
        .withColumn(
            "scale",
            F.greatest(F.col("mad") * F.lit(1.4826), F.get(floors, F.col("i"))),
        )
        .groupBy("pool")
        .agg(F.sort_array(F.collect_list(F.struct("i", "median", "scale"))).alias("fit"))
    )
    z = [
        F.abs(F.col(x) - F.get("fit", F.lit(i))["median"]) / F.get("fit", F.lit(i))["scale"]
        for i, x in enumerate(COORDINATES)
    ]
    starts = [
        F.sqrt(reduce(lambda a, b: a + b, [v * v for v in z])),
        reduce(lambda a, b: a + b, z),
        F.greatest(*z),
    ]
    started = F.array(
        *[F.struct(F.lit(i).alias("start"), _bin(d).alias("bin")) for i, d in enumerate(starts)]
    )
    return (
        vectors.join(fitted, "pool")
        .select("pool", *COORDINATES, F.explode(started).alias("s"))
        .select("pool", "s.start", *COORDINATES, "s.bin")
    )


def _bin(distance: Column) -> Column:
    return F.least(F.floor(distance * DISTANCE_STEP), F.lit(MAX_BIN)).cast("int")


_PAIRS = [(i, j) for i in range(len(COORDINATES)) for j in range(i + 1)]


def _moments(binned: DataFrame) -> DataFrame:
    """Counts and sums of the COVERED nearest rows per pool and start.

    Rows are summed per distance bin first, so a hot pool is reduced where it is read; whole bins
    are taken until they hold the share.
    """
    sums = {f"s{i}": F.sum(x) for i, x in enumerate(COORDINATES)} | {
        f"q{i}{j}": F.sum(F.col(COORDINATES[i]) * F.col(COORDINATES[j])) for i, j in _PAIRS
    }
    per_bin = binned.groupBy("pool", "start", "bin").agg(
        F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()]
    )
    group = Window.partitionBy("pool", "start")
    before = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    near = per_bin.select(
        "*",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(group).alias("all"),
    ).where(F.col("before") < F.col("all") * F.lit(COVERED))
    return near.groupBy("pool", "start").agg(
        F.sum("n").cast("double").alias("n"),
        F.max("bin").alias("cut"),
        *[F.sum(k).cast("double").alias(k) for k in sums],
    )


def _estimates(moments: DataFrame) -> DataFrame:
    """Centre m, inverse p of the covariance with floors, and its determinant."""
    size = range(len(COORDINATES))
    rows = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in size})
    rows = rows.withColumns(
        {
            f"c{i}{j}": F.col(f"q{i}{j}") / F.col("n")
            - F.col(f"m{i}") * F.col(f"m{j}")
            + F.lit(float(FLOORS[i] ** 2 if i == j else 0))
            for i, j in _PAIRS
        }
    )
    # Cholesky factor l, column by column, then its inverse k
    for j in size:
        square = F.col(f"c{j}{j}")
        for k in range(j):
            square = square - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        rows = rows.withColumn(f"l{j}{j}", F.sqrt(square))
        below = {}
        for i in range(j + 1, len(COORDINATES)):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            below[f"l{i}{j}"] = rest / F.col(f"l{j}{j}")
        if below:
            rows = rows.withColumns(below)
    for i in size:
        inverse = {f"k{i}{i}": F.lit(1.0) / F.col(f"l{i}{i}")}
        for j in range(i):
            total = F.lit(0.0)
            for k in range(j, i):
                total = total - F.col(f"l{i}{k}") * F.col(f"k{k}{j}")
            inverse[f"k{i}{j}"] = total / F.col(f"l{i}{i}")
        rows = rows.withColumns(inverse)
    determinant = F.lit(1.0)
    for i in size:
        determinant = determinant * F.col(f"l{i}{i}")
    inverse = {}
    for i, j in _PAIRS:
        total = F.lit(0.0)
        for k in range(i, len(COORDINATES)):
            total = total + F.col(f"k{k}{i}") * F.col(f"k{k}{j}")
        inverse[f"p{i}{j}"] = total
    return rows.select(
        F.col("pool").alias("_pool"),
        "start",
        "cut",
        determinant.alias("determinant"),
        *[F.col(f"m{i}") for i in size],
        *[v.alias(k) for k, v in inverse.items()],
    )


def _squared_distance() -> Column:
    off = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(COORDINATES)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        twice = 1.0 if i == j else 2.0
        total = total + F.lit(twice) * F.col(f"p{i}{j}") * off[i] * off[j]
    return F.greatest(total, F.lit(0.0))


def _nearest(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    return rows.join(fitted, F.col("pool") == F.col("_pool"))


def covariance_estimates(vectors: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates per pool of rows (pool, x1 to x5).

    From three starts, steps refit centre and covariance to the nearest COVERED share, which
    never raises the determinant; the smallest of the three is kept. `cut` is the bin of the
    share's farthest distance. Every step reads the small vectors once and writes a row per
    pool and start; hot pools are summed before the shuffle.
    """
    fitted = stored(_estimates(_moments(_first_distances(vectors))), "quality-fit")
    for _ in range(STEPS):
        near = _nearest(vectors, fitted).withColumn("bin", _bin(F.sqrt(_squared_distance())))
        fitted = stored(_estimates(_moments(near)), "quality-fit")
    last = _nearest(vectors, fitted).withColumn("bin", _bin(F.sqrt(_squared_distance())))
    cuts = _moments(last).select(F.col("pool").alias("_p"), F.col("start").alias("_s"), F.col("cut").alias("_cut"))
    best = Window.partitionBy("_pool").orderBy("determinant", "start")
    ranked = fitted.withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    return (
        ranked.join(cuts, (F.col("_pool") == F.col("_p")) & (F.col("start") == F.col("_s")))
        .withColumn("cut", F.col("_cut"))
        .drop("_rank", "_p", "_s", "_cut")
    )


def fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pools and their estimates from stored rows with statistics, lang and source; both are
    stored, so that Spark knows how small they are when it plans a join."""
    pools = stored(_pools(rows), "quality-pools")
    fitted = covariance_estimates(_with_pool(rows, pools).select("pool", *COORDINATES))
    return pools, stored(fitted, "quality-estimates")


def judge(rows: DataFrame, pools: DataFrame, fitted: DataFrame) -> DataFrame:
    """Add `distance` and `kept` to rows with statistics, lang and source.

    The covariance is scaled up until its COVERED share lies where that of a normal distribution
    would, never down; rows with a squared distance beyond CHI_REJECT go, as do rows
    that fail a base rule.
    """
    reach = (F.col("cut") + F.lit(1.0)) / F.lit(float(DISTANCE_STEP))
    scale = F.greatest(reach * reach / F.lit(CHI_COVERED), F.lit(1.0))
    judged = _nearest(_with_pool(rows, pools), fitted).withColumn(
        "distance", _squared_distance() / scale
    )
    kept = ~F.col("base_failed") & (F.col("distance") <= F.lit(CHI_REJECT))
    names = [c for c in rows.columns if c not in ("distance", "kept")]
    return judged.select(*names, "distance", kept.alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """Statistics, base rules and verdict of every row of (doc_id, text, lang, source).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance and kept. A null text has no words, so it fails; null languages and sources are
    pools like any other; repeated rows are judged each; other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    rows = stored(with_statistics(docs, ["doc_id", "lang", "source"]), "quality-rows")
    return judge(rows, *fit(rows)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "distance",
        "kept",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that `quality` keeps, with all their columns as they were.

    Statistics are taken twice, once for the estimates and once where rows are let through:
    that costs less than to store or to shuffle whole texts.
    """
    found = fit(stored(with_statistics(docs, ["lang", "source"]), "quality-rows"))
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    whole = docs.select("text", "lang", "source", row.alias("_row"))
    judged = judge(with_statistics(whole, ["lang", "source", "_row"]), *found)
    # one number instead of two conditions: the optimizer would take all statistics once more to
    # test the base rules before the join
    off = F.col("distance") + F.when(F.col("base_failed"), 1).otherwise(0) * F.lit(2 * CHI_REJECT)
    return judged.where(off <= F.lit(CHI_REJECT)).select("_row.*")
