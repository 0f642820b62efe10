"""Document fingerprints by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.common import let

#: Tokens in a gram and grams in a window: a run of GRAM + SPAN - 1 tokens that two texts share
#: always gives them a common hash, and no run of fewer than GRAM tokens ever does.
GRAM = 4
SPAN = 4
#: A word of up to so many code points is a token. In a longer run without white space a token
#: starts at every code point, so a passage keeps its grams wherever in the run it stands.
WORD_CHARS = 16
#: Code points of a token inside such a run; fewer at the run's end.
PIECE_CHARS = 4
_CHAR = r"[^\x20\x09-\x0D]"
_WORD = rf"(?<!{_CHAR}){_CHAR}{{1,{WORD_CHARS}}}+(?!{_CHAR})"
LONG_RUN = rf"{_CHAR}{{{WORD_CHARS + 1}}}"
#: Group 1 is the token; what a match uses up is the word, or one code point of a longer run.
TOKEN = rf"(?=({_WORD}|{_CHAR}{{1,{PIECE_CHARS}}}))(?:{_WORD}|{_CHAR})"

#: Documents in one range of ids, about.
RANGE_ROWS = 10_000
MAX_RANGES = 4096


def fingerprint(text: Column) -> Column:
    """struct<positions array<int>, hashes array<bigint>> of a whole text.

    Tokens are words and, in runs of more than WORD_CHARS code points, the PIECE_CHARS code
    points from each one on. Hashes of grams of tokens are grouped into windows of SPAN
    neighbours, and of each the smallest is kept, of equal ones the rightmost. Positions are the
    numbers of the grams' first tokens, ascending. A text shorter than a gram is one gram, fewer
    grams than a window are one window; a null text or one without words keeps nothing.
    """
    none = F.array().cast("array<int>")
    whole = F.coalesce(text, F.lit(""))
    # most texts have no long run, and their words need no look at what surrounds them
    tokens = F.when(
        F.regexp_like(whole, F.lit(LONG_RUN)), F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(1))
    ).otherwise(F.regexp_extract_all(whole, F.lit(f"{_CHAR}+"), F.lit(0)))

    def numbers(count: Column) -> Column:
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(none)

    def grams(words: Column) -> Column:
        n = F.size(words)
        full = F.transform(
            F.sequence(F.lit(0), n - GRAM),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(GRAM)]),
        )
        short = F.when(n > 0, F.array(F.xxhash64(words))).otherwise(
            F.array().cast("array<bigint>")
        )
        return F.when(n >= GRAM, full).otherwise(short)

    def smallest(hashes: Column, i: Column) -> Column:
        window = [F.get(hashes, i + j) for j in range(SPAN)]
        place = F.when(window[-1] == F.least(*window), i + SPAN - 1)
        for j in range(SPAN - 2, -1, -1):
            place = place.when(window[j] == F.least(*window), i + j)
        return place

    def rightmost(hashes: Column) -> Column:
        return let(
            F.array_min(hashes),
            lambda m: F.array(F.size(hashes) - F.array_position(F.reverse(hashes), m).cast("int")),
        )

    def kept(hashes: Column) -> Column:
        n = F.size(hashes)
        places = F.when(
            n >= SPAN,
            F.array_distinct(F.transform(numbers(n - SPAN + 1), lambda i: smallest(hashes, i))),
        ).otherwise(F.when(n > 0, rightmost(hashes)).otherwise(none))
        return let(
            places,
            lambda p: F.struct(
                p.alias("positions"), F.transform(p, lambda i: F.get(hashes, i)).alias("hashes")
            ),
        )

    return let(let(tokens, grams), kept)


def likeness(a: Column, b: Column) -> Column:
    """Twice the distinct hashes in common over those of both; 1 if neither has any."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(x) + F.size(y)
    common = F.size(F.array_intersect(x, y))
    return F.when(both > 0, common * F.lit(2.0) / both).otherwise(F.lit(1.0))


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of the range that an id falls into."""
    steps = F.array(*[F.lit(b).cast("bigint") for b in bounds]).cast("array<bigint>")
    return F.size(F.filter(steps, lambda b: b <= doc_id))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the next document by doc_id.

    After the last document comes the first. Ids that are null come last, equal ids in the
    order of a hash of their text. Ranges of ids are ordered each in its own task; the first
    document of a range is copied to the end of the range before.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count, lowest = rows.agg(F.count(F.lit(1)), F.min("doc_id")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(MAX_RANGES, max(least, count // RANGE_ROWS), count))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = []
    if shares and lowest is not None:
        found = rows.agg(F.percentile_approx("doc_id", shares, 100 * ranges)).first()[0]
        bounds = sorted(set(found))
    last = len(bounds)
    # a null id is larger than any other
    number = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(
        _range_of(F.col("doc_id"), bounds)
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    placed = rows.withColumn("_range", number).withColumn("_tie", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_tie"))
    firsts = placed.groupBy("_range").agg(F.min(key).alias("_first"))
    ring = Window.orderBy("_range")
    all_ = Window.partitionBy()
    before = firsts.select(
        F.col("_range").alias("_at"),
        "_first",
        F.coalesce(F.lag("_range").over(ring), F.max("_range").over(all_)).alias("_before"),
    )
    copies = (
        placed.join(before, (F.col("_range") == F.col("_at")) & (key == F.col("_first")))
        .select("doc_id", "text", F.col("_before").alias("_range"), "_tie")
        .withColumn("_copy", F.lit(1))
    )
    own = placed.withColumn("_copy", F.lit(0))
    inside = Window.partitionBy("_range").orderBy("_copy", *order)
    return own.unionByName(copies).withColumn("next_text", F.lead("text").over(inside))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of (doc_id, text), of an edit of it, and how alike they are.

    Returns doc_id, n_chars, edited_text, fingerprint, edited (both with positions and
    hashes), near_edited and near_next. The edit replaces the last floor(n_chars / 2) code
    points by the first as many, or all, of the next document. Null texts count as empty;
    other columns are ignored; repeated rows follow each other; an empty table gives no rows.
    """
    followed = with_next(docs)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)
    )
    inside = Window.partitionBy("_range").orderBy(
        "_copy", F.col("doc_id").asc_nulls_last(), "_tie"
    )
    printed = (
        followed.withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("edited_text", F.when(F.col("_copy") == 0, edited))
        .withColumn("fingerprint", fingerprint(F.col("text")))
        .withColumn("edited", fingerprint(F.col("edited_text")))
        .withColumn("_next", F.lead("fingerprint.hashes").over(inside))
        .where("_copy = 0")
    )
    own = F.col("fingerprint.hashes")
    return printed.select(
        "doc_id",
        "n_chars",
        "edited_text",
        "fingerprint",
        "edited",
        likeness(own, F.col("edited.hashes")).alias("near_edited"),
        likeness(own, F.col("_next")).alias("near_next"),
    )
