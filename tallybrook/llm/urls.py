"""URL rules and lists behind a blocked Bloom filter."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A block holds eight words of 32 bits, and each key sets one bit in each word.
WORDS = 8
WORD_BITS = 32
BITS_PER_KEY = 12
#: Filters up to this size are sent to all executors; larger ones are joined by block.
BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 80

ALLOW, BLOCK = "allow", "block"

#: Parameters that say where a visitor came from, not what the page is.
TRACKING = r"^(utm_.*|ref|fbclid|gclid)(=|$)"


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A to Z lowered; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path and sorted query without tracking parameters; null for what has no host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    ending = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&")))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    whole = F.concat(host_of(url), path, F.coalesce(ending, F.lit("")))
    return F.when(host_of(url) != "", whole)


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "key")


def _bit(word: int) -> Column:
    """The bit that `key` sets in a word of its block."""
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_bits, {5 * word}) & 31 as int))")


def _located(rows: DataFrame, blocks: int) -> DataFrame:
    located = rows.withColumn("_block", F.pmod(_hash(1), F.lit(blocks))).withColumn(
        "_bits", _hash(2)
    )
    return located.withColumns({f"_bit{i}": _bit(i) for i in range(WORDS)}).drop("_bits")


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, word0 to word7) of a filter of `key`; blocks without a key are absent."""
    words = [F.bit_or(f"_bit{i}").alias(f"word{i}") for i in range(WORDS)]
    located = _located(keys.select("key"), blocks)
    return located.groupBy(F.col("_block").alias("block")).agg(*words)


def possible_hits(rows: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """The rows whose `key` may be among the `count` keys; false positives are about 1 in 200."""
    blocks = max(1, -(-count * BITS_PER_KEY // (WORDS * WORD_BITS)))
    built = bloom_filter(keys, blocks)
    if blocks * BLOCK_BYTES <= BROADCAST_BYTES:
        built = F.broadcast(built)
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"word{i}").bitwiseAND(F.col(f"_bit{i}")) != 0)
    located = _located(rows, blocks)
    return located.join(built, F.col("_block") == F.col("block")).where(hit).select(*rows.columns)


def _candidates(rules: Sequence[Rule]) -> Column:
    """Every key a url could be listed under: suffixes of its host with starts of its path, as
    long as some rule's, and its canonical form."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    lengths = sorted({len(rule.path) for rule in rules})
    starts = F.filter(
        F.transform(
            F.array(*[F.lit(n) for n in lengths]),
            lambda n: F.when(F.length("path") >= n, F.left("path", n)),
        ),
        lambda start: start.isNotNull(),
    )
    by_rule = F.flatten(
        F.transform(
            suffixes, lambda s: F.transform(starts, lambda p: F.concat(F.lit("rule "), s, p))
        )
    )
    whole = F.array(F.concat(F.lit("url "), canonical(F.col("url"))))
    if not lengths:
        return whole
    return F.concat(F.when(F.col("host") != "", by_rule).otherwise(F.array()), whole)


def _rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(f"rule {r.name}", r.name, r.action, len(r.host)) for r in rules]
    return spark.createDataFrame(rows, "key string, rule string, action string, host_length int")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of (page_id, url).

    Of the rules that fit, the longest wins (then the one with the longer host, then block);
    `rule` is its host and path. Without one, urls whose canonical form is among
    those of `listed` (url) are blocked, all others allowed. Each distinct url is looked up
    once, under all its keys: the filter lets few pass that are not listed, and an exact join
    removes these. Null urls and urls without `://` have empty host and path and are
    allowed; repeated rows are judged alike; an empty table gives no rows.
    """
    spark = pages.sparkSession
    own = listed.select(F.concat(F.lit("url "), canonical(F.col("url"))).alias("key"))
    own = own.where(F.col("key").isNotNull()).distinct()
    entries = _rules_table(spark, rules).unionByName(
        own.withColumns(
            {
                "rule": F.lit(None).cast("string"),
                "action": F.lit(BLOCK),
                "host_length": F.lit(0),
            }
        )
    )
    urls = (
        pages.select("url")
        .where(F.col("url").isNotNull())
        .distinct()
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
    )
    keyed = urls.select("url", F.explode(_candidates(rules)).alias("key")).where(
        F.col("key").isNotNull()
    )
    hits = possible_hits(keyed, entries.select("key"), entries.count()).join(entries, "key")
    order = F.struct(
        F.length("rule"), "host_length", F.when(F.col("action") == BLOCK, 1).otherwise(0)
    )
    best = hits.groupBy(F.col("url").alias("_url")).agg(
        F.max_by(F.struct("rule", "action"), F.struct(F.col("rule").isNotNull(), order)).alias("b")
    )
    return pages.select("page_id", "url").join(best, F.col("url") == F.col("_url"), "left").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("b.rule").alias("rule"),
        F.coalesce(F.col("b.action"), F.lit(ALLOW)).alias("verdict"),
    )
