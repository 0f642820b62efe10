"""One query per operator over whole tables, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import (
    alignment,
    bpe,
    jaccardjoin,
    kneserney,
    langid,
    mixing,
    oracles,
    prefixtrie,
    quality,
    sharding,
    simhash,
    urls,
    winnowing,
    wrappers,
)
from tallybrook.llm.common import table

#: Which urls are allowed or blocked, by host and start of the path.
URL_RULES = (
    urls.Rule(urls.ALLOW, "org", "/"),
    urls.Rule(urls.BLOCK, "example.org", "/es/"),
    urls.Rule(urls.BLOCK, "example.org", "/en/1"),
    urls.Rule(urls.ALLOW, "com", "/fr/"),
    urls.Rule(urls.BLOCK, "com", "/de/"),
)
#: Pages on hosts with one of these names make up the list of blocked urls.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"

#: Queries that SQL can express on whole tables; the others are tested against brute force.
ORACLES: dict[str, str] = oracles.ORACLES


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics, base rules and robust outlier verdicts of all documents."""
    return quality.quality(table(spark, sf_dir, "documents")).drop("distance")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the shortest code under byte context trees."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a bigram model of most of them."""
    return kneserney.train_and_score(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by wrappers induced per host."""
    found = wrappers.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages by rules and a list of blocked urls."""
    pages = table(spark, sf_dir, "pages")
    name = F.split(urls.host_of(F.col("url")), r"\.")
    listed = pages.where(F.arrays_overlap(name, F.array(*map(F.lit, LISTED_NAMES)))).select("url")
    return urls.judge_urls(pages, URL_RULES, listed)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the texts they decode to, as digests."""
    path = public_tokenizers.path(TOKENIZER)
    return token_digests(bpe.encode(table(spark, sf_dir, "documents"), path, with_decoded=True))


def token_digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in a mix of all sources by weight, a row per document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.size("drawn")).cast("bigint")
    rows = mixed.withColumn("taken", taken).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))
    )
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of all documents, and how they resemble an edit and the next."""
    compared = winnowing.compare_with_edits(table(spark, sf_dir, "documents"))

    def digest(name: str):
        return F.lower(F.lpad(F.hex(F.xxhash64(f"{name}.hashes", f"{name}.positions")), 16, "0"))

    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        digest("fingerprint").alias("fingerprint"),
        digest("edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to eight shards of a weighted hash tree."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct start of the rebuilt conversations as a node of one trie."""
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers over all documents."""
    return alignment.cross_tokenizer_alignment(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path(BYTE_TOKENIZER),
        public_tokenizers.path(PIECE_TOKENIZER),
    )


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose shingle sets share nine tenths of their union."""
    return jaccardjoin.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_quality,
        op2_language_id,
        op3_simhash,
        op4_lm,
        op5_html,
        op6_urls,
        op7_bpe,
        op8_mixing,
        op9_winnowing,
        op10_sharding,
        op11_prefix_trie,
        op12_alignment,
        op13_jaccard_join,
    )
}
