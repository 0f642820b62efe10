"""From raw documents to a mixed, tokenized training corpus."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallybrook.llm import bpe, langid, mixing, quality, queries, simhash
from tallybrook.llm.common import stored, table

#: A language counts as recognized from this share of the posterior on.
LANGUAGE_SCORE = 0.5


def recognized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognized language; those without letters or between languages go."""
    return langid.recognized(docs, LANGUAGE_SCORE)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.mixed_rows(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each copy in the mix."""
    path = public_tokenizers.path(queries.TOKENIZER)
    return queries.token_digests(bpe.encode(docs, path, with_decoded=True))


STAGES = [
    ("language", recognized),
    ("quality", good),
    ("near-duplicates", distinct),
    ("mix", mixed),
    ("tokens", tokenized),
]

#: Language models and similarity components have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
