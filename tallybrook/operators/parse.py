"""From raw messages to typed, scored payment rows. Every step works on a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.functions.scoring import fraud_flag, rule_score
from tallybrook.schema import TRANSACTION_SCHEMA

CORRUPT = "corrupt_json"
_READ_SCHEMA = T.StructType(
    [*TRANSACTION_SCHEMA.fields, T.StructField(CORRUPT, T.StringType(), True)]
)


def parse_transactions(messages: DataFrame, *keep: str, value: str = "value") -> DataFrame:
    """Read JSON messages (bytes or text) into typed columns.

    A field of the wrong type and an unreadable time become NULL, unknown fields are ignored;
    `corrupt_json` holds the text of every message that is not JSON or has a mistyped field.
    """
    text = F.col(value).cast("string")
    data = F.from_json(text, _READ_SCHEMA, {"columnNameOfCorruptRecord": CORRUPT})
    # Unfolded by a generator, a message is parsed once: later filters stay above it. As a plain
    # projection the optimizer would copy the parser into every condition on its fields.
    fields = messages.select(F.inline(F.array(data)), *keep)
    return fields.withColumn("event_time", F.try_to_timestamp("event_time"))


def fill_amount(rows: DataFrame) -> DataFrame:
    """A missing amount counts as 0."""
    return rows.withColumn("amount_egp", F.coalesce("amount_egp", F.lit(0.0)))


def score(rows: DataFrame) -> DataFrame:
    """Add the rule score and raise the fraud flag from it."""
    return rows.withColumn("fraud_score", rule_score()).withColumn("is_fraud", fraud_flag())


def enrich(rows: DataFrame) -> DataFrame:
    """Fill the amount, score, flag and stamp the ingestion time (one value per micro-batch),
    unless the rows bring the time at which they came in."""
    scored = score(fill_amount(rows))
    if "ingested_at" in rows.columns:
        return scored
    return scored.withColumn("ingested_at", F.current_timestamp())
