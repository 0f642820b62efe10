"""Validation, quarantine and de-duplication of payment rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.operators.parse import CORRUPT, enrich
from tallybrook.schema import COLUMN_WIDTHS, MONEY, SCORE, WAREHOUSE_COLUMNS

REJECT = "reject_reason"


def reject_reasons() -> Column:
    """All reasons to reject a parsed row, comma-separated; an empty text for a good row."""
    amount = F.col("amount_egp")
    checks = [
        (F.col(CORRUPT).isNotNull(), "malformed_json"),
        (F.col("transaction_id").isNull(), "transaction_id_missing"),
        (F.col("event_time").isNull(), "event_time_missing"),
    ]
    checks += [(F.length(c) > n, f"{c}_too_long") for c, n in COLUMN_WIDTHS.items()]
    not_a_number = F.isnan(amount)
    checks += [
        (not_a_number, "amount_not_a_number"),
        (~not_a_number & amount.isNotNull() & amount.try_cast(MONEY).isNull(), "amount_out_of_range"),
    ]
    return F.concat_ws(",", *[F.when(test, reason) for test, reason in checks])


def with_reject_reason(parsed: DataFrame) -> DataFrame:
    """Add `reject_reason`, empty for rows that meet the table contract."""
    return parsed.withColumn(REJECT, reject_reasons())


def rejected(checked: DataFrame) -> DataFrame:
    """The rows to quarantine."""
    return checked.where(F.col(REJECT) != "")


def accepted(checked: DataFrame) -> DataFrame:
    """The rows to keep, without the helper columns."""
    return checked.where(F.col(REJECT) == "").drop(REJECT, CORRUPT)


def dedup_earliest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by `order`, ties broken by the remaining columns.

    A minimum over whole rows instead of a window: copies of a key collapse in the map tasks
    before the shuffle, so no task ever sees more than one row per key and map task.
    """
    names = rows.columns
    ranked = [*order, *[c for c in names if c not in keys and c not in order]]
    first = F.min(F.struct(*ranked)).alias("first")
    return (
        rows.groupBy(*keys)
        .agg(first)
        .select(*[F.col(c) if c in keys else F.col(f"first.{c}") for c in names])
    )


def typed_for_storage(enriched: DataFrame, *keep: str) -> DataFrame:
    """Warehouse columns with their stored types, plus the partition date."""
    stored = {
        "amount_egp": F.col("amount_egp").cast(MONEY),
        "fraud_score": F.col("fraud_score").cast(SCORE),
    }
    return enriched.select(
        *[stored[c].alias(c) if c in stored else F.col(c) for c in WAREHOUSE_COLUMNS],
        *keep,
        F.to_date("event_time").alias("event_date"),
    )


def silver(parsed: DataFrame) -> DataFrame:
    """Clean table of a batch of parsed rows."""
    return clean_rows(with_reject_reason(parsed))


def clean_rows(checked: DataFrame) -> DataFrame:
    """Accepted rows, one per transaction id, scored and typed for storage.

    An unknown fraud flag takes the table's default here, FALSE. `source_flag` keeps the flag as
    it came, unknown included: it is the label that a model learns from. Of copies the earliest
    stays, by event time, then by the time of ingestion if the rows bring it.
    """
    good = accepted(checked)
    order = [c for c in ("event_time", "ingested_at") if c in good.columns]
    once = dedup_earliest(good, ["transaction_id"], order)
    flagged = once.withColumn("source_flag", F.col("is_fraud"))
    return typed_for_storage(enrich(flagged), "source_flag").fillna({"is_fraud": False})
