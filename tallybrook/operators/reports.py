"""Suspicious-payment reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.features import hour_of_day, money
from tallybrook.schema import AMOUNT_RANGES, MONEY_SUM

# Amounts and hours that mark injected fraud.
SIGNATURE_AMOUNT = (15000, 50000)
SIGNATURE_HOURS = (1, 4)


def fraud_signature_report(rows: DataFrame) -> DataFrame:
    """Large payments in the night hours, per day and service."""
    hits = rows.where(
        F.col("amount_egp").between(*SIGNATURE_AMOUNT) & hour_of_day().between(*SIGNATURE_HOURS)
    )
    return hits.groupBy(F.to_date("event_time").alias("event_date"), "service_type").agg(
        F.count(F.lit(1)).alias("hits"),
        F.sum(money()).cast(MONEY_SUM).alias("amount_egp"),
    )


def amount_range_violations(rows: DataFrame) -> DataFrame:
    """Payments outside the usual amounts of their service, with the range they miss.

    The 15 ranges are a literal map: the lookup stays in the scan's stage, with no join.
    """
    pairs = [
        F.lit(part)
        for service, bounds in AMOUNT_RANGES.items()
        for part in (service, list(map(float, bounds)))
    ]
    bounds = F.create_map(*pairs)[F.col("service_type")]
    return (
        rows.select("transaction_id", "service_type", "amount_egp", bounds.alias("bounds"))
        .select(
            "transaction_id",
            "service_type",
            "amount_egp",
            F.col("bounds")[0].alias("low"),
            F.col("bounds")[1].alias("high"),
        )
        .where(~F.col("amount_egp").between(F.col("low"), F.col("high")))
    )
