"""Percentile rank of the amount within its service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.operators.running import data_bucket, running_totals
from tallybrook.session import work_dir

HOT_SHARE = 10_000


def skew_safe_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    spread_by: str,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Left-join `value` from `lookup` (one row per key) onto rows whose keys may be very uneven.

    `weight` is the number of rows behind each lookup key. Keys that hold over 1/`hot_share` of
    all rows are fewer than `hot_share` whatever the data, so that part is broadcast. Rows it
    answers, and rows with a NULL key, are spread evenly by a hash of `spread_by` through the
    shuffle that serves the rest, where no key holds more than 1/`hot_share` of the rows.
    """
    total = lookup.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) * hot_share > total
    hot = lookup.where(is_hot).select(*keys, F.col(value).alias("_hot"))
    # 1 for every lookup row; taken from the weight because a literal would be folded away and
    # with it the spread column of the join key
    cold = lookup.where(~is_hot).select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.signum(weight).cast("int").alias("_slot"),
        F.col(value),
    )
    still_open = F.col("_hot").isNull()
    for k in keys:
        still_open = still_open & F.col(k).isNotNull()
    elsewhere = -1 - F.pmod(F.hash(spread_by), F.lit(1 << 20))
    probed = rows.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_at", F.when(still_open, F.lit(1)).otherwise(elsewhere)
    )
    match = F.col("_at") == F.col("_slot")
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    return probed.join(cold, match, "left").select(
        *[probed[c] for c in rows.columns], F.coalesce("_hot", value).alias(value)
    )


def amount_percentile(rows: DataFrame, service: str = "service_type") -> DataFrame:
    """Add `amount_pct`: average rank of the amount in its service / payments of the service.

    Equal amounts share the mean of their ranks. Ranks are computed on the distinct amounts
    only; a missing amount or service has no rank.
    """
    keys = [service, "amount_egp"]
    ranked = F.col("amount_egp").isNotNull() & ~F.isnan("amount_egp") & F.col(service).isNotNull()
    distinct = rows.where(ranked).groupBy(*keys).agg(F.count(F.lit(1)).alias("ties"))
    ranks = running_totals(
        distinct,
        {"below": "ties"},
        order="amount_egp",
        bucket=data_bucket(distinct, "amount_egp"),
        group=[service],
        overall={"size": "ties"},
    )
    mean_rank = F.col("below") + (F.col("ties") + 1) / F.lit(2.0)
    # written once: the lookup reads it for its total, its hot and its cold keys
    path = work_dir(rows.sparkSession, "ranks")
    ranks.select(*keys, "ties", (mean_rank / F.col("size")).alias("amount_pct")).write.parquet(path)
    ranks = rows.sparkSession.read.parquet(path)
    return skew_safe_lookup(rows, ranks, keys, "amount_pct", "ties", "transaction_id")
