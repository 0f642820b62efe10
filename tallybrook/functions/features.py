"""Row-level model features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Last hour of the night, and the amount the ratio feature saturates at.
LAST_ODD_HOUR = 4
RATIO_CAP_AMOUNT = 50000.0


def hour_of_day(time: str = "event_time") -> Column:
    """Hour of the event itself, so that a replay scores the same as the first run."""
    return F.hour(time)


def odd_hour(time: str = "event_time") -> Column:
    """1 for an event in the night hours 0-4, else 0."""
    return F.when(F.hour(time) <= LAST_ODD_HOUR, 1).otherwise(0)


def amount_ratio(amount: str = "amount_egp") -> Column:
    """Amount as a share of 50,000, at most 1."""
    return F.least(F.col(amount) / F.lit(RATIO_CAP_AMOUNT), F.lit(1.0))


def money(amount: str = "amount_egp") -> Column:
    """Amount as exact decimal money, NULL and what is no number as 0."""
    value = F.col(amount).cast("double")
    sound = F.when(~F.isnan(value), F.col(amount))
    return F.coalesce(sound.cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))
