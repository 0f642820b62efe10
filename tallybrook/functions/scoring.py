"""Fraud score and flag as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (amount above, points), highest tier first.
AMOUNT_TIERS = [(15000, 0.6), (8000, 0.3), (3000, 0.1)]
# Fixed values: (matching value, amount above, points).
CREDIT_CARD_RULE = ("credit_card", 5000, 0.15)
FAILED_RULE = ("failed", 2000, 0.1)
# Services that usually carry high amounts, and their discount.
HIGH_AMOUNT_SERVICES = ["university_fees", "credit_card_payment"]
HIGH_AMOUNT_DISCOUNT = 0.1
# Fixed value: lowest score that counts as fraud.
FRAUD_THRESHOLD = 0.5


def rule_score(
    amount: str = "amount_egp",
    service: str = "service_type",
    method: str = "payment_method",
    status: str = "status",
) -> Column:
    """Rule-based fraud score in [0, 1] with 4 digits; 0 when the amount is missing or NaN.

    A missing category never matches a rule. The score is rounded before anyone compares it
    with the threshold, so 0.6 - 0.1 counts as 0.5.
    """
    value = F.col(amount)
    tier = F.lit(0.0)
    for above, points in reversed(AMOUNT_TIERS):
        tier = F.when(value > above, F.lit(points)).otherwise(tier)
    raised = tier
    for name, (match, above, points) in ((method, CREDIT_CARD_RULE), (status, FAILED_RULE)):
        hit = (F.col(name) == match) & (value > above)
        raised = raised + F.when(hit, F.lit(points)).otherwise(F.lit(0.0))
    lowered = F.greatest(F.lit(0.0), raised - F.lit(HIGH_AMOUNT_DISCOUNT))
    total = F.when(F.col(service).isin(HIGH_AMOUNT_SERVICES), lowered).otherwise(raised)
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(
        F.round(F.least(total, F.lit(1.0)), 4)
    )


def fraud_flag(flag: str = "is_fraud", score: str = "fraud_score") -> Column:
    """Source flag OR score at the threshold; stays NULL for an unknown flag and a low score."""
    return F.col(flag) | (F.col(score) >= FRAUD_THRESHOLD)
