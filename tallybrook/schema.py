"""Data contract of the payment events: wire schema, table columns, widths, category domains."""

from __future__ import annotations

from pyspark.sql import types as T

# The wire format of one payment event, in order.
TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType(), True),
        T.StructField("event_time", T.StringType(), True),
        T.StructField("customer_id", T.StringType(), True),
        T.StructField("merchant_id", T.StringType(), True),
        T.StructField("service_type", T.StringType(), True),
        T.StructField("amount_egp", T.DoubleType(), True),
        T.StructField("governorate", T.StringType(), True),
        T.StructField("payment_method", T.StringType(), True),
        T.StructField("status", T.StringType(), True),
        T.StructField("is_fraud", T.BooleanType(), True),
    ]
)

TRANSACTION_COLUMNS = TRANSACTION_SCHEMA.fieldNames()

# Columns of the warehouse table, in order.
WAREHOUSE_COLUMNS = [
    "transaction_id",
    "event_time",
    "customer_id",
    "merchant_id",
    "service_type",
    "amount_egp",
    "governorate",
    "payment_method",
    "status",
    "is_fraud",
    "fraud_score",
    "ingested_at",
]

# Widest string each warehouse column takes.
COLUMN_WIDTHS = {
    "transaction_id": 36,
    "customer_id": 36,
    "merchant_id": 36,
    "service_type": 50,
    "governorate": 50,
    "payment_method": 30,
    "status": 20,
}

# The category domains, in order.
SERVICE_TYPES = [
    "electricity_bill",
    "water_bill",
    "gas_bill",
    "mobile_topup",
    "internet_bill",
    "school_fees",
    "university_fees",
    "traffic_fines",
    "telephone_bill",
    "credit_card_payment",
    "insurance_premium",
    "pos_purchase",
    "ecommerce_payment",
    "government_fees",
    "donations",
]

# The governorates, in order.
GOVERNORATES = [
    "Cairo",
    "Giza",
    "Alexandria",
    "Qalyubia",
    "Sharqia",
    "Dakahlia",
    "Beheira",
    "Minya",
    "Assiut",
    "Sohag",
    "Luxor",
    "Aswan",
    "Port Said",
    "Suez",
    "Ismailia",
]

# The ways to pay, in order.
PAYMENT_METHODS = [
    "wallet",
    "debit_card",
    "credit_card",
    "bank_transfer",
    "cash_at_agent",
]

# Lowest and highest usual amount of each service.
AMOUNT_RANGES = {
    "electricity_bill": (50, 800),
    "water_bill": (20, 300),
    "gas_bill": (30, 400),
    "mobile_topup": (10, 500),
    "internet_bill": (100, 600),
    "school_fees": (500, 5000),
    "university_fees": (2000, 20000),
    "traffic_fines": (100, 1000),
    "telephone_bill": (50, 400),
    "credit_card_payment": (200, 30000),
    "insurance_premium": (300, 5000),
    "pos_purchase": (20, 3000),
    "ecommerce_payment": (50, 5000),
    "government_fees": (50, 2000),
    "donations": (10, 1000),
}

# Money at rest, and sums of it. A sum is wider than NUMERIC(14,2): one region's day
# passes 10^12 at a few billion payments, and an overflow would fail the whole job.
MONEY = "decimal(12,2)"
MONEY_SUM = "decimal(22,2)"
SCORE = "decimal(5,4)"

COUNTER_VALUE = "decimal(24,2)"
STORED_COUNTERS = (
    f"metric string, key string, value {COUNTER_VALUE}, written_at timestamp, "
    "query_id string, batch_id bigint"
)

_MEASURES = f"total_transactions bigint, total_amount_egp {MONEY_SUM}, fraud_count bigint"
GOVERNORATE_SUMMARY_SCHEMA = f"governorate string, {_MEASURES}, summary_date date"
SERVICE_SUMMARY_SCHEMA = f"service_type string, {_MEASURES}, summary_date date"
