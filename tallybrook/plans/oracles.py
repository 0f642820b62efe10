"""The same results in plain SQL, from the same tables, written without the package's operators."""

from __future__ import annotations

# Fixed values of the data contract, stated here again so that a wrong one in the package shows.
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
COLUMN_WIDTHS = {
    "transaction_id": 36,
    "customer_id": 36,
    "merchant_id": 36,
    "service_type": 50,
    "governorate": 50,
    "payment_method": 30,
    "status": 20,
}
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

def _pick(index: str, domain: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(domain))
    return f"CASE {index} {cases} END"


PAYMENTS = f"""
payments AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id,
         CAST(ts AS TIMESTAMP) AS event_time,
         CAST(user_id AS VARCHAR) AS customer_id,
         CONCAT('MERCH-', CAST(1000 + (event_id * 7) % 40 AS VARCHAR)) AS merchant_id,
         {_pick("CAST(json_extract_string(props, '$.k') AS INT) % 15", SERVICE_TYPES)} AS service_type,
         value * 100 AS amount_egp,
         {_pick("user_id % 15", GOVERNORATES)} AS governorate,
         CASE event_type WHEN 'click' THEN 'wallet' WHEN 'error' THEN 'debit_card'
              WHEN 'purchase' THEN 'credit_card' WHEN 'signup' THEN 'bank_transfer'
              ELSE 'cash_at_agent' END AS payment_method,
         CASE event_id % 6 WHEN 4 THEN 'failed' WHEN 5 THEN 'pending' ELSE 'success' END AS status,
         CASE WHEN event_id % 50 = 7 THEN CAST(NULL AS BOOLEAN)
              ELSE event_id % 33 = 0 END AS is_fraud,
         event_id
  FROM events
)"""


def _scored(source: str, name: str = "scored") -> str:
    """CTEs that add the rule score and raise the flag on `source`."""
    return f"""
{name}_points AS (
  SELECT *,
         CAST(CASE WHEN amount_egp > 15000 THEN 0.6 WHEN amount_egp > 8000 THEN 0.3
                   WHEN amount_egp > 3000 THEN 0.1 ELSE 0 END AS DOUBLE)
         + CAST(CASE WHEN payment_method = 'credit_card' AND amount_egp > 5000
                     THEN 0.15 ELSE 0 END AS DOUBLE)
         + CAST(CASE WHEN status = 'failed' AND amount_egp > 2000
                     THEN 0.1 ELSE 0 END AS DOUBLE) AS points
  FROM {source}
),
{name}_score AS (
  SELECT * EXCLUDE (points),
         CASE WHEN amount_egp IS NULL OR isnan(amount_egp) THEN CAST(0 AS DOUBLE)
              ELSE ROUND(LEAST(CASE WHEN service_type IN ('university_fees', 'credit_card_payment')
                                    THEN GREATEST(CAST(0 AS DOUBLE), points - CAST(0.1 AS DOUBLE))
                                    ELSE points END, CAST(1 AS DOUBLE)), 4) END AS fraud_score
  FROM {name}_points
),
{name} AS (
  SELECT * EXCLUDE (is_fraud), is_fraud AS source_flag,
         (is_fraud OR fraud_score >= 0.5) AS is_fraud
  FROM {name}_score
)"""


SCORED = f"{PAYMENTS}, {_scored('payments')}"

# Messages, every 200th broken, read back with SQL's own JSON functions.
_DEFECT = "CASE WHEN event_id % 200 = 3 THEN (event_id // 200) % 10 END"
WIRE = f"""{PAYMENTS},
wire AS (
  SELECT event_id, {_DEFECT} AS defect,
         CASE WHEN {_DEFECT} = 0 THEN 'not json' ELSE CAST(json_merge_patch(
           json_object('transaction_id', transaction_id,
                       'event_time', strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f'),
                       'customer_id', customer_id, 'merchant_id', merchant_id,
                       'service_type', service_type, 'amount_egp', amount_egp,
                       'governorate', governorate, 'payment_method', payment_method,
                       'status', status, 'is_fraud', is_fraud),
           CASE {_DEFECT}
             WHEN 1 THEN '{{"amount_egp": "abc"}}'
             WHEN 2 THEN '{{"event_time": null}}'
             WHEN 3 THEN '{{"channel": "kiosk"}}'
             WHEN 4 THEN '{{"event_time": "2024-13-45T99:00:00"}}'
             WHEN 5 THEN '{{"transaction_id": null}}'
             WHEN 6 THEN '{{"merchant_id": "' || repeat('x', 60) || '"}}'
             WHEN 7 THEN '{{"amount_egp": 100000000000.0}}'
             WHEN 8 THEN '{{"amount_egp": "NaN"}}'
             WHEN 9 THEN '{{"status": "' || repeat('x', 60) || '"}}'
             ELSE '{{}}' END) AS VARCHAR) END AS value
  FROM payments
),
sound AS (
  SELECT event_id, value, CASE WHEN json_valid(value) THEN value ELSE '{{}}' END AS body FROM wire
),
parsed AS (
  SELECT event_id,
         json_extract_string(body, '$.transaction_id') AS transaction_id,
         TRY_CAST(json_extract_string(body, '$.event_time') AS TIMESTAMP) AS event_time,
         json_extract_string(body, '$.customer_id') AS customer_id,
         json_extract_string(body, '$.merchant_id') AS merchant_id,
         json_extract_string(body, '$.service_type') AS service_type,
         TRY_CAST(json_extract_string(body, '$.amount_egp') AS DOUBLE) AS amount_egp,
         json_extract_string(body, '$.governorate') AS governorate,
         json_extract_string(body, '$.payment_method') AS payment_method,
         json_extract_string(body, '$.status') AS status,
         TRY_CAST(json_extract_string(body, '$.is_fraud') AS BOOLEAN) AS is_fraud,
         (NOT json_valid(value)
          OR (json_extract_string(body, '$.amount_egp') IS NOT NULL
              AND TRY_CAST(json_extract_string(body, '$.amount_egp') AS DOUBLE) IS NULL)) AS corrupt
  FROM sound
)"""

_WIDTH_REASONS = ", ".join(
    f"CASE WHEN length({c}) > {n} THEN '{c}_too_long' END" for c, n in COLUMN_WIDTHS.items()
)
CHECKED = f"""{WIRE},
checked AS (
  SELECT *, concat_ws(',',
    CASE WHEN corrupt THEN 'malformed_json' END,
    CASE WHEN transaction_id IS NULL THEN 'transaction_id_missing' END,
    CASE WHEN event_time IS NULL THEN 'event_time_missing' END,
    {_WIDTH_REASONS},
    CASE WHEN isnan(amount_egp) THEN 'amount_not_a_number' END,
    CASE WHEN NOT isnan(amount_egp) AND abs(amount_egp) >= 1e10 THEN 'amount_out_of_range' END
  ) AS reject_reason
  FROM parsed
),
good AS (
  SELECT * REPLACE (COALESCE(amount_egp, 0) AS amount_egp) FROM checked WHERE reject_reason = ''
),
{_scored("good", "clean")}"""

TXN = (
    "transaction_id, event_time, customer_id, merchant_id, service_type, amount_egp, "
    "governorate, payment_method, status, is_fraud"
)

_MEASURES = """COUNT(*) AS total_transactions,
       CAST(SUM(CAST(amount_egp AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total_amount_egp,
       CAST(SUM(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS fraud_count"""


def _daily(source: str, keys: str) -> str:
    return f"""SELECT CAST(event_time AS DATE) AS summary_date, {keys}, {_MEASURES}
FROM {source} WHERE status = 'success' GROUP BY CAST(event_time AS DATE), {keys}"""


MERCHANT = f"{SCORED}, merchant_summary AS ({_daily('scored', 'merchant_id, service_type')})"
GOVERNORATE = f"{SCORED}, governorate_summary AS ({_daily('scored', 'governorate')})"
ROLLUP = f"""{MERCHANT},
rollup AS (
  SELECT summary_date, service_type,
         CAST(SUM(total_transactions) AS BIGINT) AS total_transactions,
         CAST(SUM(total_amount_egp) AS DECIMAL(22,2)) AS total_amount_egp,
         CAST(SUM(fraud_count) AS BIGINT) AS fraud_count
  FROM merchant_summary GROUP BY summary_date, service_type
)"""

BATCHED = f"""{SCORED},
batched AS (SELECT *, CAST(event_id // 130 AS BIGINT) AS batch_id FROM scored),
sizes AS (SELECT batch_id, COUNT(*) AS n_rows FROM batched GROUP BY batch_id)"""

LABELLED = f"{PAYMENTS}, labelled AS (SELECT * FROM payments WHERE is_fraud IS NOT NULL)"
JUDGED = f"""{SCORED},
judged AS (
  SELECT source_flag AS truth, fraud_score, fraud_score >= 0.5 AS verdict
  FROM scored WHERE source_flag IS NOT NULL
)"""

PERCENTILE = f"""{PAYMENTS},
amounts AS (
  SELECT service_type, amount_egp, COUNT(*) AS c FROM payments GROUP BY service_type, amount_egp
),
ranks AS (
  SELECT service_type, amount_egp, c,
         SUM(c) OVER (PARTITION BY service_type ORDER BY amount_egp
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c AS below,
         SUM(c) OVER (PARTITION BY service_type) AS n
  FROM amounts
),
percentiles AS (
  SELECT p.*, ROUND((CAST(below AS DOUBLE) + (c + 1) / CAST(2 AS DOUBLE)) / CAST(n AS DOUBLE), 8)
         AS amount_pct
  FROM payments p JOIN ranks r
    ON p.service_type = r.service_type AND p.amount_egp = r.amount_egp
)"""

_CODES = {"service_type": "service_enc", "governorate": "gov_enc", "payment_method": "payment_enc"}


def _code_ctes() -> str:
    return ", ".join(
        f"{code} AS (SELECT {name}, CAST(DENSE_RANK() OVER (ORDER BY {name}) - 1 AS INT) AS {code} "
        f"FROM (SELECT DISTINCT {name} FROM payments) d)"
        for name, code in _CODES.items()
    )


_CODE_JOINS = " ".join(f"JOIN {code} USING ({name})" for name, code in _CODES.items())

_TREE_FEATURES = ("amount_bin", "hour_of_day", *_CODES.values())


def _gini(fraud: str, other: str) -> str:
    whole = f"({fraud} + {other})"
    return f"(1 - ({fraud} / {whole}) * ({fraud} / {whole}) - ({other} / {whole}) * ({other} / {whole}))"


def _tree_level(depth: int) -> str:
    """Splits of one level, and the rows of the next one."""
    long = " UNION ALL ".join(
        f"SELECT node, label, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM rows{depth}"
        for f in _TREE_FEATURES
    )
    right_f, right_o = "(f - lf)", "(o - lo)"
    value = " ".join(f"WHEN '{f}' THEN {f}" for f in _TREE_FEATURES)
    return f"""
counts{depth} AS (
  SELECT node, feature, value, SUM(label) AS fraud, SUM(1 - label) AS other
  FROM ({long}) long GROUP BY node, feature, value
),
sums{depth} AS (
  SELECT node, feature, value AS threshold,
         SUM(fraud) OVER upto / p AS lf, SUM(other) OVER upto / q AS lo,
         SUM(fraud) OVER every / p AS f, SUM(other) OVER every / q AS o,
         MAX(value) OVER every AS last
  FROM counts{depth}, totals
  WINDOW upto AS (PARTITION BY node, feature ORDER BY value),
         every AS (PARTITION BY node, feature)
),
scored{depth} AS (
  SELECT node, feature, threshold, ROUND({_gini("f", "o")}, 9) AS impurity,
         ROUND({_gini("f", "o")} - ((lf + lo) * {_gini("lf", "lo")}
               + (f - lf + o - lo) * {_gini(right_f, right_o)}) / (f + o), 9) AS gain
  FROM sums{depth} WHERE threshold < last
),
split{depth} AS (
  SELECT {depth} AS depth, node, feature, threshold, impurity, gain FROM scored{depth} WHERE gain > 0
  QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, feature, threshold) = 1
),
rows{depth + 1} AS (
  SELECT r.* EXCLUDE (node),
         r.node * 2 + CASE WHEN CASE feature {value} END > threshold THEN 1 ELSE 0 END AS node
  FROM rows{depth} r JOIN split{depth} USING (node)
)"""


def _grown(levels: int) -> str:
    """The splits of the first levels, and the rows of every level."""
    parts = ", ".join(_tree_level(depth) for depth in range(levels))
    return f"""WITH {PAYMENTS}, {_code_ctes()},
inputs AS (
  SELECT transaction_id, is_fraud, LEAST(FLOOR(amount_egp / 100) * 100, 50000) AS amount_bin,
         EXTRACT(hour FROM event_time) AS hour_of_day, {", ".join(f"{c}.{c}" for c in _CODES.values())}
  FROM payments {_CODE_JOINS}
),
rows0 AS (
  SELECT CAST(1 AS BIGINT) AS node, CAST(is_fraud AS INT) AS label, {", ".join(_TREE_FEATURES)}
  FROM inputs WHERE is_fraud IS NOT NULL
),
totals AS (
  SELECT CAST(SUM(label) AS DOUBLE) AS p, CAST(SUM(1 - label) AS DOUBLE) AS q FROM rows0
), {parts}"""


def _tree_splits(levels: int = 2) -> str:
    found = " UNION ALL ".join(f"SELECT * FROM split{depth}" for depth in range(levels))
    return f"{_grown(levels)} {found}"


def _tree_scores(levels: int = 2) -> str:
    value = " ".join(f"WHEN '{f}' THEN {f}" for f in _TREE_FEATURES)
    walks = ", ".join(
        f"""walk{depth + 1} AS (
  SELECT w.* EXCLUDE (node),
         CASE WHEN feature IS NULL THEN w.node
              WHEN CASE feature {value} END <= threshold THEN w.node * 2
              ELSE w.node * 2 + 1 END AS node
  FROM walk{depth} w LEFT JOIN (SELECT node, feature, threshold FROM split{depth}) s USING (node)
)"""
        for depth in range(levels)
    )
    nodes = " UNION ALL ".join(f"SELECT node, label FROM rows{d}" for d in range(levels + 1))
    return f"""{_grown(levels)},
shares AS (
  SELECT node, ROUND(f / (f + o), 4) AS share
  FROM (SELECT node, SUM(label) / MAX(p) AS f, SUM(1 - label) / MAX(q) AS o
        FROM ({nodes}) n, totals GROUP BY node) t
),
walk0 AS (SELECT CAST(1 AS BIGINT) AS node, * FROM inputs), {walks}
SELECT transaction_id, node AS leaf, share AS fraud_score, is_fraud AS source_flag,
       (is_fraud OR share >= 0.5) AS is_fraud
FROM walk{levels} JOIN shares USING (node)"""


_RANGES = ", ".join(
    f"('{s}', CAST({low} AS DOUBLE), CAST({high} AS DOUBLE))"
    for s, (low, high) in AMOUNT_RANGES.items()
)

_COUNTERS = f"""{BATCHED},
deltas AS (
  SELECT batch_id, 'total_transactions' AS metric, '' AS key, CAST(COUNT(*) AS DECIMAL(24,2)) AS value
  FROM batched GROUP BY batch_id
  UNION ALL
  SELECT batch_id, 'total_fraud', '', CAST(SUM(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS DECIMAL(24,2))
  FROM batched GROUP BY batch_id
  UNION ALL
  SELECT batch_id, 'total_revenue', '', CAST(SUM(CAST(amount_egp AS DECIMAL(12,2))) AS DECIMAL(24,2))
  FROM batched GROUP BY batch_id
  UNION ALL
  SELECT batch_id, 'by_service', service_type, CAST(COUNT(*) AS DECIMAL(24,2))
  FROM batched WHERE service_type <> '' GROUP BY batch_id, service_type
  UNION ALL
  SELECT batch_id, 'revenue_by_service', service_type,
         CAST(SUM(CAST(amount_egp AS DECIMAL(12,2))) AS DECIMAL(24,2))
  FROM batched WHERE service_type <> '' GROUP BY batch_id, service_type
  UNION ALL
  SELECT batch_id, 'by_governorate', governorate, CAST(COUNT(*) AS DECIMAL(24,2))
  FROM batched WHERE governorate <> '' GROUP BY batch_id, governorate
)"""


def _ratio(top: str, bottom: str) -> str:
    return (
        f"ROUND(CASE WHEN {bottom} = 0 THEN 0 ELSE CAST({top} AS DOUBLE) / CAST({bottom} AS DOUBLE) "
        "END, 6)"
    )


def _class_row(name: str, hit: str, wrong: str, missed: str) -> str:
    return f"""SELECT '{name}' AS class,
       {_ratio(hit, f"({hit} + {wrong})")} AS "precision",
       {_ratio(hit, f"({hit} + {missed})")} AS recall,
       {_ratio(f"(2 * {hit})", f"(2 * {hit} + {wrong} + {missed})")} AS f1,
       CAST({hit} + {missed} AS BIGINT) AS support FROM cells"""


WAREHOUSE = f"""WITH {CHECKED}
SELECT transaction_id, event_time, customer_id, merchant_id, service_type,
       CAST(amount_egp AS DECIMAL(12,2)) AS amount_egp, governorate, payment_method, status,
       is_fraud, CAST(fraud_score AS DECIMAL(5,4)) AS fraud_score
FROM clean"""
CLEAN_TXN = f"WITH {CHECKED} SELECT {TXN}, fraud_score FROM clean"


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {
        "parse_transactions": f"WITH {WIRE} SELECT {TXN} FROM parsed",
        "null_fill_amount": f"""WITH {PAYMENTS}
SELECT transaction_id,
       CASE WHEN event_id % 40 = 9 THEN CAST(0 AS DOUBLE) ELSE amount_egp END AS amount_egp
FROM payments""",
        "rule_fraud_score": f"WITH {SCORED} SELECT transaction_id, fraud_score FROM scored",
        "fraud_flag": f"WITH {SCORED} SELECT transaction_id, is_fraud FROM scored",
        "enriched_transactions": f"""WITH {WIRE},
filled AS (SELECT * REPLACE (COALESCE(amount_egp, 0) AS amount_egp) FROM parsed),
{_scored("filled")}
SELECT {TXN}, fraud_score, TRUE AS stamped FROM scored""",
        "quarantine": f"""WITH {CHECKED}
SELECT transaction_id, merchant_id, reject_reason FROM checked WHERE reject_reason <> ''""",
        "dedup_transactions": f"WITH {PAYMENTS} SELECT {TXN} FROM payments",
        "dedup_natural_keys": """SELECT * EXCLUDE (rn)
FROM (SELECT *, ROW_NUMBER() OVER (
        PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                 l_returnflag, l_linestatus) AS rn FROM lineitem) t
WHERE rn = 1""",
        "silver_transactions": f"""WITH {CHECKED}
SELECT transaction_id, event_time, customer_id, merchant_id, service_type,
       CAST(amount_egp AS DECIMAL(12,2)) AS amount_egp, governorate, payment_method, status,
       COALESCE(is_fraud, FALSE) AS is_fraud, CAST(fraud_score AS DECIMAL(5,4)) AS fraud_score,
       CAST(event_time AS DATE) AS event_date, source_flag
FROM clean""",
        "silver_incremental": f"""WITH {PAYMENTS},
delivered AS (
  SELECT transaction_id, event_time, amount_egp, is_fraud FROM payments
  UNION ALL
  SELECT transaction_id, event_time - INTERVAL 2 DAY, amount_egp, is_fraud
  FROM payments WHERE event_id % 15 = 2
  UNION ALL
  SELECT transaction_id, event_time + INTERVAL 1 DAY, amount_egp, is_fraud
  FROM payments WHERE event_id % 25 = 3
),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY transaction_id ORDER BY event_time) AS rn FROM delivered
)
SELECT transaction_id, event_time, CAST(amount_egp AS DECIMAL(12,2)) AS amount_egp,
       CAST(event_time AS DATE) AS event_date, is_fraud AS source_flag
FROM ranked WHERE rn = 1""",
        "daily_slice": f"""WITH {PAYMENTS}
SELECT {TXN} FROM payments
WHERE CAST(event_time AS DATE) = DATE '2024-01-29'""",
        "successful_payments": f"WITH {PAYMENTS} SELECT {TXN} FROM payments WHERE status = 'success'",
        "merchant_daily_summary": f"WITH {MERCHANT} SELECT * FROM merchant_summary",
        "governorate_daily_summary": f"WITH {GOVERNORATE} SELECT * FROM governorate_summary",
        "service_daily_rollup": f"WITH {ROLLUP} SELECT * FROM rollup",
        "summary_row_counts": f"""WITH {MERCHANT},
governorate_summary AS ({_daily("scored", "governorate")})
SELECT 'merchant' AS summary, summary_date, COUNT(*) AS row_count
FROM merchant_summary GROUP BY summary_date
UNION ALL
SELECT 'governorate' AS summary, summary_date, COUNT(*) AS row_count
FROM governorate_summary GROUP BY summary_date""",
        "service_history": f"""WITH {ROLLUP}
SELECT * FROM rollup ORDER BY summary_date DESC, service_type LIMIT 200""",
        "governorate_history": f"""WITH {GOVERNORATE}
SELECT * FROM governorate_summary ORDER BY summary_date DESC, governorate LIMIT 200""",
        "revenue_by_service": f"""WITH {PAYMENTS}
SELECT service_type, CAST(SUM(CAST(amount_egp AS DECIMAL(12,2))) AS DECIMAL(24,2)) AS revenue
FROM payments WHERE service_type <> '' GROUP BY service_type""",
        "fraud_signature_report": f"""WITH {PAYMENTS}
SELECT CAST(event_time AS DATE) AS event_date, service_type, COUNT(*) AS hits,
       CAST(SUM(CAST(amount_egp AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS amount_egp
FROM payments
WHERE amount_egp BETWEEN 15000 AND 50000 AND EXTRACT(hour FROM event_time) BETWEEN 1 AND 4
GROUP BY CAST(event_time AS DATE), service_type""",
        "amount_range_violations": f"""WITH {PAYMENTS},
ranges(service_type, low, high) AS (VALUES {_RANGES})
SELECT p.transaction_id, p.service_type, p.amount_egp, r.low, r.high
FROM payments p JOIN ranges r ON p.service_type = r.service_type
WHERE NOT p.amount_egp BETWEEN r.low AND r.high""",
        "summary_upsert": f"""WITH {SCORED},
placed AS (
  SELECT * REPLACE (CASE WHEN event_id % 90 <> 1 THEN governorate END AS governorate) FROM scored
),
old_rows AS (SELECT * REPLACE (source_flag AS is_fraud) FROM placed
             WHERE CAST(event_time AS DATE) < DATE '2024-01-29'),
new_rows AS (SELECT * FROM placed WHERE CAST(event_time AS DATE) >= DATE '2024-01-28'),
t AS ({_daily("old_rows", "governorate")}),
s AS ({_daily("new_rows", "governorate")})
SELECT * FROM s
UNION ALL
SELECT * FROM t WHERE NOT EXISTS (
  SELECT 1 FROM s WHERE s.summary_date = t.summary_date
                    AND s.governorate IS NOT DISTINCT FROM t.governorate)""",
        "counter_deltas": f"WITH {_COUNTERS} SELECT batch_id, metric, key, value FROM deltas",
        "live_kpis": f"""WITH {BATCHED},
newest AS (SELECT n_rows FROM sizes ORDER BY batch_id DESC LIMIT 60),
totals AS (
  SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS fraud,
         CAST(SUM(CAST(amount_egp AS DECIMAL(12,2))) AS DECIMAL(24,2)) AS revenue
  FROM batched
)
SELECT n AS total_transactions, fraud AS total_fraud, revenue AS total_revenue,
       ROUND(CAST(fraud AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(n AS DOUBLE), 2) AS fraud_rate,
       (SELECT ROUND(AVG(CAST(n_rows AS DOUBLE)), 2) FROM newest) AS avg_rows_per_batch
FROM totals""",
        "live_by_service": f"""WITH {PAYMENTS}
SELECT service_type, COUNT(*) AS cnt FROM payments WHERE service_type <> '' GROUP BY service_type""",
        "live_by_governorate": f"""WITH {PAYMENTS}
SELECT governorate, COUNT(*) AS cnt FROM payments WHERE governorate <> '' GROUP BY governorate""",
        "service_ranking": f"""WITH {PAYMENTS}
SELECT service_type, COUNT(*) AS cnt,
       ROW_NUMBER() OVER (ORDER BY COUNT(*), service_type) AS "position"
FROM payments WHERE service_type <> '' GROUP BY service_type""",
        "governorate_ranking": f"""WITH {PAYMENTS}
SELECT governorate, COUNT(*) AS cnt,
       ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, governorate) AS "position"
FROM payments WHERE governorate <> '' GROUP BY governorate""",
        "batch_sizes": f"WITH {BATCHED} SELECT batch_id, n_rows FROM sizes",
        "batch_size_window": f"""WITH {BATCHED}
SELECT batch_id, n_rows FROM sizes ORDER BY batch_id DESC LIMIT 60""",
        "avg_rows_per_batch": f"""WITH {BATCHED}
SELECT ROUND(AVG(CAST(n_rows AS DOUBLE)), 2) AS avg_rows
FROM (SELECT n_rows FROM sizes ORDER BY batch_id DESC LIMIT 60) newest""",
        "rolling_batch_mean": f"""WITH {BATCHED}
SELECT batch_id,
       ROUND(AVG(CAST(n_rows AS DOUBLE)) OVER (ORDER BY batch_id
             ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 2) AS rolling_mean
FROM sizes""",
        "batch_audit": f"""WITH {BATCHED},
audit AS (
  SELECT batch_id, COUNT(*) AS n_rows,
         CAST(SUM(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS n_fraud,
         MIN(event_time) AS first_event, MAX(event_time) AS last_event
  FROM batched GROUP BY batch_id
)
SELECT *, ROUND(CAST(n_rows AS DOUBLE) * CAST(1000000 AS DOUBLE)
                / NULLIF(CAST(epoch_us(last_event) - epoch_us(first_event) AS DOUBLE), 0), 6)
          AS rows_per_second
FROM audit""",
        "amount_percentile": f"WITH {PERCENTILE} SELECT transaction_id, amount_pct FROM percentiles",
        "label_encoding": f"""WITH {PAYMENTS}, {_code_ctes()}
SELECT transaction_id, service_enc.service_enc, gov_enc.gov_enc, payment_enc.payment_enc
FROM payments {_CODE_JOINS}""",
        "fraud_features": f"""WITH {PERCENTILE}, {_code_ctes()}
SELECT transaction_id, amount_egp, service_enc.service_enc, gov_enc.gov_enc,
       payment_enc.payment_enc,
       CAST(EXTRACT(hour FROM event_time) AS INT) AS hour_of_day, amount_pct,
       CAST(CASE WHEN EXTRACT(hour FROM event_time) <= 4 THEN 1 ELSE 0 END AS INT) AS odd_hour,
       LEAST(amount_egp / CAST(50000 AS DOUBLE), CAST(1 AS DOUBLE)) AS amount_ratio
FROM percentiles {_CODE_JOINS}""",
        "fraud_tree_splits": _tree_splits(),
        "fraud_tree_scores": _tree_scores(),
        "label_profile": f"""WITH {LABELLED}
SELECT COUNT(*) AS n_rows, ROUND(AVG(CASE WHEN is_fraud THEN CAST(1 AS DOUBLE) ELSE 0 END), 8)
       AS label_mean
FROM labelled""",
        "stratified_split": f"""WITH {LABELLED}
SELECT transaction_id, CASE WHEN r <= CAST(n AS DOUBLE) * 0.8 THEN 'train' ELSE 'test' END AS split
FROM (SELECT transaction_id,
             ROW_NUMBER() OVER (PARTITION BY is_fraud
                                ORDER BY md5(CONCAT(transaction_id, ':42')), transaction_id) AS r,
             COUNT(*) OVER (PARTITION BY is_fraud) AS n
      FROM labelled) t""",
        "class_weights": f"""WITH {LABELLED},
classes AS (SELECT is_fraud, COUNT(*) AS n FROM labelled GROUP BY is_fraud)
SELECT is_fraud, n,
       ROUND(CAST((SELECT SUM(n) FROM classes) AS DOUBLE)
             / CAST((SELECT COUNT(*) FROM classes) * n AS DOUBLE), 8) AS weight
FROM classes""",
        "confusion_matrix": f"""WITH {JUDGED}
SELECT truth AS label, verdict AS prediction, COUNT(*) AS n FROM judged GROUP BY truth, verdict""",
        "classification_report": f"""WITH {JUDGED},
cells AS (
  SELECT SUM(CASE WHEN truth AND verdict THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN NOT truth AND verdict THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN truth AND NOT verdict THEN 1 ELSE 0 END) AS fn,
         SUM(CASE WHEN NOT truth AND NOT verdict THEN 1 ELSE 0 END) AS tn
  FROM judged
)
{_class_row("Legit", "tn", "fn", "fp")}
UNION ALL
{_class_row("Fraud", "tp", "fp", "fn")}""",
        "roc_auc": f"""WITH {JUDGED},
g AS (
  SELECT fraud_score, CAST(SUM(CASE WHEN truth THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
         CAST(SUM(CASE WHEN truth THEN 0 ELSE 1 END) AS DOUBLE) AS neg
  FROM judged GROUP BY fraud_score
),
c AS (
  SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY fraud_score
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM g
)
SELECT ROUND(SUM(pos * (below + neg * CAST(0.5 AS DOUBLE))) / (SUM(pos) * SUM(neg)), 6) AS auc
FROM c""",
        "train_fraud_model": f"""WITH {LABELLED},
ranked AS (
  SELECT is_fraud, ROW_NUMBER() OVER (PARTITION BY is_fraud
                     ORDER BY md5(CONCAT(transaction_id, ':42')), transaction_id) AS r,
         COUNT(*) OVER (PARTITION BY is_fraud) AS n
  FROM labelled
)
SELECT is_fraud AS label, COUNT(*) AS support, COUNT(*) AS predicted
FROM ranked WHERE r > CAST(n AS DOUBLE) * 0.8 GROUP BY is_fraud""",
        "ml_fraud_score": f"""WITH {SCORED}
SELECT transaction_id, fraud_score AS rule_score, TRUE AS in_range, TRUE AS rounded,
       TRUE AS used, TRUE AS flag_follows FROM scored""",
        "stream_ingest": CLEAN_TXN,
        "stream_dedup": CLEAN_TXN,
        "bronze_sink": f"WITH {WIRE} SELECT {TXN} FROM parsed",
        "warehouse_sink": WAREHOUSE,
        "stream_returning_ids": WAREHOUSE,
        "stream_commits": f"""WITH {CHECKED}
SELECT COUNT(*) AS n_read,
       COUNT(*) FILTER (WHERE reject_reason <> '') AS n_rejected,
       (SELECT COUNT(*) FROM clean) AS n_stored,
       COUNT(*) FILTER (WHERE reject_reason <> '') AS n_quarantined
FROM checked""",
        "stream_late_rows": f"""WITH {CHECKED},
reached AS (SELECT MAX(event_time) AS high FROM clean WHERE event_id % 15 <> 4)
SELECT transaction_id, event_time, governorate, amount_egp FROM clean, reached
WHERE event_id % 15 = 4
  AND date_trunc('day', event_time) + INTERVAL 1 DAY <= high - INTERVAL 1 DAY""",
        "stream_totals_with_late": f"WITH {CHECKED} {_daily('clean', 'governorate')}",
        "stream_fanout": f"""WITH {CHECKED},
stored AS (
  SELECT COUNT(*) AS n_rows, CAST(SUM(CASE WHEN is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS n_fraud,
         CAST(SUM(CAST(amount_egp AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS amount_egp
  FROM clean
)
SELECT 'counters' AS target, * FROM stored
UNION ALL
SELECT 'warehouse' AS target, * FROM stored
UNION ALL
SELECT 'quarantine' AS target, COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_fraud,
       CAST(0 AS DECIMAL(22,2)) AS amount_egp
FROM checked WHERE reject_reason <> ''""",
        "stream_merchant_summary": f"""WITH {CHECKED}
{_daily('clean', 'merchant_id, service_type')}""",
        "stream_daily_summary": f"WITH {CHECKED} {_daily('clean', 'governorate')}",
    }
