"""The expected result of each query, as one SQL text over the given tables.

Written apart from the Spark code: windows and joins are spelled out the simple way.
"""

from __future__ import annotations

RUN_TS = "TIMESTAMP '2024-02-01 06:00:00'"
RUN_DATE = "DATE '2024-02-01'"
RUN_ID = "run-20240201"
SILVER = "merchant_id, campaign_id, market, date, spend, impressions, clicks, ingestion_ts"

# --- Sources as common table expressions ----------------------------------------------

SRC = """
src AS (
  SELECT CAST(user_id AS VARCHAR) AS merchant_id,
         json_extract_string(props, '$.k') AS campaign_id,
         event_type AS market,
         CAST(ts AS DATE) AS date,
         CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN -value
              ELSE value END AS spend,
         CAST(CASE WHEN event_id % 53 = 0 THEN 0 ELSE event_id % 100 END AS INTEGER) AS impressions,
         CAST(event_id % 7 AS INTEGER) AS clicks,
         ts AS ingestion_ts
  FROM events)"""

MISSING = """
src AS (
  SELECT CASE WHEN event_id % 59 <> 0 THEN CAST(user_id AS VARCHAR) END AS merchant_id,
         CASE WHEN event_id % 61 <> 0 THEN json_extract_string(props, '$.k') END AS campaign_id,
         CASE WHEN event_id % 71 <> 0 THEN event_type END AS market,
         CASE WHEN event_id % 67 <> 0 THEN CAST(ts AS DATE) END AS date,
         CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN -value
              ELSE value END AS spend,
         CAST(CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 53 = 0 THEN 0
              ELSE event_id % 100 END AS INTEGER) AS impressions,
         CAST(CASE WHEN event_id % 47 <> 0 THEN event_id % 7 END AS INTEGER) AS clicks,
         CASE WHEN event_id % 73 <> 0 THEN ts END AS ingestion_ts
  FROM events)"""

STRICT = """
src AS (
  SELECT CASE WHEN event_id % 59 <> 0 THEN CAST(user_id AS VARCHAR) END AS merchant_id,
         CASE WHEN event_id % 61 <> 0 THEN json_extract_string(props, '$.k') END AS campaign_id,
         CASE WHEN event_id % 71 <> 0 THEN event_type END AS market,
         CASE WHEN event_id % 67 <> 0 THEN CAST(ts AS DATE) END AS date,
         CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 79 = 0 THEN 'NaN'::DOUBLE
              ELSE value END AS spend,
         CAST(CASE WHEN event_id % 83 = 0 THEN -5 ELSE event_id % 100 END AS INTEGER) AS impressions,
         CAST(CASE WHEN event_id % 89 = 0 THEN -1 ELSE event_id % 7 END AS INTEGER) AS clicks,
         CASE WHEN event_id % 73 <> 0 THEN ts END AS ingestion_ts
  FROM events)"""

LINES = f"""
src AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS merchant_id,
         CAST(l_partkey AS VARCHAR) AS campaign_id,
         r_name AS market,
         CAST(l_shipdate AS DATE) AS date,
         l_extendedprice AS spend,
         CAST(l_quantity AS INTEGER) AS impressions,
         l_linenumber AS clicks,
         {RUN_TS} AS ingestion_ts
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

TYPED = """,
typed AS (
  SELECT merchant_id, campaign_id, market, date, spend,
         CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks,
         ingestion_ts
  FROM src)"""

REASONS = {
    "missing_merchant_id": "merchant_id IS NULL",
    "missing_campaign_id": "campaign_id IS NULL",
    "invalid_or_missing_date": "date IS NULL",
    "missing_spend": "spend IS NULL",
    "negative_spend": "spend < 0",
    "clicks_exceed_impressions": "clicks > impressions",
}
STRICT_REASONS = REASONS | {
    "missing_market": "market IS NULL OR market IN ('', '__unknown__')",
    "missing_ingestion_ts": "ingestion_ts IS NULL",
    "spend_not_a_number": "isnan(spend)",
    "negative_impressions": "impressions < 0",
    "negative_clicks": "clicks < 0",
}


def _flag(reason: str, predicate: str) -> str:
    return f"CASE WHEN {predicate} THEN '{reason}' END"


def _checked(reasons: dict[str, str] = REASONS) -> str:
    flags = ", ".join(_flag(r, p) for r, p in reasons.items())
    return f""",
checked AS (SELECT *, concat_ws(',', {flags}) AS _rejection_reason FROM typed)"""


def _latest(keys: str, order: str, source: str = "checked WHERE _rejection_reason = ''") -> str:
    return f""",
latest AS (
  SELECT {SILVER} FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source})
  WHERE rn = 1)"""


def _desc(*columns: str) -> str:
    return ", ".join(f"{c} DESC NULLS LAST" for c in columns)


BY_KEY = _latest(
    "merchant_id, campaign_id, date",
    _desc("ingestion_ts", "market", "spend", "impressions", "clicks"),
)

FILLED = f"""
  SELECT coalesce(merchant_id, '') AS merchant_id, coalesce(campaign_id, '') AS campaign_id,
         coalesce(market, '') AS market, coalesce(date, DATE '1970-01-01') AS date,
         spend, impressions, clicks, coalesce(ingestion_ts, {RUN_TS}) AS ingestion_ts"""

NAMED = FILLED.replace("coalesce(market, '')", "coalesce(nullif(market, ''), '__unknown__')")

STAR = f""",
silver AS ({NAMED} FROM latest),
dim_merchant AS (
  SELECT row_number() OVER (ORDER BY merchant_id NULLS LAST) AS merchant_key, merchant_id,
         {RUN_DATE} AS effective_date
  FROM (SELECT DISTINCT merchant_id FROM silver)),
dim_market AS (
  SELECT row_number() OVER (ORDER BY market NULLS LAST) AS market_key, market,
         {RUN_DATE} AS effective_date
  FROM (SELECT DISTINCT market FROM silver)),
fact AS (
  SELECT m.merchant_key, k.market_key, e.campaign_id, e.date, e.spend, e.impressions, e.clicks,
         CASE WHEN e.impressions > 0 THEN e.clicks::DOUBLE / e.impressions ELSE 0.0::DOUBLE END AS ctr,
         CASE WHEN e.clicks > 0 THEN e.spend / e.clicks ELSE 0.0::DOUBLE END AS cost_per_click
  FROM silver e
  JOIN dim_merchant m ON e.merchant_id = m.merchant_id
  JOIN dim_market k ON e.market = k.market)"""

_TYPED = f"WITH {SRC}{TYPED}"
_TYPED_MISSING = f"WITH {MISSING}{TYPED}"
_LATEST = f"WITH {SRC}{TYPED}{_checked()}{BY_KEY}"
_STAR = f"{_LATEST}{STAR}"
_STAR_MISSING = f"WITH {MISSING}{TYPED}{_checked()}{BY_KEY}{STAR}"


RESENT_ROWS = """,
late AS (
  SELECT CAST(user_id AS VARCHAR) AS merchant_id,
         json_extract_string(props, '$.k') AS campaign_id,
         CASE WHEN user_id % 10 = 0 THEN 'view' ELSE event_type END AS market,
         CAST(ts AS DATE) AS date,
         CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 41 = 0 THEN -value
              ELSE value + 1 END AS spend,
         CAST(CASE WHEN event_id % 53 = 0 THEN 0 ELSE event_id % 100 END AS INTEGER) AS impressions,
         CAST(event_id % 7 AS INTEGER) AS clicks,
         TIMESTAMP '2024-02-01 06:00:00' AS ingestion_ts
  FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-21')"""


def _silver_of(source: str, name: str) -> str:
    """The silver rows out of one source, by way of a single query."""
    broken = " OR ".join(f"coalesce({p}, false)" for p in REASONS.values())
    return f""",
{name} AS (
  SELECT {SILVER.replace("impressions, clicks", "CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks")}
  FROM (
    SELECT *, row_number() OVER (PARTITION BY merchant_id, campaign_id, date
                                 ORDER BY {_desc("ingestion_ts", "market", "spend", "impressions", "clicks")}) AS rn
    FROM {source} WHERE NOT ({broken}))
  WHERE rn = 1)"""


_BATCHES = f"""WITH {SRC}{RESENT_ROWS},
both_batches AS (SELECT * FROM src UNION ALL SELECT * FROM late)"""

HISTORY = f""",
days AS (
  SELECT * FROM (VALUES (1, DATE '2024-01-11'), (2, DATE '2024-01-21'), (3, DATE '2024-01-31'))
  d(k, day)),
states AS (
  SELECT k, merchant_id, home_market FROM (
    SELECT k, merchant_id, market AS home_market,
           row_number() OVER (PARTITION BY k, merchant_id
                              ORDER BY ingestion_ts DESC, market DESC) AS rn
    FROM silver JOIN days ON date >= day - 10 AND date < day)
  WHERE rn = 1),
grid AS (
  SELECT m.merchant_id, d.k, d.day, s.home_market
  FROM (SELECT DISTINCT merchant_id FROM states) m CROSS JOIN days d
  LEFT JOIN states s ON s.merchant_id = m.merchant_id AND s.k = d.k),
marked AS (
  SELECT *, CASE WHEN home_market IS DISTINCT FROM
                      lag(home_market) OVER (PARTITION BY merchant_id ORDER BY k)
                 THEN 1 ELSE 0 END AS changed
  FROM grid),
islands AS (
  SELECT *, sum(changed) OVER (PARTITION BY merchant_id ORDER BY k) AS island FROM marked),
homes AS (
  SELECT merchant_id, home_market, min(day) AS valid_from,
         CASE max(k) WHEN 1 THEN DATE '2024-01-21' WHEN 2 THEN DATE '2024-01-31' END AS valid_to
  FROM islands WHERE home_market IS NOT NULL GROUP BY merchant_id, island, home_market)"""

STABLE = """,
known AS (
  SELECT row_number() OVER (ORDER BY merchant_id NULLS LAST) AS merchant_key, merchant_id
  FROM (SELECT DISTINCT merchant_id FROM silver WHERE date = DATE '2024-01-01')),
stable AS (
  SELECT merchant_key, merchant_id, DATE '2024-02-01' AS effective_date FROM known
  UNION ALL
  SELECT (SELECT coalesce(max(merchant_key), 0) FROM known)
           + row_number() OVER (ORDER BY merchant_id NULLS LAST),
         merchant_id, DATE '2024-02-02'
  FROM (SELECT DISTINCT merchant_id FROM silver
        WHERE merchant_id NOT IN (SELECT merchant_id FROM known))),
known_markets AS (
  SELECT row_number() OVER (ORDER BY market) AS market_key, market
  FROM (SELECT DISTINCT market FROM silver WHERE date = DATE '2024-01-01')),
stable_markets AS (
  SELECT market_key, market FROM known_markets
  UNION ALL
  SELECT (SELECT coalesce(max(market_key), 0) FROM known_markets)
           + row_number() OVER (ORDER BY market), market
  FROM (SELECT DISTINCT market FROM silver
        WHERE market NOT IN (SELECT market FROM known_markets)))"""


def _rejects(with_clause: str, reasons: dict[str, str]) -> str:
    return f"""{with_clause}{_checked(reasons)}
SELECT {SILVER}, _rejection_reason, {RUN_TS} AS _quarantined_at
FROM checked WHERE _rejection_reason <> ''"""


def _pick(*names: str) -> dict[str, str]:
    return {n: REASONS[n] for n in names}


def _not_null(table: str, *columns: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT 'not_null' AS \"check\", '{table}' AS table_name, '{c}' AS column_name, "
        f"count(*) FILTER (WHERE {c} IS NULL) AS failures FROM {table}"
        for c in columns
    )


def _unique(table: str, *columns: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT 'unique', '{table}', '{c}', count(*) FROM (SELECT {c} FROM {table} "
        f"WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)"
        for c in columns
    )


def _relationships(child: str, column: str, parent: str, parent_column: str) -> str:
    return (
        f"SELECT 'relationships', '{child}', '{column}', count(*) FROM {child} c "
        f"WHERE c.{column} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {parent} p WHERE p.{parent_column} = c.{column})"
    )


_FACT = f"{_STAR} SELECT * FROM fact"
_DIM_MERCHANT = f"{_STAR} SELECT * FROM dim_merchant"
_DIM_MARKET = f"{_STAR} SELECT * FROM dim_market"
_SILVER_MISSING = f"{_STAR_MISSING} SELECT * FROM silver"

_REPORT = "\nUNION ALL\n".join(
    [
        _not_null("dim_merchant", "merchant_key", "merchant_id"),
        _not_null("dim_market", "market_key", "market"),
        _not_null(
            "fact", "merchant_key", "market_key", "ctr", "cost_per_click"
        ).replace("'fact'", "'fact_campaign_daily'"),
        _unique("dim_merchant", "merchant_key", "merchant_id"),
        _unique("dim_market", "market_key", "market"),
        _relationships("fact", "merchant_key", "dim_merchant", "merchant_key").replace(
            "'fact'", "'fact_campaign_daily'"
        ),
        _relationships("fact", "market_key", "dim_market", "market_key").replace(
            "'fact'", "'fact_campaign_daily'"
        ),
    ]
)

ORACLES = {
    "bronze_typed_scan": f"""WITH {SRC}
SELECT merchant_id, campaign_id, market, date, spend, impressions, clicks FROM src""",
    "bronze_stamp": f"""WITH {SRC}
SELECT merchant_id, campaign_id, market, date, spend, impressions, clicks,
       {RUN_TS} AS ingestion_ts FROM src""",
    "events_by_market": f"WITH {SRC} SELECT market, count(*) AS row_count FROM src GROUP BY market",
    "distinct_counts": f"""WITH {SRC}
SELECT count(DISTINCT merchant_id) AS n_merchant_id, count(DISTINCT campaign_id) AS n_campaign_id,
       count(DISTINCT market) AS n_market, count(DISTINCT date) AS n_date FROM src""",
    "cast_columns": """
SELECT CAST(user_id AS VARCHAR) AS merchant_id,
       json_extract_string(props, '$.k') AS campaign_id,
       event_type AS market,
       CASE WHEN event_id % 43 <> 0 THEN CAST(ts AS DATE) END AS date,
       CASE WHEN event_id % 37 <> 0 THEN value END AS spend,
       CASE WHEN event_id % 47 <> 0 AND event_id % 53 <> 0 THEN event_id % 100 END AS impressions,
       CASE WHEN event_id % 61 <> 0 THEN event_id % 7 END AS clicks,
       CASE WHEN event_id % 59 <> 0 THEN ts END AS ingestion_ts
FROM events""",
    "rule_missing": _rejects(
        _TYPED_MISSING,
        _pick(
            "missing_merchant_id",
            "missing_campaign_id",
            "invalid_or_missing_date",
            "missing_spend",
        ),
    ),
    "rule_negative_spend": _rejects(_TYPED, _pick("negative_spend")),
    "rule_clicks_exceed": _rejects(_TYPED, _pick("clicks_exceed_impressions")),
    "rule_negative_balance": f"""
SELECT *, 'negative_balance' AS _rejection_reason, {RUN_TS} AS _quarantined_at
FROM customer WHERE c_acctbal < 0""",
    "rule_flags": f"""{_TYPED_MISSING}{_checked()}
SELECT {SILVER}, {", ".join(f"{_flag(r, p)} AS _fail_{r}" for r, p in REASONS.items())},
       _rejection_reason
FROM checked""",
    "rejection_reason": f"""{_TYPED_MISSING}{_checked()}
SELECT _rejection_reason, count(*) AS row_count FROM checked GROUP BY _rejection_reason""",
    "clean_split": f"""{_TYPED_MISSING}{_checked()}
SELECT {SILVER} FROM checked WHERE _rejection_reason = ''""",
    "rejected_split": _rejects(_TYPED_MISSING, REASONS),
    "rejects_by_reason": f"""{_TYPED}{_checked()}
SELECT _rejection_reason, count(*) AS row_count FROM checked
WHERE _rejection_reason <> '' GROUP BY _rejection_reason""",
    "rejects_by_reason_strict": f"""WITH {STRICT}{TYPED}{_checked(STRICT_REASONS)}
SELECT _rejection_reason, count(*) AS row_count FROM checked
WHERE _rejection_reason <> '' GROUP BY _rejection_reason""",
    "rejects_by_reason_shipped": f"""WITH {LINES}{TYPED}{_checked()}
SELECT _rejection_reason, count(*) AS row_count FROM checked
WHERE _rejection_reason <> '' GROUP BY _rejection_reason""",
    "split_is_partition": f"""{_TYPED_MISSING}{_checked()}
SELECT 'input' AS part, count(*) AS row_count FROM checked
UNION ALL SELECT 'clean', count(*) FROM checked WHERE _rejection_reason = ''
UNION ALL SELECT 'rejected', count(*) FROM checked WHERE _rejection_reason <> ''""",
    "dedup_latest": f"{_LATEST} SELECT * FROM latest",
    "dedup_latest_by_grain": f"""{_TYPED}{_checked()}{_latest(
        "merchant_id, campaign_id, date, market",
        _desc("ingestion_ts", "spend", "impressions", "clicks"),
    )} SELECT * FROM latest""",
    "dedup_latest_merchant_day": f"""{_TYPED_MISSING}{_checked()}{_latest(
        "merchant_id, date",
        _desc("ingestion_ts", "campaign_id", "market", "spend", "impressions", "clicks"),
    )} SELECT * FROM latest""",
    "dedup_latest_tied": f"""WITH {SRC},
stamped AS (SELECT * REPLACE ({RUN_TS} AS ingestion_ts) FROM src){_latest(
        "merchant_id, date",
        _desc("campaign_id", "market", "spend", "impressions", "clicks"),
        "stamped",
    )} SELECT * FROM latest""",
    "dedup_latest_shipped": f"""WITH {LINES}{TYPED}{_checked()}{_latest(
        "merchant_id, date",
        _desc("ingestion_ts", "campaign_id", "market", "spend", "impressions", "clicks"),
    )} SELECT * FROM latest""",
    "dedup_stats": f"""{_TYPED}{_checked()},
per_key AS (
  SELECT count(*) AS copies FROM checked WHERE _rejection_reason = ''
  GROUP BY merchant_id, campaign_id, date)
SELECT CAST(sum(copies) AS BIGINT) AS row_count, count(*) AS key_count,
       CAST(sum(copies) - count(*) AS BIGINT) AS duplicates_dropped FROM per_key""",
    "coalesce_required": f"{_TYPED_MISSING} {FILLED} FROM typed",
    "schema_conform": f"{_TYPED_MISSING} {FILLED} FROM typed",
    "silver_events": _SILVER_MISSING,
    "silver_events_strict": f"""WITH {STRICT}{TYPED}{_checked(STRICT_REASONS)}{_latest(
        "merchant_id, campaign_id, date, market",
        _desc("ingestion_ts", "spend", "impressions", "clicks"),
    )} SELECT * FROM latest""",
    "distinct_members": f"{_TYPED} SELECT DISTINCT merchant_id FROM typed",
    "dim_merchant": _DIM_MERCHANT,
    "dim_market": _DIM_MARKET,
    "dim_campaign_part": f"""WITH {LINES}
SELECT row_number() OVER (ORDER BY campaign_id) AS campaign_key, campaign_id,
       {RUN_DATE} AS effective_date
FROM (SELECT DISTINCT campaign_id FROM src)""",
    "metric_ctr": f"""{_TYPED_MISSING}
SELECT impressions, clicks,
       CASE WHEN impressions > 0 THEN clicks::DOUBLE / impressions ELSE 0.0::DOUBLE END AS ctr
FROM typed""",
    "metric_cpc": f"""{_TYPED_MISSING}
SELECT spend, clicks,
       CASE WHEN clicks > 0 THEN spend / clicks ELSE 0.0::DOUBLE END AS cost_per_click
FROM typed""",
    "fact_join_merchant": f"""{_STAR}
SELECT s.*, m.merchant_key FROM silver s JOIN dim_merchant m ON s.merchant_id = m.merchant_id""",
    "fact_join_market": f"""{_STAR}
SELECT s.*, k.market_key FROM silver s JOIN dim_market k ON s.market = k.market""",
    "fact_campaign_daily": _FACT,
    "fact_campaign_daily_shipped": f"""WITH {LINES}{TYPED}{_checked()}{BY_KEY}{STAR}
SELECT * FROM fact""",
    "dim_merchant_sql": _DIM_MERCHANT,
    "dim_market_sql": _DIM_MARKET,
    "fact_campaign_daily_sql": _FACT,
    "dq_not_null": f"{_TYPED_MISSING} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS failures FROM typed"
        for c in SILVER.split(", ")
    ),
    "dq_unique": f"""{_TYPED_MISSING}
SELECT merchant_id AS value, count(*) AS copies FROM typed WHERE merchant_id IS NOT NULL
GROUP BY merchant_id HAVING count(*) > 1""",
    "dq_relationships": f"""{_TYPED_MISSING}
SELECT campaign_id AS value, count(*) AS row_count FROM typed
WHERE campaign_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE CAST(l_partkey AS VARCHAR) = typed.campaign_id)
GROUP BY campaign_id""",
    "dq_report": f"{_STAR_MISSING}\n{_REPORT}",
    "dq_report_with_failures": f"""{_STAR_MISSING.replace("dim_merchant AS (", "all_merchants AS (").replace("dim_market AS (", "all_markets AS (").replace("JOIN dim_merchant m", "JOIN all_merchants m").replace("JOIN dim_market k", "JOIN all_markets k")},
dim_merchant AS (
  SELECT * FROM all_merchants UNION ALL SELECT * FROM all_merchants WHERE merchant_key <= 3),
dim_market AS (SELECT * FROM all_markets WHERE market_key <> 2)
{_REPORT}""",
    "dq_report_incremental": f"""{_STAR.replace("fact AS (", "all_facts AS (")},
fact AS (
  SELECT CASE WHEN date = DATE '2024-01-10' THEN -merchant_key ELSE merchant_key END AS merchant_key,
         market_key, campaign_id, date, spend, impressions, clicks,
         CASE WHEN date = DATE '2024-01-10' THEN nullif(ctr, 0.0) ELSE ctr END AS ctr,
         cost_per_click
  FROM all_facts)
{_REPORT}""",
    "fact_by_market_name": f"""{_STAR}
SELECT fact.*, market FROM fact JOIN dim_market USING (market_key)
WHERE market IN ('click', 'view')""",
    "silver_of_one_merchant": f"""{_STAR}
SELECT * FROM silver WHERE merchant_id = '8'""",
    "fact_join_hot_merchant": f"""WITH {LINES},
lines AS (
  SELECT CASE WHEN clicks % 3 = 0 THEN '1' ELSE merchant_id END AS merchant_id,
         campaign_id, date, spend
  FROM src),
members AS (
  SELECT row_number() OVER (ORDER BY merchant_id NULLS LAST) AS merchant_key, merchant_id
  FROM (SELECT DISTINCT merchant_id FROM lines))
SELECT campaign_id, date, spend, merchant_key FROM lines JOIN members USING (merchant_id)""",
    "silver_scan": f"{_STAR} SELECT * FROM silver",
    "sink_bronze_roundtrip": f"WITH {SRC} SELECT {SILVER} FROM src",
    "sink_silver_roundtrip": _SILVER_MISSING,
    "sink_failed_overwrite": f"{_STAR} SELECT * FROM silver",
    "sink_fact_unknown_market": f"{_STAR_MISSING} SELECT * FROM fact",
    "quarantine_by_name": f"""{_TYPED}{_checked()}
SELECT _rejection_reason, count(*) AS row_count FROM checked
WHERE _rejection_reason <> '' GROUP BY _rejection_reason""",
    "market_layout": f"""WITH {SRC}
SELECT market, count(*) AS row_count, CAST(1 AS BIGINT) AS partition_count
FROM src GROUP BY market""",
    "dedup_audit": f"""{_TYPED_MISSING}{_checked()}
SELECT merchant_id, date, count(*) AS copies, max(ingestion_ts) AS won_by
FROM checked WHERE _rejection_reason = '' GROUP BY merchant_id, date HAVING count(*) > 1""",
    "reject_rates": f"""{_TYPED_MISSING}{_checked()}
SELECT date, _rejection_reason, count(*) AS row_count,
       round(count(*) / sum(count(*)) OVER (PARTITION BY date), 6) AS share
FROM checked GROUP BY date, _rejection_reason""",
    "fact_campaign_daily_nan": f"""WITH {STRICT}{TYPED}{_checked()}{BY_KEY}{STAR}
SELECT * FROM fact""",
    "daily_rollup": f"""{_STAR}
SELECT date, market, CAST(sum(CAST(spend AS DECIMAL(28, 6))) AS DOUBLE) AS spend,
       CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
       CASE WHEN sum(impressions) > 0 THEN sum(clicks)::DOUBLE / sum(impressions)
            ELSE 0.0::DOUBLE END AS ctr,
       CASE WHEN sum(clicks) > 0
            THEN CAST(sum(CAST(spend AS DECIMAL(28, 6))) AS DOUBLE) / sum(clicks)
            ELSE 0.0::DOUBLE END AS cost_per_click
FROM silver GROUP BY date, market""",
    "dq_orphan_parts": f"""{_TYPED_MISSING}
SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS row_count FROM lineitem
WHERE l_partkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM typed WHERE campaign_id = CAST(l_partkey AS VARCHAR))
GROUP BY l_partkey""",
    "sink_rejected_roundtrip": f"""{_TYPED}{_checked()}
SELECT {SILVER}, _rejection_reason, {RUN_TS} AS _quarantined_at, '{RUN_ID}' AS run_id
FROM checked WHERE _rejection_reason <> ''""",
    "sink_dim_roundtrip": _DIM_MERCHANT,
    "sink_fact_roundtrip": _FACT,
    "sink_sql_model_roundtrip": _FACT,
    "partition_pruned_read": f"""{_STAR}
SELECT * FROM silver
WHERE market = 'click' AND date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""",
    "sink_read_across_replacement": f"""{_STAR_MISSING}
SELECT * FROM silver""",
    "silver_late_batch": f"""{_BATCHES}{_silver_of("both_batches", "merged")}
SELECT * FROM merged""",
    "late_batch_directories": f"""{_BATCHES}{_silver_of("src", "before")}{_silver_of("late", "batch")}{_silver_of("both_batches", "merged")},
touched AS (
  SELECT market, date FROM batch
  UNION
  SELECT b.market, b.date FROM before b JOIN batch n
    ON b.merchant_id = n.merchant_id AND b.campaign_id = n.campaign_id AND b.date = n.date)
SELECT DISTINCT m.market, m.date, t.market IS NULL AS kept
FROM merged m LEFT JOIN touched t ON m.market = t.market AND m.date = t.date""",
    "quarantine_widened": f"""{_TYPED}{_checked()}
SELECT {SILVER}, _rejection_reason, {RUN_TS} AS _quarantined_at,
       CASE WHEN market IN ('click', 'view', 'error') THEN 'run-narrow' ELSE 'run-wide' END AS run_id
FROM checked WHERE _rejection_reason <> ''""",
    "dim_merchant_stable": f"""{_STAR}{STABLE}
SELECT * FROM stable""",
    "sink_fact_stable_keys": f"""{_STAR}{STABLE}
SELECT m.merchant_key, k.market_key, e.campaign_id, e.date, e.spend, e.impressions, e.clicks,
       CASE WHEN e.impressions > 0 THEN e.clicks::DOUBLE / e.impressions ELSE 0.0::DOUBLE END AS ctr,
       CASE WHEN e.clicks > 0 THEN e.spend / e.clicks ELSE 0.0::DOUBLE END AS cost_per_click
FROM silver e
JOIN stable m ON e.merchant_id = m.merchant_id
JOIN stable_markets k ON e.market = k.market""",
    "dim_merchant_history": f"""{_STAR}{HISTORY}
SELECT * FROM homes""",
    "fact_point_in_time": f"""{_STAR}{HISTORY}
SELECT e.merchant_id, e.campaign_id, e.market, e.date, e.spend, h.home_market, h.valid_from
FROM silver e LEFT JOIN homes h
  ON h.merchant_id = e.merchant_id AND h.valid_from <= e.date
 AND (h.valid_to IS NULL OR e.date < h.valid_to)""",
    "preview_topn": f"""{_STAR}
SELECT * FROM silver ORDER BY {", ".join(f"{c} ASC NULLS LAST" for c in SILVER.split(", "))}
LIMIT 10""",
    "layer_counts": f"""{_STAR}
SELECT 'bronze' AS layer, count(*) AS row_count FROM src
UNION ALL SELECT 'silver', count(*) FROM silver
UNION ALL SELECT 'rejected', count(*) FROM checked WHERE _rejection_reason <> ''
UNION ALL SELECT 'dim_merchant', count(*) FROM dim_merchant
UNION ALL SELECT 'dim_market', count(*) FROM dim_market
UNION ALL SELECT 'fact_campaign_daily', count(*) FROM fact""",
}
