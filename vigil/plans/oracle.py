"""DuckDB SQL stating the result of each named query.

The canonical event view is inlined as a CTE so each statement runs against
the pre-registered driver tables alone.
"""

from __future__ import annotations

import json
import os
import re as _re

from vigil.schemas import (ALERT_RULE_TEXT, ALERT_SUMMARY_HEADER, CHAT_COLOR, CHAT_ICON, DEVICE_TYPES,
                           EVENT_TYPES, INFERENCE_DEFAULTS, INSIGHT_FINDING_TEMPLATES, INSIGHT_RECOMMENDATIONS,
                           INSIGHT_TEXT_TEMPLATE, NO_ALERTS_TEXT, USER_PROMPT_TEMPLATE)
from vigil.sources.tables import CANONICAL_EVENTS_SQL

EV = f"ev AS ({CANONICAL_EVENTS_SQL})"

# Shared numeric forms (exact cents, round-half-up on the quotient).
CENTS = "CAST(round(coalesce(transaction_amount, 0.0) * CAST(100 AS DOUBLE)) AS BIGINT)"
D100 = "CAST(100 AS DOUBLE)"

SQL: dict[str, str] = {}

SQL["time_features"] = f"""
WITH {EV}
SELECT event_id, event_time,
       CAST(hour(event_time) AS INTEGER) AS hour_of_day,
       CAST(isodow(event_time) - 1 AS INTEGER) AS day_of_week,
       CAST(isodow(event_time) >= 6 AS INTEGER) AS is_weekend,
       CAST(hour(event_time) < 6 OR hour(event_time) >= 22 AS INTEGER) AS is_night
FROM ev
"""

ROLLING_WINDOW = ("PARTITION BY user_id ORDER BY event_time "
                  "RANGE BETWEEN INTERVAL {m} MINUTE PRECEDING AND CURRENT ROW")


def rolling_sql(minutes: int, failed_type: str) -> str:
    """Rolling features as a reusable CTE body named ``feat``."""
    return f"""
feat AS (
  SELECT ev.*,
         count(*) OVER w AS txn_count_1h,
         round(sum({CENTS}) OVER w / count(*) OVER w) / {D100} AS avg_amount_1h,
         max(coalesce(transaction_amount, 0.0)) OVER w AS max_amount_1h,
         CAST(sum(CASE WHEN event_type = '{failed_type}' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failed_attempts_1h,
         count(DISTINCT coalesce(location, '')) OVER w AS unique_locations_1h
  FROM ev
  WINDOW w AS ({ROLLING_WINDOW.format(m=minutes)})
)"""


SQL["rolling_user_features"] = f"""
WITH {EV}, {rolling_sql(60, 'error')}
SELECT event_id, user_id, event_time, txn_count_1h, avg_amount_1h, max_amount_1h,
       failed_attempts_1h, unique_locations_1h
FROM feat
"""


# ---------------------------------------------------------------------------
# Aggregation
# ---------------------------------------------------------------------------

def summary_cols(n: str = "count(*)") -> str:
    fc = "CAST(sum(CAST(coalesce(is_fraud, false) AS INTEGER)) AS BIGINT)"
    return f"""
       {n} AS total_transactions,
       sum({CENTS}) / {D100} AS total_amount,
       round(sum({CENTS}) / {n}) / {D100} AS avg_amount,
       max(coalesce(transaction_amount, 0.0)) AS max_amount,
       min(coalesce(transaction_amount, 0.0)) AS min_amount,
       count(DISTINCT user_id) AS unique_users,
       {fc} AS fraud_count,
       round(({fc} / greatest({n}, 1)) * CAST(10000 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS fraud_rate"""


def window_summary_sql(every: str) -> str:
    return f"""
WITH {EV}
SELECT time_bucket(INTERVAL '{every}', event_time) AS window_start,
       time_bucket(INTERVAL '{every}', event_time) + INTERVAL '{every}' AS window_end,
       {summary_cols()}
FROM ev GROUP BY 1, 2
"""


SQL["window_summary_1m"] = window_summary_sql("1 minute")
SQL["window_summary_1h"] = window_summary_sql("1 hour")


def breakdown_sql(dims: list[str], every: str = "1 hour", top: dict | None = None) -> str:
    top = top or {}
    pairs = "\n  UNION ALL ".join(
        f"SELECT time_bucket(INTERVAL '{every}', event_time) AS window_start, '{d}' AS dimension, "
        f"CAST({d} AS VARCHAR) AS value FROM ev" for d in dims)
    keep = " AND ".join(f"(dimension <> '{d}' OR rnk <= {k})" for d, k in top.items()) or "TRUE"
    return f"""
pairs AS ({pairs}),
cnts AS (SELECT window_start, dimension, value, count(*) AS cnt FROM pairs
         WHERE value IS NOT NULL GROUP BY window_start, dimension, value),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY window_start, dimension
                                              ORDER BY cnt DESC, value ASC) AS BIGINT) AS rnk
           FROM cnts),
long AS (SELECT * FROM ranked WHERE {keep})"""


SQL["event_type_breakdown"] = f"WITH {EV}, {breakdown_sql(['event_type'])} SELECT window_start, value, cnt, rnk FROM long"
SQL["device_breakdown"] = f"WITH {EV}, {breakdown_sql(['device_type'])} SELECT window_start, value, cnt, rnk FROM long"
SQL["top_locations"] = (f"WITH {EV}, {breakdown_sql(['location'], top={'location': 10})} "
                        "SELECT window_start, value, cnt, rnk FROM long")

SQL["window_metrics"] = f"""
WITH {EV}, {breakdown_sql(['event_type', 'device_type', 'location'], top={'location': 10})},
maps AS (
  SELECT window_start,
         string_agg(CASE WHEN dimension = 'event_type' THEN value || ':' || cnt END, ',' ORDER BY rnk) AS event_type_breakdown,
         string_agg(CASE WHEN dimension = 'device_type' THEN value || ':' || cnt END, ',' ORDER BY rnk) AS device_breakdown,
         string_agg(CASE WHEN dimension = 'location' THEN value || ':' || cnt END, ',' ORDER BY rnk) AS location_breakdown
  FROM long GROUP BY window_start),
summ AS (
  SELECT time_bucket(INTERVAL '1 hour', event_time) AS window_start,
         time_bucket(INTERVAL '1 hour', event_time) + INTERVAL '1 hour' AS window_end,
         {summary_cols()}
  FROM ev GROUP BY 1, 2)
SELECT summ.*, maps.event_type_breakdown, maps.device_breakdown, maps.location_breakdown
FROM summ LEFT JOIN maps USING (window_start)
"""

COUNT_WINDOW = 100
SQL["count_windows"] = f"""
WITH {EV},
ix AS (SELECT *, row_number() OVER (ORDER BY event_time, event_id) - 1 AS idx,
              count(*) OVER () AS n_all FROM ev),
both_ AS (
  SELECT *, idx // {COUNT_WINDOW} AS window_index, false AS is_tail FROM ix
  WHERE idx // {COUNT_WINDOW} < n_all // {COUNT_WINDOW}
  UNION ALL
  SELECT *, n_all // {COUNT_WINDOW} AS window_index, true AS is_tail FROM ix
  WHERE n_all % {COUNT_WINDOW} <> 0 AND idx >= n_all - {COUNT_WINDOW})
SELECT CAST(window_index AS BIGINT) AS window_index, is_tail,
       min(event_time) AS first_event_time, max(event_time) AS last_event_time,
       {summary_cols()}
FROM both_ GROUP BY window_index, is_tail
"""

SQL["metrics_rollup"] = f"""
WITH {EV},
summ AS (SELECT time_bucket(INTERVAL '1 minute', event_time) AS window_start, {summary_cols()}
         FROM ev GROUP BY 1),
recent AS (SELECT * FROM summ ORDER BY window_start DESC LIMIT 60),
u AS (SELECT *, CASE WHEN avg_amount <> 0 THEN CAST(round(avg_amount * {D100}) AS BIGINT) END AS avg_c,
             CAST(round(fraud_rate * CAST(10000 AS DOUBLE)) AS BIGINT) AS rate_u FROM recent)
SELECT count(*) AS windows_analysed,
       coalesce(round(sum(avg_c) / count(avg_c)) / {D100}, 0.0) AS avg_transaction_value,
       coalesce(round(sum(rate_u) / count(rate_u)) / CAST(10000 AS DOUBLE), 0.0) AS avg_fraud_rate,
       CAST(coalesce(max(total_transactions), 0) AS BIGINT) AS peak_transactions,
       CAST(coalesce(sum(total_transactions), 0) AS BIGINT) AS total_transactions
FROM u
"""


# ---------------------------------------------------------------------------
# Alerts (R1–R15, A10–A11, I9)
# ---------------------------------------------------------------------------


_FIELD = _re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_value(name: str, spec: str) -> str:
    if spec == "":
        out = f"CAST({name} AS VARCHAR)"
    elif spec.endswith("%"):
        out = f"format('{{:.{spec[1:-1]}f}}', CAST({name} AS DOUBLE) * CAST(100 AS DOUBLE)) || '%'"
    else:
        out = f"format('{{:{spec}}}', CAST({name} AS DOUBLE))"
    return f"coalesce({out}, 'N/A')"


def sql_template(t: str) -> str:
    parts, pos = [], 0
    for m in _FIELD.finditer(t):
        if m.start() > pos:
            parts.append(q(t[pos:m.start()]))
        parts.append(sql_value(m.group(1), m.group(2) or ""))
        pos = m.end()
    if pos < len(t):
        parts.append(q(t[pos:]))
    return " || ".join(parts)


def iso_sql(ts: str, sep: str = "T") -> str:
    return (f"CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%d{sep}%H:%M:%S') "
            f"ELSE strftime({ts}, '%Y-%m-%d{sep}%H:%M:%S.%f') END")


def enriched_sql(minutes: int = 1440) -> str:
    return f"""{EV}, {rolling_sql(minutes, 'error')},
enr AS (SELECT feat.*, CAST(hour(event_time) < 6 OR hour(event_time) >= 22 AS INTEGER) AS is_night
        FROM feat)"""


RULE_SQL_COND = {
    "FRAUD_HIGH_PROB": ("fraud_probability >= 0.85", 0.85),
    "HIGH_TRANSACTION": ("transaction_amount >= 200.0", 200.0),
    "FAILED_ATTEMPTS": ("failed_attempts_1h >= 2", 2.0),
    "ANOMALY_NIGHT_API": ("device_type = 'api' AND is_night = 1 AND transaction_amount > 100.0", 100.0),
    "VELOCITY_SPIKE": ("txn_count_1h >= 5", 5.0),
}


def alerts_sql() -> str:
    parts = []
    for i, (name, atype, sev, title, desc) in enumerate(ALERT_RULE_TEXT):
        cond, thr = RULE_SQL_COND[name]
        parts.append(f"""
  SELECT sha256(event_id || '|' || '{name}') AS alert_id, '{name}' AS rule_name, {i} AS rule_order,
         '{atype}' AS alert_type, '{sev}' AS severity,
         {sql_template(title)} AS title, {sql_template(desc)} AS description,
         user_id, event_id, CAST(transaction_amount AS DOUBLE) AS value,
         CAST({thr} AS DOUBLE) AS threshold, event_time AS triggered_at
  FROM enr WHERE coalesce({cond}, false)""")
    return f"WITH {enriched_sql()}, alerts AS ({' UNION ALL '.join(parts)})"


ALERTS = alerts_sql()
SQL["alert_events"] = ALERTS + " SELECT * FROM alerts"
SQL["alert_counts"] = ALERTS + " SELECT severity, count(*) AS alert_count FROM alerts GROUP BY severity"
SQL["alert_pivot"] = ALERTS + """
 SELECT CAST(coalesce(sum(CAST(severity = 'critical' AS BIGINT)), 0) AS BIGINT) AS critical,
        CAST(coalesce(sum(CAST(severity = 'high' AS BIGINT)), 0) AS BIGINT) AS high,
        CAST(coalesce(sum(CAST(severity = 'medium' AS BIGINT)), 0) AS BIGINT) AS medium,
        CAST(coalesce(sum(CAST(severity = 'low' AS BIGINT)), 0) AS BIGINT) AS low
 FROM alerts"""
SQL["alert_deliveries"] = ALERTS + """
 SELECT alert_id, severity, CAST(o AS BIGINT) AS delivery_order, ch AS channel
 FROM alerts, (SELECT 0 AS o, 'chat' AS ch UNION ALL SELECT 1, 'email' UNION ALL SELECT 2, 'webhook') c
 WHERE severity IN ('high', 'critical')
 UNION ALL
 SELECT alert_id, severity, CAST(o AS BIGINT), ch
 FROM alerts, (SELECT 0 AS o, 'chat' AS ch UNION ALL SELECT 1, 'webhook') c
 WHERE severity NOT IN ('high', 'critical')"""


def _case(col: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {col} {whens} ELSE {q(default)} END"


_ISO = iso_sql("triggered_at")
SQL["alert_payloads"] = ALERTS + f"""
 SELECT alert_id,
   to_json({{'channel': '#data-alerts',
             'text': {_case('severity', CHAT_ICON, '⚠️')} || ' *' || title || '*' || chr(10) || description,
             'attachments': [{{'color': {_case('severity', CHAT_COLOR, 'warning')},
                               'fields': [{{'title': 'Severity', 'value': upper(severity), 'short': true}},
                                          {{'title': 'Type', 'value': alert_type, 'short': true}},
                                          {{'title': 'User', 'value': coalesce(user_id, 'N/A'), 'short': true}},
                                          {{'title': 'Triggered', 'value': {_ISO}, 'short': true}}]}}]}})::VARCHAR AS chat_json,
   CASE WHEN severity IN ('high', 'critical') THEN '[' || upper(severity) || '] ' || title END AS email_subject,
   CASE WHEN severity IN ('high', 'critical') THEN
     '<html><body><h2 style="color:' || CASE WHEN severity = 'critical' THEN 'red' ELSE 'orange' END || '">'
     || title || '</h2><p>' || description || '</p><table border="1" cellpadding="5">'
     || '<tr><td><b>Severity</b></td><td>' || severity || '</td></tr>'
     || '<tr><td><b>Type</b></td><td>' || alert_type || '</td></tr>'
     || '<tr><td><b>User</b></td><td>' || coalesce(user_id, 'N/A') || '</td></tr>'
     || '<tr><td><b>Time</b></td><td>' || {iso_sql('triggered_at', ' ')} || '</td></tr>'
     || '</table></body></html>' END AS email_html,
   to_json({{'alert_id': alert_id, 'type': alert_type, 'severity': severity, 'title': title,
             'description': description, 'user_id': user_id, 'triggered_at': {_ISO}}})::VARCHAR AS webhook_json
 FROM alerts"""

SQL["recent_alerts"] = ALERTS + """,
 top AS (SELECT * FROM alerts ORDER BY triggered_at DESC, event_id DESC, rule_order DESC LIMIT 50)
 SELECT CAST(row_number() OVER (ORDER BY triggered_at, event_id, rule_order) AS BIGINT) AS position,
        row_number() OVER (ORDER BY triggered_at, event_id, rule_order) <= 10 AS displayed,
        alert_id, severity, title, triggered_at
 FROM top"""

SQL["alert_digest"] = ALERTS + f""",
 firsts AS (
   SELECT time_bucket(INTERVAL '1 hour', triggered_at) AS window_start,
          '• [' || upper(severity) || '] ' || title || ': ' || description AS line,
          row_number() OVER (PARTITION BY time_bucket(INTERVAL '1 hour', triggered_at)
                             ORDER BY triggered_at, event_id, rule_order) AS r
   FROM alerts),
 d AS (SELECT window_start, {q(ALERT_SUMMARY_HEADER)} || chr(10) || string_agg(line, chr(10) ORDER BY r) AS digest
       FROM firsts WHERE r <= 5 GROUP BY window_start),
 w AS (SELECT DISTINCT time_bucket(INTERVAL '1 hour', event_time) AS window_start FROM ev)
 SELECT w.window_start, coalesce(d.digest, {q(NO_ALERTS_TEXT)}) AS digest
 FROM w LEFT JOIN d USING (window_start)"""


# ---------------------------------------------------------------------------
# Validation and store
# ---------------------------------------------------------------------------


_IN = lambda xs: ", ".join(q(x) for x in xs)
SQL["quarantine"] = f"""
WITH {EV},
r AS (SELECT event_id, event_type,
        list_filter([
          CASE WHEN user_id IS NULL THEN 'missing_user_id' END,
          CASE WHEN session_id IS NULL THEN 'missing_session_id' END,
          CASE WHEN transaction_amount IS NULL THEN 'missing_transaction_amount' END,
          CASE WHEN location IS NULL THEN 'missing_location' END,
          CASE WHEN device_type IS NULL THEN 'missing_device_type' END,
          CASE WHEN event_type IS NULL THEN 'missing_event_type' END,
          CASE WHEN transaction_amount < 0 THEN 'negative_amount' END,
          CASE WHEN event_type IS NOT NULL AND event_type NOT IN ({_IN(EVENT_TYPES)}) THEN 'unknown_event_type' END,
          CASE WHEN device_type IS NOT NULL AND device_type NOT IN ({_IN(DEVICE_TYPES)}) THEN 'unknown_device_type' END
        ], lambda x: x IS NOT NULL) AS rs
      FROM ev)
SELECT event_id, event_type, array_to_string(rs, ',') AS reasons FROM r WHERE len(rs) > 0
"""

SQL["idempotent_insert"] = f"""
WITH {EV}
SELECT event_id, user_id, event_time, transaction_amount,
       CASE WHEN event_time < TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 2 END AS batch
FROM ev
"""

SQL["recent_events"] = f"""
WITH {EV}
SELECT event_id, user_id, {iso_sql('event_time')} AS event_time, transaction_amount
FROM ev ORDER BY ev.event_time DESC, event_id DESC LIMIT 100
"""

SQL["risky_events"] = f"""
WITH {EV}
SELECT event_id, user_id, event_time, fraud_probability FROM ev
WHERE fraud_probability >= 0.8 ORDER BY event_time DESC, event_id DESC LIMIT 20
"""

_SUMM_1M = f"""summ AS (SELECT time_bucket(INTERVAL '1 minute', event_time) AS window_start,
       time_bucket(INTERVAL '1 minute', event_time) + INTERVAL '1 minute' AS window_end, {summary_cols()}
       FROM ev GROUP BY 1, 2)"""

SQL["latest_metrics"] = f"WITH {EV}, {_SUMM_1M} SELECT * FROM summ ORDER BY window_start DESC LIMIT 1"

SQL["metrics_history"] = f"""
WITH {EV}, {_SUMM_1M},
h AS (SELECT * FROM summ ORDER BY window_start DESC LIMIT 500),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY window_start) - 1 AS BIGINT) AS pos,
             count(*) OVER () AS n FROM h)
SELECT pos, window_start, total_transactions, fraud_rate FROM p WHERE pos >= greatest(n - 60, 0) AND pos <= n - 1
"""

SQL["latest_per_user"] = f"""
WITH {EV}
SELECT user_id, arg_max(event_id, (event_time, event_id)) AS event_id,
       max(event_time) AS event_time,
       arg_max(transaction_amount, (event_time, event_id)) AS transaction_amount
FROM ev GROUP BY user_id
"""

SQL["event_counters"] = f"WITH {EV} SELECT user_id, count(*) AS value FROM ev GROUP BY user_id"

SQL["fresh_metrics"] = f"""
WITH {EV}, {_SUMM_1M}
SELECT window_start, total_transactions FROM summ
WHERE window_end > (SELECT max(window_end) FROM summ) - INTERVAL 3600 SECOND
"""

SQL["archive_roundtrip"] = f"""
WITH {EV}
SELECT CAST(year(event_time) AS INTEGER) AS year, CAST(month(event_time) AS INTEGER) AS month,
       CAST(day(event_time) AS INTEGER) AS day, CAST(hour(event_time) AS INTEGER) AS hour,
       count(*) AS n_events
FROM ev GROUP BY ALL
"""


# ---------------------------------------------------------------------------
# Insights and dashboard reads
# ---------------------------------------------------------------------------


_JSONV = "replace(replace(value, '\\', '\\\\'), '\"', '\\\"')"


def count_window_metrics_sql(every: int = 100) -> str:
    """CTEs ending in ``cwm``: count-window summary + breakdown text/json."""
    return f"""
ix AS (SELECT *, row_number() OVER (ORDER BY event_time, event_id) - 1 AS idx,
              count(*) OVER () AS n_all FROM ev),
tagged AS (
  SELECT *, CAST(idx // {every} AS BIGINT) AS window_index, false AS is_tail FROM ix
  WHERE idx // {every} < n_all // {every}
  UNION ALL
  SELECT *, CAST(n_all // {every} AS BIGINT) AS window_index, true AS is_tail FROM ix
  WHERE n_all % {every} <> 0 AND idx >= n_all - {every}),
summ AS (SELECT window_index, is_tail, min(event_time) AS first_event_time,
                max(event_time) AS last_event_time, {summary_cols()}
         FROM tagged GROUP BY window_index, is_tail),
pairs AS (SELECT window_index, is_tail, 'event_type' AS dimension, event_type AS value FROM tagged
          UNION ALL SELECT window_index, is_tail, 'device_type', device_type FROM tagged
          UNION ALL SELECT window_index, is_tail, 'location', location FROM tagged),
cnts AS (SELECT window_index, is_tail, dimension, value, count(*) AS cnt FROM pairs
         WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY window_index, is_tail, dimension
                                        ORDER BY cnt DESC, value ASC) AS rnk FROM cnts),
long AS (SELECT * FROM ranked WHERE dimension <> 'location' OR rnk <= 10),
maps AS (SELECT window_index, is_tail,
           min_by(value, rnk) FILTER (WHERE dimension = 'device_type') AS peak_device,
           coalesce('{{' || string_agg('"' || {_JSONV} || '": ' || cnt, ', ' ORDER BY rnk)
                     FILTER (WHERE dimension = 'event_type') || '}}', '{{}}') AS event_type_breakdown,
           coalesce('{{' || string_agg('"' || {_JSONV} || '": ' || cnt, ', ' ORDER BY rnk)
                     FILTER (WHERE dimension = 'device_type') || '}}', '{{}}') AS device_breakdown,
           coalesce('{{' || string_agg('"' || {_JSONV} || '": ' || cnt, ', ' ORDER BY rnk)
                     FILTER (WHERE dimension = 'location') || '}}', '{{}}') AS location_breakdown
         FROM long GROUP BY window_index, is_tail),
cwm AS (SELECT summ.*, coalesce(maps.peak_device, 'N/A') AS peak_device, maps.event_type_breakdown,
               maps.device_breakdown, maps.location_breakdown,
               CASE WHEN fraud_rate > 0.15 THEN 'critical' WHEN fraud_rate > 0.08 THEN 'high'
                    WHEN fraud_rate > 0.03 THEN 'medium' ELSE 'low' END AS risk_level
        FROM summ LEFT JOIN maps USING (window_index, is_tail))"""


_INS = f"""WITH {EV}, {count_window_metrics_sql()},
ins AS (SELECT sha256({iso_sql('first_event_time')} || '|' || {iso_sql('last_event_time')}) AS insight_id,
               first_event_time AS window_start, last_event_time AS window_end,
               {sql_template(INSIGHT_TEXT_TEMPLATE)} AS insight_text,
               {" || chr(10) || ".join(sql_template(t) for t in INSIGHT_FINDING_TEMPLATES)} AS key_findings,
               {" || chr(10) || ".join(q(r) for r in INSIGHT_RECOMMENDATIONS)} AS recommendations,
               risk_level, 'template' AS model_used
        FROM cwm)"""

SQL["insights"] = _INS + " SELECT * FROM ins"
SQL["stream_insights"] = SQL["insights"]
SQL["latest_insight"] = _INS + (" SELECT insight_id, window_start, risk_level, insight_text FROM ins "
                                "ORDER BY window_start DESC LIMIT 1")
SQL["insight_history"] = _INS + """,
h AS (SELECT insight_id, window_start, risk_level FROM ins ORDER BY window_start DESC LIMIT 100),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY window_start) - 1 AS BIGINT) AS pos, count(*) OVER () AS n FROM h)
SELECT insight_id, window_start, risk_level, pos FROM p WHERE pos >= greatest(n - 10, 0) AND pos <= n - 1"""


def _prompt_sql() -> str:
    t = USER_PROMPT_TEMPLATE
    subst = {"window_start": iso_sql("first_event_time"), "window_end": iso_sql("last_event_time"),
             "event_type_breakdown": "event_type_breakdown", "device_breakdown": "device_breakdown",
             "location_breakdown": "location_breakdown"}
    parts, pos = [], 0
    for m in _FIELD.finditer(t):
        if m.start() > pos:
            parts.append(q(t[pos:m.start()]))
        name, spec = m.group(1), m.group(2) or ""
        parts.append(f"coalesce({subst[name]}, 'N/A')" if name in subst else sql_value(name, spec))
        pos = m.end()
    if pos < len(t):
        parts.append(q(t[pos:]))
    return " || ".join(parts)


SQL["insight_prompts"] = f"WITH {EV}, {count_window_metrics_sql()} SELECT first_event_time AS window_start, {_prompt_sql()} AS prompt FROM cwm"

SQL["run_counters"] = f"""
WITH {ALERTS.split('WITH', 1)[1]},
cw AS (SELECT count(*) AS n_all FROM ev)
SELECT 'processed' AS counter, CAST(count(*) AS BIGINT) AS value FROM ev
UNION ALL SELECT 'alerts', CAST(count(*) AS BIGINT) FROM alerts
UNION ALL SELECT 'insights', CAST(n_all // 100 + CASE WHEN n_all % 100 <> 0 THEN 1 ELSE 0 END AS BIGINT) FROM cw
UNION ALL SELECT 'fraud_detected', CAST(sum(CAST(is_fraud AS BIGINT)) AS BIGINT) FROM ev
"""

SQL["throughput_series"] = f"""
WITH {EV}, s AS (
  SELECT time_bucket(INTERVAL '1 hour', event_time) AS window_start, {summary_cols()} FROM ev GROUP BY 1)
SELECT window_start, total_transactions, coalesce(fraud_count, 0) AS fraud_count,
       fraud_rate * CAST(100 AS DOUBLE) AS fraud_pct, fraud_rate * CAST(100 AS DOUBLE) > 5.0 AS above_reference
FROM s
"""

SQL["kpi_row"] = f"""
WITH {EV}, {_SUMM_1M},
l AS (SELECT * FROM summ ORDER BY window_start DESC LIMIT 1)
SELECT {iso_sql('window_start')} AS last_metrics_window, total_transactions,
       '$' || format('{{:,.0f}}', total_amount) AS total_volume,
       '$' || format('{{:,.0f}}', avg_amount) AS avg_transaction,
       unique_users, fraud_count, fraud_rate,
       format('{{:.1f}}', fraud_rate * CAST(100 AS DOUBLE)) || '%' AS fraud_rate_text
FROM l
"""


# ---------------------------------------------------------------------------
# ML (M1–M13): features and metrics on a given score
# ---------------------------------------------------------------------------

SQL["ml_features"] = f"""
WITH {enriched_sql(60)}
SELECT event_id,
       CAST(dense_rank() OVER (ORDER BY device_type) - 1 AS DOUBLE) AS device_type_enc,
       CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS event_type_enc,
       CAST(dense_rank() OVER (ORDER BY location) - 1 AS DOUBLE) AS location_enc,
       round(ln(1 + transaction_amount) * CAST(1000000000 AS DOUBLE)) / CAST(1000000000 AS DOUBLE) AS log_amount,
       CASE WHEN avg_amount_1h > 0 THEN transaction_amount / avg_amount_1h ELSE 1.0 END AS amount_vs_avg_ratio,
       failed_attempts_1h / CASE WHEN txn_count_1h = 0 THEN 1 ELSE txn_count_1h END AS fail_rate
FROM enr
"""

_MI = f"""WITH {EV},
mi AS (SELECT CAST(event_type = 'error' AS INTEGER) AS label, fraud_probability AS score,
              CAST(is_fraud AS INTEGER) AS prediction FROM ev)"""

SQL["auc"] = _MI + """,
g AS (SELECT CAST(round_even(score * 10000.0, 0) AS BIGINT) AS s, CAST(sum(label) AS BIGINT) AS pos,
             CAST(sum(1 - label) AS BIGINT) AS neg FROM mi GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM g)
SELECT (sum(pos * neg_below) + sum(pos * neg) / 2.0) / (sum(pos) * sum(neg)) AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM c"""

SQL["auc_raw"] = f"""WITH {EV}, mi AS (
  SELECT CAST(event_type = 'error' AS INTEGER) AS label, transaction_amount / CAST(601.7 AS DOUBLE) AS score FROM ev),
g AS (SELECT score AS s, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM mi GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM g)
SELECT (CAST(sum(pos * neg_below) AS DOUBLE) + CAST(sum(pos * neg) AS DOUBLE) / CAST(2 AS DOUBLE))
       / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM c"""

_RANKED = f"""WITH {EV}, r AS (
  SELECT event_id, CAST(is_fraud AS INTEGER) AS label,
         row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42|' || event_id), event_id) - 1 AS rnk,
         count(*) OVER (PARTITION BY is_fraud) AS n FROM ev)"""
SQL["stratified_split"] = _RANKED + """
SELECT event_id, label, CASE WHEN rnk < floor(n * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM r"""
SQL["stratified_folds"] = _RANKED + " SELECT event_id, label, CAST((rnk * 5) // n AS INTEGER) AS fold FROM r"

SQL["confusion"] = _MI + """
SELECT label, CAST(sum(CAST(prediction = 0 AS BIGINT)) AS BIGINT) AS pred_0,
       CAST(sum(CAST(prediction = 1 AS BIGINT)) AS BIGINT) AS pred_1 FROM mi GROUP BY label"""


def _r4(x: str) -> str:
    return f"round(({x}) * CAST(10000 AS DOUBLE)) / CAST(10000 AS DOUBLE)"


def _metrics_sql(src: str, y: str, p: str) -> str:
    return f"""
c AS (SELECT CAST(sum(CAST(({y}) = 1 AND ({p}) = 1 AS BIGINT)) AS BIGINT) AS tp,
             CAST(sum(CAST(({y}) = 0 AND ({p}) = 1 AS BIGINT)) AS BIGINT) AS fp,
             CAST(sum(CAST(({y}) = 1 AND ({p}) = 0 AS BIGINT)) AS BIGINT) AS fn,
             CAST(sum(CAST(({y}) = 0 AND ({p}) = 0 AS BIGINT)) AS BIGINT) AS tn FROM {src})
SELECT tp, fp, fn, tn,
  {_r4('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END')} AS precision,
  {_r4('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END')} AS recall,
  {_r4('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END')} AS f1,
  tp + fp + fn + tn AS size, {_r4('(tp + fn) / (tp + fp + fn + tn)')} AS positive_rate FROM c"""


SQL["f1"] = _MI + "," + _metrics_sql("mi", "label", "prediction")
SQL["class_report"] = (_MI + ", r0 AS (" + _metrics_sql("mi", "1 - label", "1 - prediction").replace("\nc AS", "WITH c AS", 1)
                       + "), r1 AS (" + _metrics_sql("mi", "label", "prediction").replace("\nc AS", "WITH c AS", 1) + ")"
                       + " SELECT 0 AS class, precision, recall, f1, tp + fn AS support FROM r0"
                       + " UNION ALL SELECT 1, precision, recall, f1, tp + fn FROM r1")


# ---------------------------------------------------------------------------
# Streaming: the same answers as the batch statements
# ---------------------------------------------------------------------------

SQL["stream_tumbling"] = SQL["window_summary_1m"]
SQL["stream_rolling"] = SQL["rolling_user_features"]
SQL["stream_dedupe"] = f"WITH {EV} SELECT event_id, user_id, event_time, transaction_amount FROM ev"


# ---------------------------------------------------------------------------
# Wire format and table writes
# ---------------------------------------------------------------------------

SQL["wire_roundtrip"] = f"""WITH {EV}
SELECT event_id, user_id, event_time, transaction_amount, location, device_type, event_type FROM ev"""

SQL["wire_keys"] = f"WITH {EV} SELECT user_id AS key, count(*) AS messages FROM ev GROUP BY user_id"

SQL["alerts_idempotent"] = ALERTS + " SELECT alert_id, rule_name, event_id, severity, triggered_at FROM alerts"

SQL["processed_events_table"] = f"""
WITH {enriched_sql(60)}
SELECT coalesce(event_id, '') AS event_id, coalesce(user_id, '') AS user_id,
       coalesce(session_id, '') AS session_id, event_time,
       coalesce(event_type, '') AS event_type, coalesce(device_type, '') AS device_type,
       coalesce(location, '') AS location, coalesce(transaction_amount, 0.0) AS transaction_amount,
       coalesce(fraud_probability, 0.0) AS fraud_probability, coalesce(is_fraud, false) AS is_fraud,
       CAST(hour(event_time) AS INTEGER) AS hour_of_day, CAST(isodow(event_time) - 1 AS INTEGER) AS day_of_week,
       txn_count_1h, failed_attempts_1h
FROM enr
"""


# ---------------------------------------------------------------------------
# Skew: the same rolling features with one user holding ~40% of events
# ---------------------------------------------------------------------------

_HOT_EV = EV.replace("CAST(user_id AS VARCHAR) AS user_id,",
                     "CASE WHEN event_type IN ('click', 'view') THEN 'hot' ELSE CAST(user_id AS VARCHAR) END AS user_id,", 1)
SQL["rolling_hot_user"] = f"""
WITH {_HOT_EV}, {rolling_sql(60, 'error')}
SELECT event_id, user_id, event_time, txn_count_1h, avg_amount_1h, max_amount_1h,
       failed_attempts_1h, unique_locations_1h
FROM feat
"""

# The same features with one user holding every event, the table squeezed into two hours.
SQL["rolling_dense_user"] = f"""
WITH {EV.replace("ev AS (", "ev0 AS (", 1)},
ev AS (SELECT * REPLACE ('dense' AS user_id,
                         make_timestamp(1704067200000000 + (epoch_us(event_time) - 1704067200000000) // 360) AS event_time)
       FROM ev0), {rolling_sql(60, 'error')}
SELECT event_id, user_id, event_time, txn_count_1h, avg_amount_1h, max_amount_1h,
       failed_attempts_1h, unique_locations_1h
FROM feat
"""

SQL["stream_alerts"] = SQL["alert_events"]
SQL["stream_from_json"] = window_summary_sql("1 minute").replace(
    f"WITH {EV}", f"WITH {EV.replace('ev AS (', 'ev0 AS (', 1)}, ev AS (SELECT * REPLACE (false AS is_fraud) FROM ev0)", 1)
SQL["stream_counters"] = SQL["event_counters"]

SQL["alert_prompt"] = SQL["alert_digest"].replace(
    "'• [' || upper(severity) || '] '", "'- [' || severity || '] '").replace(
    "WHERE r <= 5", "WHERE r <= 10").replace(
    f"{q(ALERT_SUMMARY_HEADER)} || chr(10) || string_agg", "string_agg")

SQL["status_row"] = f"""
WITH m AS ({window_summary_sql("1 minute")})
SELECT * FROM (SELECT window_start AS last_metrics_window, total_transactions, fraud_rate, 'all' AS scope FROM m
               ORDER BY window_start DESC LIMIT 1)
UNION ALL SELECT CAST(NULL AS TIMESTAMP), 0, CAST(0 AS DOUBLE), 'none'
"""

SQL["validated_events"] = f"""WITH {EV}, f AS (
  SELECT event_id, CASE WHEN CAST(event_id AS BIGINT) % 11 <> 0 THEN user_id END AS user_id,
         CASE WHEN CAST(event_id AS BIGINT) % 7 = 0 THEN -transaction_amount - 1
              ELSE transaction_amount / CAST(3 AS DOUBLE) END AS amount,
         CASE WHEN CAST(event_id AS BIGINT) % 13 = 0 THEN 'toaster' ELSE device_type END AS device_type
  FROM ev)
SELECT event_id, user_id, round(amount * 100) / CAST(100 AS DOUBLE) AS transaction_amount, 'USD' AS currency,
       concat_ws(',', CASE WHEN user_id IS NULL THEN 'missing_user_id' END,
                 CASE WHEN amount < 0 THEN 'negative_amount' END,
                 CASE WHEN device_type = 'toaster' THEN 'unknown_device_type' END) AS reasons
FROM f"""

SQL["bad_records"] = f"""WITH {EV}, f AS (
  SELECT event_id, event_time, CAST(event_id AS BIGINT) AS n FROM ev),
c AS (
  SELECT *, CASE WHEN n % 17 = 0 THEN 'time' WHEN n % 19 = 0 THEN 'no time' WHEN n % 23 = 0 THEN 'words'
                 WHEN n % 29 = 0 THEN 'text' WHEN n % 31 = 0 THEN 'cut' ELSE '' END AS flaw FROM f)
SELECT event_id,
       CASE flaw WHEN 'time' THEN 'bad_timestamp' || CASE WHEN n % 13 = 0 THEN ',negative_amount' ELSE '' END
                 WHEN 'words' THEN 'bad_transaction_amount' WHEN 'cut' THEN 'malformed_json'
                 ELSE 'negative_amount' END AS reasons,
       CASE WHEN flaw NOT IN ('time', 'cut', 'no time') THEN event_time END AS event_time,
       flaw IN ('time', 'words', 'cut') AS has_text
FROM c WHERE flaw IN ('time', 'words', 'cut') OR n % 13 = 0"""
SQL["stream_bad_records"] = SQL["bad_records"]

SQL["model_replies"] = f"""
WITH i AS ({SQL["insights"]})
SELECT insight_id,
       CASE WHEN minute(window_start) % 3 = 0 THEN 'seen ' || risk_level ELSE insight_text END AS insight_text,
       CASE WHEN minute(window_start) % 3 = 0 THEN 'f' ELSE key_findings END AS key_findings,
       CASE WHEN minute(window_start) % 3 = 0 THEN 'high' ELSE risk_level END AS risk_level,
       CASE WHEN minute(window_start) % 3 = 0 THEN 'external' ELSE model_used END AS model_used
FROM i"""

SQL["insight_rows"] = f"""
WITH i AS ({SQL["insights"]})
SELECT insight_id, CAST(to_json(string_split(key_findings, chr(10))) AS VARCHAR) AS key_findings,
       CAST(to_json(string_split(recommendations, chr(10))) AS VARCHAR) AS recommendations, risk_level FROM i"""

SQL["ml_unseen"] = f"""WITH {EV},
d AS (SELECT device_type, row_number() OVER (ORDER BY device_type) - 1 AS k
      FROM (SELECT DISTINCT device_type FROM ev WHERE device_type <> 'api'))
SELECT event_id, CAST(coalesce(k, 0) AS DOUBLE) AS device_type_enc FROM ev LEFT JOIN d USING (device_type)"""


# ---------------------------------------------------------------------------
# Scoring with the written-down model: features, scaler and trees as SQL text
# ---------------------------------------------------------------------------

def _num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _tree_sql(node) -> str:
    if not isinstance(node, list):
        return _num(node)
    feature, threshold, left, right = node
    return f"CASE WHEN s{feature:02d} <= {_num(threshold)} THEN {_tree_sql(left)} ELSE {_tree_sql(right)} END"


def fixed_model_sql(source: str) -> str:
    """CTEs ``scaled`` (s00..s15) and ``scored`` (p) over the rows of ``source``."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixed_model.json")) as f:
        m = json.load(f)
    place = lambda c: f"coalesce(list_position({m['classes'][c]!r}, {c}) - 1, 0)"
    raw = ["transaction_amount", "hour_of_day", "day_of_week", "is_weekend", "is_night", place("device_type"),
           place("event_type"), place("location"), "txn_count_1h", "avg_amount_1h", "max_amount_1h",
           "failed_attempts_1h", "unique_locations_1h", "ln(1 + transaction_amount)",
           "CASE WHEN avg_amount_1h > 0 THEN transaction_amount / avg_amount_1h ELSE 1.0 END",
           "failed_attempts_1h / CASE WHEN txn_count_1h = 0 THEN 1 ELSE txn_count_1h END"]
    scaled = ", ".join(f"(CAST({x} AS DOUBLE) - {_num(a)}) * {_num(1.0 / b if b else 0.0)} AS s{i:02d}"
                       for i, (x, a, b) in enumerate(zip(raw, m["mean"], m["std"])))
    margin = " + ".join(f"{_num(w)} * {_tree_sql(t)}" for w, t in zip(m["weights"], m["trees"]))
    return f"""scaled AS (SELECT *, {scaled} FROM {source}),
scored AS (SELECT *, 1 / (1 + exp(-2 * ({margin}))) AS p FROM scaled)"""


_SCORE_COLUMNS = """CASE WHEN transaction_amount IS NULL THEN 0 ELSE round_even(p * 10000, 0) / 10000 END AS fraud_probability,
       transaction_amount IS NOT NULL AND p >= 0.5 AS is_fraud,
       CASE WHEN transaction_amount IS NULL THEN 0 ELSE round_even(greatest(p, 1 - p) * 10000, 0) / 10000 END AS confidence"""

_ENR_TIMED = f"""{enriched_sql(60)},
timed AS (SELECT * FROM enr JOIN (SELECT event_id, hour_of_day, day_of_week, is_weekend
                                 FROM ({SQL["time_features"]})) USING (event_id))"""

SQL["scaled_vector"] = f"""
WITH {_ENR_TIMED}, {fixed_model_sql("timed")}
SELECT event_id, {", ".join(f"round(s{i:02d} * 1e9) / 1e9 AS s{i:02d}" for i in range(16))} FROM scaled"""

SQL["score_fixed_model"] = f"""
WITH {_ENR_TIMED},
holed AS (SELECT * REPLACE (CASE WHEN day_of_week <> 2 THEN transaction_amount END AS transaction_amount,
                            CASE WHEN day_of_week <> 4 THEN device_type END AS device_type) FROM timed),
{fixed_model_sql("holed")}
SELECT event_id, user_id, {_SCORE_COLUMNS} FROM scored"""

SQL["score_requests"] = f"""
WITH {EV},
req AS (SELECT event_id, transaction_amount, device_type, event_type, 'unknown' AS location,
               {", ".join(f"{v} AS {k}" for k, v in INFERENCE_DEFAULTS.items())} FROM ev),
{fixed_model_sql("req")}
SELECT event_id, {_SCORE_COLUMNS} FROM scored"""
