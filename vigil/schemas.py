"""Record types and the fixed values that must match the reference.

All string constants whose exact text is observable in outputs (enum members,
alert templates, icons, colours, recommendation lines) live here, together,
in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------

EVENT_TYPES = ["purchase", "transfer", "withdrawal", "login", "failed_login",
               "profile_update", "password_change"]
DEVICE_TYPES = ["mobile", "desktop", "tablet", "api"]
SEVERITIES = ["low", "medium", "high", "critical"]
ALERT_TYPES = ["fraud_detected", "high_transaction", "failed_attempts", "anomaly",
               "business_insight"]

DEFAULT_CURRENCY = "USD"
FAILED_LOGIN = "failed_login"

# Alert rules: (name, alert_type, severity, title template, description template).
# Templates use Python format syntax; vigil.operators.alerts renders them as
# Spark column expressions.
ALERT_RULE_TEXT = [
    ("FRAUD_HIGH_PROB", "fraud_detected", "critical",
     "🚨 High-Probability Fraud — User {user_id}",
     "Transaction {event_id} from user {user_id} scored {fraud_probability:.0%} fraud probability. "
     "Amount: ${transaction_amount:,.2f} | Location: {location}"),
    ("HIGH_TRANSACTION", "high_transaction", "high",
     "💰 High-Value Transaction — ${transaction_amount:,.2f}",
     "User {user_id} made a ${transaction_amount:,.2f} transaction via {device_type} from {location}."),
    ("FAILED_ATTEMPTS", "failed_attempts", "medium",
     "🔐 Repeated Failed Logins — User {user_id}",
     "User {user_id} has {failed_attempts_1h} failed login attempts in the last hour."),
    ("ANOMALY_NIGHT_API", "anomaly", "medium",
     "🌙 Night-time API Transaction — User {user_id}",
     "Large API transaction (${transaction_amount:,.2f}) at night by {user_id} from {location}."),
    ("VELOCITY_SPIKE", "anomaly", "high",
     "⚡ Transaction Velocity Spike — User {user_id}",
     "User {user_id} has {txn_count_1h} transactions in the last hour. Possible automated activity."),
]

# Chat payload: icon and attachment colour per severity, with their defaults.
CHAT_ICON = {"critical": "🚨", "high": "🔴", "medium": "🟡", "low": "🟢"}
CHAT_ICON_DEFAULT = "⚠️"
CHAT_COLOR = {"critical": "danger", "high": "warning", "medium": "warning", "low": "good"}
CHAT_COLOR_DEFAULT = "warning"
CHAT_CHANNEL = "#data-alerts"
# Channels every alert goes to, and the extra one for high/critical alerts.
BASE_CHANNELS = ["chat", "webhook"]
ESCALATION_CHANNEL = "email"
ESCALATION_SEVERITIES = ["high", "critical"]

# Insight text (deterministic template form).
INSIGHT_RECOMMENDATIONS = [
    "Review flagged transactions with fraud_probability > 0.85",
    "Investigate API-device transactions originating from unknown locations",
]
NO_ALERTS_TEXT = "No alerts in this window."
ALERT_SUMMARY_HEADER = "Alert Summary:"
TEMPLATE_MODEL = "template"

# Risk level cut-offs on fraud_rate (strictly greater than).
RISK_LEVELS = [(0.15, "critical"), (0.08, "high"), (0.03, "medium")]
RISK_DEFAULT = "low"

# Dashboard reference line for the fraud-rate chart, in percent.
FRAUD_PCT_REFERENCE = 5.0

# History buffer lengths (events, metrics windows, insights).
RECENT_EVENTS_MAX = 1000
METRICS_HISTORY_MAX = 500
INSIGHT_HISTORY_MAX = 100
METRICS_TTL_SECONDS = 3600

# Inference request defaults for optional features.
INFERENCE_DEFAULTS = {
    "hour_of_day": 12, "day_of_week": 0, "is_weekend": 0, "is_night": 0,
    "txn_count_1h": 1, "avg_amount_1h": 0.0, "max_amount_1h": 0.0,
    "failed_attempts_1h": 0, "unique_locations_1h": 1,
}

# Insight text templates (Python format syntax, rendered as Spark columns).
INSIGHT_TEXT_TEMPLATE = ("Processed {total_transactions} transactions totalling ${total_amount:,.2f}. "
                         "Fraud rate is {fraud_rate:.1%}, flagged as {risk_level} risk.")
INSIGHT_FINDING_TEMPLATES = [
    "Average transaction value: ${avg_amount:,.2f}",
    "Fraud count: {fraud_count} transactions",
    "Peak device: {peak_device}",
]
# Prompt for an external text model (the call itself is not part of this package).
USER_PROMPT_TEMPLATE = """Analyse the following transaction metrics from the last window 
and provide business insights:

METRICS:
- Window: {window_start} → {window_end}
- Total Transactions: {total_transactions}
- Total Amount: ${total_amount:,.2f}
- Average Transaction: ${avg_amount:,.2f}
- Maximum Transaction: ${max_amount:,.2f}
- Unique Users: {unique_users}
- Fraud Detected: {fraud_count} ({fraud_rate:.1%} fraud rate)
- Event Breakdown: {event_type_breakdown}
- Device Breakdown: {device_breakdown}
- Top Locations: {location_breakdown}

Generate insights, identify risks, and provide recommendations."""

# ---------------------------------------------------------------------------
# Spark schemas
# ---------------------------------------------------------------------------

RAW_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("transaction_amount", T.DoubleType()),
    T.StructField("location", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

# What the parser adds to a line that it can't read in full.
PARSE_COLUMNS = ["parse_errors", "corrupt_record"]
MALFORMED = "malformed_json"

# Columns of the canonical (typed) event frame every operator consumes.
CANONICAL_COLUMNS = ["event_id", "user_id", "session_id", "event_time", "transaction_amount",
                     "location", "device_type", "event_type", "currency"]

ROLLING_FEATURES = ["txn_count_1h", "avg_amount_1h", "max_amount_1h", "failed_attempts_1h",
                    "unique_locations_1h"]
TIME_FEATURES = ["hour_of_day", "day_of_week", "is_weekend", "is_night"]

# Feature vector order of the scoring model: 13 inputs then 3 derived.
MODEL_INPUTS = ["transaction_amount", "hour_of_day", "day_of_week", "is_weekend", "is_night",
                "device_type", "event_type", "location", "txn_count_1h", "avg_amount_1h",
                "max_amount_1h", "failed_attempts_1h", "unique_locations_1h"]
DERIVED_FEATURES = ["log_amount", "amount_vs_avg_ratio", "fail_rate"]
CATEGORICAL = ["device_type", "event_type", "location"]
