"""Rule evaluation, routing, payloads and alert reads.

A rule is a boolean Column plus literal metadata and two text templates.  All
rules are evaluated in one pass: each event carries an array of the indices
of the rules that fire, which is exploded (events with no alert vanish), and
the text columns are rendered only for rows that fired.  No per-rule scans,
no unions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.fmt import NA, render_template
from vigil.functions.time import iso_text
from vigil.schemas import (ALERT_RULE_TEXT, BASE_CHANNELS, CHAT_CHANNEL, CHAT_COLOR,
                           CHAT_COLOR_DEFAULT, CHAT_ICON, CHAT_ICON_DEFAULT, ESCALATION_CHANNEL,
                           ESCALATION_SEVERITIES, SEVERITIES)


@dataclass(frozen=True)
class Rule:
    name: str
    alert_type: str
    severity: str
    condition: Column
    title: str
    description: str
    threshold: float | None = None


def default_rules(fraud_threshold: float = 0.85, high_amount: float = 10_000.0,
                  failed_attempts: int = 5, velocity: int = 20,
                  night_api_amount: float = 1_000.0) -> list[Rule]:
    """The five default rules, in evaluation order."""
    text = {r[0]: r for r in ALERT_RULE_TEXT}
    amt = F.col("transaction_amount").cast("double")
    conds = {
        "FRAUD_HIGH_PROB": (F.col("fraud_probability").cast("double") >= F.lit(fraud_threshold),
                            fraud_threshold),
        "HIGH_TRANSACTION": (amt >= F.lit(high_amount), high_amount),
        "FAILED_ATTEMPTS": (F.col("failed_attempts_1h") >= F.lit(failed_attempts), float(failed_attempts)),
        "ANOMALY_NIGHT_API": ((F.col("device_type") == F.lit("api")) & (F.col("is_night") == 1)
                              & (amt > F.lit(night_api_amount)), night_api_amount),
        "VELOCITY_SPIKE": (F.col("txn_count_1h") >= F.lit(velocity), float(velocity)),
    }
    return [Rule(name, atype, sev, conds[name][0], title, desc, conds[name][1])
            for name, atype, sev, title, desc in (text[n] for n in conds)]


def _pick(idx: Column, values: list[Column]) -> Column:
    """values[idx] for a small literal list, as a CASE chain."""
    out = None
    for i, v in enumerate(values):
        out = F.when(idx == i, v) if out is None else out.when(idx == i, v)
    return out


def evaluate_alerts(events: DataFrame, rules: list[Rule] | None = None,
                    time_col: str = "event_time") -> DataFrame:
    """One row per (event, fired rule), in rule order within an event.

    A predicate that is null (missing input) does not fire (D7).  ``alert_id``
    is a hash of (event_id, rule) so re-running the job yields the same ids
    and sinks can insert idempotently; ``triggered_at`` is the event time.
    """
    rules = rules or default_rules()
    fired = F.filter(F.array(*[F.when(F.coalesce(r.condition, F.lit(False)), F.lit(i))
                               for i, r in enumerate(rules)]), lambda x: x.isNotNull())
    ex = events.select("*", F.explode(fired).alias("rule_order"))
    idx = F.col("rule_order")
    name = _pick(idx, [F.lit(r.name) for r in rules])
    return ex.select(
        F.sha2(F.concat_ws("|", F.col("event_id"), name), 256).alias("alert_id"),
        name.alias("rule_name"),
        idx.alias("rule_order"),
        _pick(idx, [F.lit(r.alert_type) for r in rules]).alias("alert_type"),
        _pick(idx, [F.lit(r.severity) for r in rules]).alias("severity"),
        _pick(idx, [render_template(r.title) for r in rules]).alias("title"),
        _pick(idx, [render_template(r.description) for r in rules]).alias("description"),
        F.col("user_id"),
        F.col("event_id"),
        F.col("transaction_amount").cast("double").alias("value"),
        _pick(idx, [F.lit(r.threshold).cast("double") for r in rules]).alias("threshold"),
        F.col(time_col).alias("triggered_at"),
        F.lit(False).alias("resolved"),
    )


# ---------------------------------------------------------------------------
# A10 / A11
# ---------------------------------------------------------------------------

def alert_counts(alerts: DataFrame) -> DataFrame:
    """A10: alerts per severity."""
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alert_count"))


def alert_pivot(alerts: DataFrame) -> DataFrame:
    """One row with a count column per severity (absent severities 0).

    Conditional sums in a single global aggregate: partial counts per task,
    one row per task reaches the final stage.
    """
    return alerts.agg(*[F.coalesce(F.sum((F.col("severity") == s).cast("long")), F.lit(0)).alias(s)
                        for s in reversed(SEVERITIES)])


# ---------------------------------------------------------------------------
# Routing and payloads
# ---------------------------------------------------------------------------

def alert_deliveries(alerts: DataFrame) -> DataFrame:
    """One row per (alert, channel) in dispatch order: chat, then email
    for high/critical, then webhook."""
    escalate = F.col("severity").isin(ESCALATION_SEVERITIES)
    chans = F.when(escalate, F.array(F.lit(BASE_CHANNELS[0]), F.lit(ESCALATION_CHANNEL),
                                     F.lit(BASE_CHANNELS[1]))) \
             .otherwise(F.array(*[F.lit(c) for c in BASE_CHANNELS]))
    return alerts.select("alert_id", "severity", F.posexplode(chans).alias("delivery_order", "channel"))


def _lookup(col: Column, table: dict[str, str], default: str) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, col), F.lit(default))


def chat_payload(alerts: DataFrame, channel: str = CHAT_CHANNEL) -> Column:
    """R11 as a JSON text column."""
    sev = F.col("severity")
    fields = F.array(
        F.struct(F.lit("Severity").alias("title"), F.upper(sev).alias("value"), F.lit(True).alias("short")),
        F.struct(F.lit("Type").alias("title"), F.col("alert_type").alias("value"), F.lit(True).alias("short")),
        F.struct(F.lit("User").alias("title"), F.coalesce(F.col("user_id"), F.lit(NA)).alias("value"),
                 F.lit(True).alias("short")),
        F.struct(F.lit("Triggered").alias("title"), iso_text(F.col("triggered_at")).alias("value"),
                 F.lit(True).alias("short")),
    )
    payload = F.struct(
        F.lit(channel).alias("channel"),
        F.concat(_lookup(sev, CHAT_ICON, CHAT_ICON_DEFAULT), F.lit(" *"), F.col("title"), F.lit("*\n"),
                 F.col("description")).alias("text"),
        F.array(F.struct(_lookup(sev, CHAT_COLOR, CHAT_COLOR_DEFAULT).alias("color"),
                         fields.alias("fields"))).alias("attachments"),
    )
    return F.to_json(payload, {"ignoreNullFields": "false"})


def email_subject(alerts: DataFrame) -> Column:
    """R12 subject line."""
    return F.concat(F.lit("["), F.upper(F.col("severity")), F.lit("] "), F.col("title"))


def email_body(alerts: DataFrame) -> Column:
    """R12 HTML body (same content and structure; compact whitespace)."""
    colour = F.when(F.col("severity") == "critical", F.lit("red")).otherwise(F.lit("orange"))
    row = lambda k, v: F.concat(F.lit(f"<tr><td><b>{k}</b></td><td>"), v, F.lit("</td></tr>"))
    return F.concat(
        F.lit('<html><body><h2 style="color:'), colour, F.lit('">'), F.col("title"), F.lit("</h2><p>"),
        F.col("description"), F.lit('</p><table border="1" cellpadding="5">'),
        row("Severity", F.col("severity")), row("Type", F.col("alert_type")),
        row("User", F.coalesce(F.col("user_id"), F.lit(NA))),
        row("Time", iso_text(F.col("triggered_at"), sep=" ")),
        F.lit("</table></body></html>"))


def webhook_payload(alerts: DataFrame) -> Column:
    """R13 as a JSON text column (7 fields)."""
    return F.to_json(F.struct(
        F.col("alert_id"), F.col("alert_type").alias("type"), F.col("severity"), F.col("title"),
        F.col("description"), F.col("user_id"), iso_text(F.col("triggered_at")).alias("triggered_at")),
        {"ignoreNullFields": "false"})


def alert_payloads(alerts: DataFrame) -> DataFrame:
    """R11–R13 for every alert (email fields only where it is routed)."""
    escalate = F.col("severity").isin(ESCALATION_SEVERITIES)
    return alerts.select(
        "alert_id",
        chat_payload(alerts).alias("chat_json"),
        F.when(escalate, email_subject(alerts)).alias("email_subject"),
        F.when(escalate, email_body(alerts)).alias("email_html"),
        webhook_payload(alerts).alias("webhook_json"),
    )


# ---------------------------------------------------------------------------
# R14 / R15 / I9
# ---------------------------------------------------------------------------

ARRIVAL = ["triggered_at", "event_id", "rule_order"]


def recent_alerts(alerts: DataFrame, limit: int = 50, display: int = 10) -> DataFrame:
    """The most recent ``limit`` alerts, with their position in
    arrival order (1 = oldest of the returned set) and whether the display
    list (its first ``display`` entries) shows them."""
    top = alerts.orderBy(*[F.desc(c) for c in ARRIVAL]).limit(limit)
    w = Window.orderBy(*ARRIVAL)  # over at most `limit` rows
    pos = F.row_number().over(w).cast("long")
    return top.withColumn("position", pos).withColumn("displayed", F.col("position") <= F.lit(display))


def alert_digest(alerts: DataFrame, windows: DataFrame, every: str = "1 hour",
                 first: int = 5, style: str = "summary") -> DataFrame:
    """Per window, the first alerts as text lines.

    ``style="summary"``: the first ``first`` (5) alerts as bullet lines under
    a header, or the empty-window sentence.  ``style="prompt"``: the first 10
    as ``- [severity] title: description`` lines (the text handed to a model),
    or the empty-window sentence.

    Only the first few alerts of each window are kept before grouping (a
    ranked filter Spark evaluates as a partial per-task limit), so no window's
    full alert list is ever gathered.
    """
    from vigil.schemas import ALERT_SUMMARY_HEADER, NO_ALERTS_TEXT
    if style == "prompt":
        first = 10
        line = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("title"), F.lit(": "),
                        F.col("description"))
        header = ""
    else:
        line = F.concat(F.lit("• ["), F.upper(F.col("severity")), F.lit("] "), F.col("title"), F.lit(": "),
                        F.col("description"))
        header = ALERT_SUMMARY_HEADER + "\n"
    ws = F.window("triggered_at", every).start
    rank = Window.partitionBy("window_start").orderBy(*ARRIVAL)
    firsts = (alerts.select(ws.alias("window_start"), *ARRIVAL, line.alias("line"))
                    .withColumn("_r", F.row_number().over(rank))
                    .filter(F.col("_r") <= first))
    digests = firsts.groupBy("window_start").agg(
        F.concat(F.lit(header),
                 F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "line"))),
                                          lambda s: s["line"]), "\n")).alias("digest"))
    return (windows.select("window_start").distinct()
                   .join(digests, "window_start", "left")
                   .select("window_start", F.coalesce("digest", F.lit(NO_ALERTS_TEXT)).alias("digest")))
