"""Alert rules, routing, payloads (R1–R15) and insights."""

import json
from datetime import timedelta

from pyspark.sql import functions as F

from helpers import T0, event, frame
from vigil.operators import alerts as AL
from vigil.operators import insights as IN


def enriched(spark, rows, **extra):
    df = frame(spark, rows)
    defaults = {"failed_attempts_1h": 0, "txn_count_1h": 1, "is_night": 0}
    defaults.update(extra)
    return df.withColumns({k: F.lit(v) for k, v in defaults.items()})


def fired(spark, rows, rules=None, **extra):
    return AL.evaluate_alerts(enriched(spark, rows, **extra), rules).collect()


def test_fraud_probability_alert(spark):
    a = fired(spark, [event(0, score=0.95, amount=49000.0, location="Unknown", device="api")])
    types = [x.alert_type for x in a]
    assert "fraud_detected" in types
    fd = [x for x in a if x.alert_type == "fraud_detected"][0]
    assert fd.severity == "critical"
    assert fd.title == "🚨 High-Probability Fraud — User user_0001"
    assert fd.description == ("Transaction e0000 from user user_0001 scored 95% fraud probability. "
                              "Amount: $49,000.00 | Location: Unknown")


def test_high_amount_with_custom_threshold(spark):
    a = fired(spark, [event(0, amount=50000.0)], AL.default_rules(high_amount=5000.0))
    assert [x.alert_type for x in a] == ["high_transaction"]
    assert a[0].title == "💰 High-Value Transaction — $50,000.00" and a[0].threshold == 5000.0


def test_failed_attempts_threshold(spark):
    a = fired(spark, [event(0)], AL.default_rules(failed_attempts=3), failed_attempts_1h=10)
    assert [x.alert_type for x in a] == ["failed_attempts"]
    assert a[0].description == "User user_0001 has 10 failed login attempts in the last hour."


def test_clean_event_no_alerts(spark):
    assert fired(spark, [event(0, amount=150.0, score=0.12)], failed_attempts_1h=1, txn_count_1h=3) == []


def test_boundaries(spark):
    rows = [event(0, score=0.85), event(1, amount=10000.0), event(2, amount=1000.0, device="api"),
            event(3, amount=1000.01, device="api")]
    a = fired(spark, rows, is_night=1)
    got = sorted((x.event_id, x.rule_name) for x in a)
    assert ("e0000", "FRAUD_HIGH_PROB") in got                 # >= .85
    assert ("e0001", "HIGH_TRANSACTION") in got                # >= 10,000
    assert ("e0002", "ANOMALY_NIGHT_API") not in got           # strict > 1,000
    assert ("e0003", "ANOMALY_NIGHT_API") in got


def test_velocity_and_rule_order(spark):
    a = fired(spark, [event(0, score=0.9, amount=20000.0)], txn_count_1h=25, failed_attempts_1h=8)
    assert [x.rule_name for x in sorted(a, key=lambda x: x.rule_order)] == [
        "FRAUD_HIGH_PROB", "HIGH_TRANSACTION", "FAILED_ATTEMPTS", "VELOCITY_SPIKE"]


def test_null_input_does_not_fire(spark):
    assert fired(spark, [event(0, score=None, amount=None)]) == []


def test_routing_and_payloads(spark):
    al = AL.evaluate_alerts(enriched(spark, [event(0, score=0.95)], failed_attempts_1h=6))
    d = sorted((r.severity, r.delivery_order, r.channel) for r in AL.alert_deliveries(al).collect())
    assert d == [("critical", 0, "chat"), ("critical", 1, "email"), ("critical", 2, "webhook"),
                 ("medium", 0, "chat"), ("medium", 1, "webhook")]
    p = {r.alert_id: r for r in AL.alert_payloads(al).collect()}
    crit = [r for r in p.values() if r.email_subject][0]
    chat = json.loads(crit.chat_json)
    assert chat["channel"] == "#data-alerts" and chat["text"].startswith("🚨 *🚨 High-Probability")
    assert chat["attachments"][0]["color"] == "danger"
    assert [f["title"] for f in chat["attachments"][0]["fields"]] == ["Severity", "Type", "User", "Triggered"]
    assert crit.email_subject.startswith("[CRITICAL] ")
    hook = json.loads(crit.webhook_json)
    assert set(hook) == {"alert_id", "type", "severity", "title", "description", "user_id", "triggered_at"}
    assert hook["triggered_at"] == "2024-01-15T14:00:00"


def test_counts_pivot_recent_digest(spark):
    rows = [event(i, score=0.95 if i % 2 else 0.1, t=T0 + timedelta(minutes=i)) for i in range(20)]
    al = AL.evaluate_alerts(enriched(spark, rows))
    assert {r.severity: r.alert_count for r in AL.alert_counts(al).collect()} == {"critical": 10}
    assert AL.alert_pivot(al).collect()[0].asDict() == {"critical": 10, "high": 0, "medium": 0, "low": 0}
    rec = AL.recent_alerts(al, limit=3).orderBy("position").collect()
    assert [r.event_id for r in rec] == ["e0015", "e0017", "e0019"]
    windows = spark.createDataFrame([(T0,), (T0 + timedelta(hours=1),)], "window_start timestamp_ntz")
    dig = {r.window_start: r.digest for r in AL.alert_digest(al, windows, "1 hour", 5).collect()}
    assert dig[T0 + timedelta(hours=1)] == "No alerts in this window."
    lines = dig[T0].split("\n")
    assert lines[0] == "Alert Summary:" and len(lines) == 6 and lines[1].startswith("• [CRITICAL] ")


def metrics(spark, rates):
    return spark.createDataFrame(
        [(T0 + timedelta(minutes=i), T0 + timedelta(minutes=i + 1), 200, 80000.0, 400.0, 15000.0, 80,
          int(r * 200), r, {"mobile": 120, "api": 80} if i else {}) for i, r in enumerate(rates)],
        "window_start timestamp_ntz, window_end timestamp_ntz, total_transactions long, total_amount double, "
        "avg_amount double, max_amount double, unique_users long, fraud_count long, fraud_rate double, "
        "device_breakdown map<string,bigint>")


def test_risk_levels_strict(spark):
    rates = [0.01, 0.20, 0.03, 0.08, 0.15, 0.0301]
    got = [r.risk_level for r in IN.template_insights(metrics(spark, rates)).orderBy("window_start").collect()]
    assert got == ["low", "critical", "low", "medium", "high", "medium"]


def test_insight_text_and_findings(spark):
    r = IN.template_insights(metrics(spark, [0.01, 0.05])).orderBy("window_start").collect()
    assert r[1].insight_text == ("Processed 200 transactions totalling $80,000.00. "
                                 "Fraud rate is 5.0%, flagged as medium risk.")
    assert r[1].key_findings == ["Average transaction value: $400.00", "Fraud count: 10 transactions",
                                 "Peak device: mobile"]
    assert r[0].key_findings[2] == "Peak device: N/A"
    assert len(r[0].recommendations) == 2 and r[0].model_used == "template"


def test_model_response_fallback(spark):
    ins = IN.template_insights(metrics(spark, [0.01, 0.2]))
    good = json.dumps({"insight_text": "t", "key_findings": ["a"], "recommendations": ["b"], "risk_level": "high"})
    resp = ins.withColumn("model_response", F.when(F.col("risk_level") == "low", F.lit("not json {"))
                          .otherwise(F.lit(good)))
    out = {r.risk_level: r for r in IN.apply_model_response(resp).collect()}
    assert out["low"].model_used == "template"
    assert out["high"].insight_text == "t" and out["high"].model_used == "external"


def test_prompt_has_json_breakdowns(spark):
    p = IN.insight_prompts(metrics(spark, [0.041, 0.041]).withColumn(
        "event_type_breakdown", F.create_map(F.lit("purchase"), F.lit(180).cast("long")))).collect()
    text = [r.prompt for r in p if "mobile" in r.prompt][0]
    assert '- Device Breakdown: {"mobile": 120, "api": 80}' in text
    assert "- Fraud Detected: 8 (4.1% fraud rate)" in text
    assert '- Event Breakdown: {"purchase": 180}' in text and "- Top Locations: {}" in text
