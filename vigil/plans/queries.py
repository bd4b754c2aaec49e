"""Named queries over the driver tables: ``(spark, sf_dir) -> DataFrame``.

Each query composes operators from ``vigil.operators``; the matching SQL in
``vigil.plans.oracle`` states the same result for DuckDB.  Computed columns
carry identical aliases on both sides.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.fmt import money, percent
from vigil.functions.time import iso_text, with_time_features
from vigil.operators import alerts as AL
from vigil.operators import fixed_model as FM
from vigil.operators import insights as IN
from vigil.operators import ml as ML
from vigil.operators import store as ST
from vigil.operators import summary as S
from vigil.operators.rolling import rolling_user_features
from vigil.operators.summary import round_to
from vigil.operators.validation import split_valid, validate_events, with_inference_defaults
from vigil.plans.stream_pipeline import run_stream_pipeline, stream_insights
from vigil.schemas import FRAUD_PCT_REFERENCE, INSIGHT_HISTORY_MAX, METRICS_HISTORY_MAX, MODEL_INPUTS
from vigil.session import ensure_checkpoint_dir, pin_utc, scratch_path
from vigil.sources.json_events import archive_events, json_file_stream, parse_events, read_archive, to_wire
from vigil.sources.tables import canonical_events, load_events, read_table
from vigil.streaming import jobs as SJ

# The driver's events use 'error' where the reference has 'failed_login'.
FAILED_TYPE = "error"
VALIDATE = {"event_types": ["click", "error", "purchase", "signup", "view"]}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    return load_events(spark, sf_dir)


def q_time_features(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return with_time_features(ev).select("event_id", "event_time", "hour_of_day", "day_of_week",
                                         "is_weekend", "is_night")


def q_rolling_user_features(spark, sf_dir):
    ev = _events(spark, sf_dir).select("event_id", "user_id", "event_time", "transaction_amount",
                                       "event_type", "location")
    out = rolling_user_features(ev, window_minutes=60, failed_type=FAILED_TYPE)
    return out.select("event_id", "user_id", "event_time", "txn_count_1h", "avg_amount_1h",
                      "max_amount_1h", "failed_attempts_1h", "unique_locations_1h")


QUERIES = {
    "time_features": q_time_features,
    "rolling_user_features": q_rolling_user_features,
}


# ---------------------------------------------------------------------------
# Aggregation
# ---------------------------------------------------------------------------


def q_window_summary_1m(spark, sf_dir):
    return S.window_summary(_events(spark, sf_dir), "1 minute")


def q_window_summary_1h(spark, sf_dir):
    return S.window_summary(_events(spark, sf_dir), "1 hour")


def _breakdown(dim, top=None):
    def q(spark, sf_dir):
        long = S.breakdown_counts(_events(spark, sf_dir), "1 hour", dims=[dim],
                                  top={dim: top} if top else {})
        return long.select("window_start", "value", "cnt", "rnk")
    return q


def _map_text(m):
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"),
                                                                          e["value"].cast("string"))), ",")


def q_window_metrics(spark, sf_dir):
    wm = S.window_metrics(_events(spark, sf_dir), "1 hour")
    return wm.select(*[c for c in wm.columns if not c.endswith("breakdown")],
                     *[_map_text(F.col(c)).alias(c) for c in wm.columns if c.endswith("breakdown")])


def q_count_windows(spark, sf_dir):
    return S.count_windows(_events(spark, sf_dir), every=100)


def q_metrics_rollup(spark, sf_dir):
    recent = S.in_latest_windows(_events(spark, sf_dir), "1 minute", 60)
    return S.metrics_rollup(S.window_summary(recent, "1 minute"), n=60)


QUERIES.update({
    "window_summary_1m": q_window_summary_1m,
    "window_summary_1h": q_window_summary_1h,
    "event_type_breakdown": _breakdown("event_type"),
    "device_breakdown": _breakdown("device_type"),
    "top_locations": _breakdown("location", 10),
    "window_metrics": q_window_metrics,
    "count_windows": q_count_windows,
    "metrics_rollup": q_metrics_rollup,
})


# ---------------------------------------------------------------------------
# Alerts (R1–R15, A10–A11, I9)
# ---------------------------------------------------------------------------


# The driver's data is sparse (at most ~11 events per user-day, amounts below
# 600), so rule queries use a 24-hour frame and thresholds that fire on it.
RULE_WINDOW_MINUTES = 24 * 60
RULE_PARAMS = dict(fraud_threshold=0.85, high_amount=200.0, failed_attempts=2, velocity=5,
                   night_api_amount=100.0)


def enriched_events(spark, sf_dir, window_minutes=RULE_WINDOW_MINUTES):
    """Canonical events + calendar features + rolling features (given score)."""
    ev = with_time_features(_events(spark, sf_dir))
    return rolling_user_features(ev, window_minutes=window_minutes, failed_type=FAILED_TYPE)


def alerts_frame(spark, sf_dir):
    return AL.evaluate_alerts(enriched_events(spark, sf_dir), AL.default_rules(**RULE_PARAMS))


def q_alert_events(spark, sf_dir):
    return alerts_frame(spark, sf_dir).drop("resolved")


def q_alert_counts(spark, sf_dir):
    return AL.alert_counts(alerts_frame(spark, sf_dir))


def q_alert_pivot(spark, sf_dir):
    return AL.alert_pivot(alerts_frame(spark, sf_dir))


def q_alert_deliveries(spark, sf_dir):
    return AL.alert_deliveries(alerts_frame(spark, sf_dir)).withColumn(
        "delivery_order", F.col("delivery_order").cast("long"))


def q_alert_payloads(spark, sf_dir):
    return AL.alert_payloads(alerts_frame(spark, sf_dir))


def q_recent_alerts(spark, sf_dir):
    r = AL.recent_alerts(alerts_frame(spark, sf_dir), limit=50, display=10)
    return r.select("position", "displayed", "alert_id", "severity", "title", "triggered_at")


def q_alert_digest(spark, sf_dir):
    ev = _events(spark, sf_dir)
    windows = ev.select(F.window("event_time", "1 hour").start.alias("window_start"))
    return AL.alert_digest(alerts_frame(spark, sf_dir), windows, "1 hour", first=5)


def q_alert_prompt(spark, sf_dir):
    ev = _events(spark, sf_dir)
    windows = ev.select(F.window("event_time", "1 hour").start.alias("window_start"))
    return AL.alert_digest(alerts_frame(spark, sf_dir), windows, "1 hour", style="prompt")


QUERIES.update({
    "alert_prompt": q_alert_prompt,
    "alert_events": q_alert_events,
    "alert_counts": q_alert_counts,
    "alert_pivot": q_alert_pivot,
    "alert_deliveries": q_alert_deliveries,
    "alert_payloads": q_alert_payloads,
    "recent_alerts": q_recent_alerts,
    "alert_digest": q_alert_digest,
})


# ---------------------------------------------------------------------------
# Validation and store
# ---------------------------------------------------------------------------


MIDPOINT = "2024-01-16 00:00:00"


def q_quarantine(spark, sf_dir):
    _, bad = split_valid(_events(spark, sf_dir))
    return bad.select("event_id", "event_type", F.array_join("reject_reasons", ",").alias("reasons"))


def q_idempotent_insert(spark, sf_dir):
    """Batch 1 = events before the midpoint; batch 2 replays the whole table.
    First write wins: early events keep batch 1, later ones come from batch 2."""
    ev = _events(spark, sf_dir).select("event_id", "user_id", "event_time", "transaction_amount")
    first = ev.filter(F.col("event_time") < F.lit(MIDPOINT).cast("timestamp_ntz")).withColumn("batch", F.lit(1))
    replay = ev.withColumn("batch", F.lit(2))
    return ST.idempotent_insert(first, replay, key="event_id", arrival_cols=["batch"])


def q_recent_events(spark, sf_dir):
    ev = _events(spark, sf_dir).select("event_id", "user_id", "event_time", "transaction_amount")
    return ST.recent_events(ev, n=100, order_cols=["event_time", "event_id"], time_cols=["event_time"])


def q_risky_events(spark, sf_dir):
    ev = _events(spark, sf_dir).select("event_id", "user_id", "event_time", "fraud_probability")
    return ST.risky_events(ev, min_score=0.8, n=20)


def q_latest_metrics(spark, sf_dir):
    return ST.latest_row(S.window_summary(S.in_latest_windows(_events(spark, sf_dir), "1 minute", 1), "1 minute"))


def q_metrics_history(spark, sf_dir):
    recent = S.in_latest_windows(_events(spark, sf_dir), "1 minute", METRICS_HISTORY_MAX)
    hist = ST.bounded_history(S.window_summary(recent, "1 minute"), METRICS_HISTORY_MAX, ["window_start"])
    return ST.list_range(hist, -60, -1).select("pos", "window_start", "total_transactions", "fraud_rate")


def q_latest_per_user(spark, sf_dir):
    ev = _events(spark, sf_dir).select("user_id", "event_id", "event_time", "transaction_amount")
    return ST.latest_by_key(ev, "user_id", ["event_time", "event_id"])


def q_event_counters(spark, sf_dir):
    ev = _events(spark, sf_dir)
    mid = F.lit(MIDPOINT).cast("timestamp_ntz")
    c1 = ST.increment_counters(None, ev.filter(F.col("event_time") < mid), "user_id")
    return ST.increment_counters(c1, ev.filter(F.col("event_time") >= mid), "user_id")


def q_fresh_metrics(spark, sf_dir):
    m = S.window_summary(_events(spark, sf_dir), "1 minute").withColumn("updated_at", F.col("window_end"))
    as_of = m.agg(F.max("updated_at")).first()[0]  # one scalar
    return ST.fresh_rows(m, F.lit(as_of)).select("window_start", "total_transactions")


def q_archive_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "archive")
    archive_events(_events(spark, sf_dir).select("event_id", "user_id", "event_time", "transaction_amount"),
                   path, mode="overwrite")
    back = read_archive(spark, path)
    return back.groupBy("year", "month", "day", "hour").agg(F.count(F.lit(1)).alias("n_events"))


QUERIES.update({
    "quarantine": q_quarantine,
    "idempotent_insert": q_idempotent_insert,
    "recent_events": q_recent_events,
    "risky_events": q_risky_events,
    "latest_metrics": q_latest_metrics,
    "metrics_history": q_metrics_history,
    "latest_per_user": q_latest_per_user,
    "event_counters": q_event_counters,
    "fresh_metrics": q_fresh_metrics,
    "archive_roundtrip": q_archive_roundtrip,
})


# ---------------------------------------------------------------------------
# Insights and dashboard reads
# ---------------------------------------------------------------------------


INSIGHT_EVERY = 100


def _insights(spark, sf_dir):
    cwm = S.count_window_metrics(_events(spark, sf_dir), every=INSIGHT_EVERY)
    ins = IN.template_insights(cwm, "first_event_time", "last_event_time")
    return ins, cwm


def _flat_insights(ins):
    return ins.select("insight_id", "window_start", "window_end", "insight_text",
                      F.array_join("key_findings", "\n").alias("key_findings"),
                      F.array_join("recommendations", "\n").alias("recommendations"),
                      "risk_level", "model_used")


def q_insights(spark, sf_dir):
    return _flat_insights(_insights(spark, sf_dir)[0])


def q_insight_prompts(spark, sf_dir):
    cwm = S.count_window_metrics(_events(spark, sf_dir), every=INSIGHT_EVERY)
    return IN.insight_prompts(cwm, "first_event_time", "last_event_time")


def q_latest_insight(spark, sf_dir):
    ins, _ = _insights(spark, sf_dir)
    return ST.latest_row(ins.select("insight_id", "window_start", "risk_level", "insight_text"),
                         "window_start")


def q_insight_history(spark, sf_dir):
    ins, _ = _insights(spark, sf_dir)
    hist = ST.bounded_history(ins.select("insight_id", "window_start", "risk_level"), INSIGHT_HISTORY_MAX,
                              ["window_start"])
    return ST.list_range(hist, -10, -1)


def q_run_counters(spark, sf_dir):
    ev = _events(spark, sf_dir)
    parts = [
        ev.agg(F.count(F.lit(1)).alias("value")).withColumn("counter", F.lit("processed")),
        alerts_frame(spark, sf_dir).agg(F.count(F.lit(1)).alias("value")).withColumn("counter", F.lit("alerts")),
        S.count_windows(ev, every=INSIGHT_EVERY).agg(F.count(F.lit(1)).alias("value"))
         .withColumn("counter", F.lit("insights")),
        ev.agg(F.sum(F.col("is_fraud").cast("long")).alias("value")).withColumn("counter", F.lit("fraud_detected")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("counter", F.col("value").cast("long").alias("value"))


def q_throughput_series(spark, sf_dir):
    m = S.window_summary(_events(spark, sf_dir), "1 hour")
    pct = F.col("fraud_rate") * F.lit(100.0)
    return m.select("window_start", "total_transactions",
                    F.coalesce(F.col("fraud_count"), F.lit(0)).alias("fraud_count"),
                    pct.alias("fraud_pct"), (pct > F.lit(FRAUD_PCT_REFERENCE)).alias("above_reference"))


def q_kpi_row(spark, sf_dir):
    latest = ST.latest_row(S.window_summary(S.in_latest_windows(_events(spark, sf_dir), "1 minute", 1), "1 minute"))
    return latest.select(
        iso_text(F.col("window_start")).alias("last_metrics_window"),
        "total_transactions",
        F.concat(F.lit("$"), money(F.col("total_amount"), 0)).alias("total_volume"),
        F.concat(F.lit("$"), money(F.col("avg_amount"), 0)).alias("avg_transaction"),
        "unique_users", "fraud_count", "fraud_rate",
        percent(F.col("fraud_rate"), 1).alias("fraud_rate_text"))


QUERIES.update({
    "insights": q_insights,
    "insight_prompts": q_insight_prompts,
    "latest_insight": q_latest_insight,
    "insight_history": q_insight_history,
    "run_counters": q_run_counters,
    "throughput_series": q_throughput_series,
    "kpi_row": q_kpi_row,
})


# ---------------------------------------------------------------------------
# ML (M1–M18)
# ---------------------------------------------------------------------------


_ML_FRAMES: dict = {}


def _ml_frame(spark, sf_dir):
    """Enriched events with the given flag as label, pruned to the model's
    inputs and materialised once per session and table folder (encoders,
    fits, scores and folds all read it)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ML_FRAMES:
        ensure_checkpoint_dir(spark)
        ev = enriched_events(spark, sf_dir, window_minutes=60)
        _ML_FRAMES[key] = ev.withColumn("label", F.col("is_fraud").cast("int")) \
                            .select("event_id", "user_id", "label", *MODEL_INPUTS).checkpoint()
    return _ML_FRAMES[key]


def q_ml_features(spark, sf_dir):
    ev = enriched_events(spark, sf_dir, window_minutes=60)
    f = ML.encode_features(ev)
    return f.select("event_id", "device_type_enc", "event_type_enc", "location_enc",
                    round_to(F.col("log_amount"), 9).alias("log_amount"),
                    "amount_vs_avg_ratio", "fail_rate")


def _metric_input(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return ev.select((F.col("event_type") == FAILED_TYPE).cast("int").alias("label"),
                     F.col("fraud_probability").alias("score"),
                     F.col("is_fraud").cast("int").alias("prediction"))


def q_auc(spark, sf_dir):
    return ML.roc_auc(_metric_input(spark, sf_dir), "label", "score")


def q_confusion(spark, sf_dir):
    return ML.confusion_counts(_metric_input(spark, sf_dir))


def q_f1(spark, sf_dir):
    return ML.classification_metrics(_metric_input(spark, sf_dir))


def q_class_report(spark, sf_dir):
    return ML.classification_report(_metric_input(spark, sf_dir))


def q_auc_raw(spark, sf_dir):
    """M11 on scores off any decimal grid."""
    ev = _events(spark, sf_dir)
    return ML.roc_auc(ev.select((F.col("event_type") == FAILED_TYPE).cast("int").alias("label"),
                                (F.col("transaction_amount") / F.lit(601.7)).alias("score")), "label", "score")


def _labelled_ids(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.col("is_fraud").cast("int").alias("label"))


def q_stratified_split(spark, sf_dir):
    train, test = ML.stratified_split(_labelled_ids(spark, sf_dir), "label", "event_id")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def q_stratified_folds(spark, sf_dir):
    return ML.stratified_folds(_labelled_ids(spark, sf_dir), 5, "label", "event_id")


_MODELS: dict = {}


def _model(spark, sf_dir):
    """The default model (200 trees of depth 6) fitted on the training split
    of ``sf_dir``, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        frame = _ml_frame(spark, sf_dir)
        train, _ = ML.stratified_split(frame, "label", "event_id")
        _MODELS[key] = ML.fit_model(ML.checkpoint_dealt(train, frame.count()), "label")
    return _MODELS[key]


def q_fraud_scores(spark, sf_dir):
    return ML.score(_model(spark, sf_dir), _ml_frame(spark, sf_dir), keep=["event_id", "user_id", "label"])


def q_inference_batch(spark, sf_dir):
    """P8 + M16: requests carry only the five required fields; the optional
    features take their defaults before scoring."""
    req = _events(spark, sf_dir).select("event_id", "user_id", "transaction_amount", "device_type",
                                        "event_type", "location")
    return ML.score(_model(spark, sf_dir), with_inference_defaults(req),
                    keep=["event_id", "user_id", "transaction_amount"])


def q_train_metrics(spark, sf_dir):
    _, metrics = ML.train_and_save(_ml_frame(spark, sf_dir), scratch_path(spark, "model"),
                                   model=_model(spark, sf_dir))
    return metrics


def q_cv_auc(spark, sf_dir):
    return ML.cross_validated_auc(_ml_frame(spark, sf_dir), k=5)


QUERIES.update({
    "ml_features": q_ml_features,
    "auc": q_auc,
    "auc_raw": q_auc_raw,
    "stratified_folds": q_stratified_folds,
    "confusion": q_confusion,
    "f1": q_f1,
    "class_report": q_class_report,
    "stratified_split": q_stratified_split,
    "fraud_scores": q_fraud_scores,
    "inference_batch": q_inference_batch,
    "train_metrics": q_train_metrics,
    "cv_auc": q_cv_auc,
})


# ---------------------------------------------------------------------------
# Streaming (A7, S5–S7, W8): the driver table replayed as in-order micro-batches
# ---------------------------------------------------------------------------


STREAM_SLICES = 8
SLICE_FILES = 4  # files of a slice, read as one micro-batch
# Run statistics of the last streaming query run per name (batches, latency,
# watermark drops); read by bench.py.
STREAM_STATS: dict[str, dict] = {}


_STAGED: dict = {}


def _event_stream(spark, sf_dir, closed=False):
    """Stage the events table as time slices (once per session and table
    folder; every stream query keeps its own checkpoint and sink), then read
    it as a file stream, one slice per trigger.  ``closed`` adds an empty event
    a day later, which moves the watermark past the last windows; its own
    window stays open."""
    raw = read_table(spark, sf_dir, "events")
    key = (spark.sparkContext.applicationId, sf_dir, closed)
    if key not in _STAGED:
        staged = scratch_path(spark, "stream-src")
        SJ.stage_time_slices(raw, staged, STREAM_SLICES, "ts", files=SLICE_FILES)
        if closed:
            last = raw.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).where("ts is not null")
            (last.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in raw.schema])
                 .coalesce(1).write.mode("append").parquet(staged))
        _STAGED[key] = staged
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", SLICE_FILES).parquet(_STAGED[key])
    return SJ.with_event_timestamp(canonical_events(stream))


def q_stream_tumbling(spark, sf_dir):
    pin_utc(spark)
    agg = SJ.tumbling_summary_append(_event_stream(spark, sf_dir, closed=True), "1 minute", "10 minutes")
    sink, ckpt = scratch_path(spark, "stream-tumbling"), scratch_path(spark, "ckpt-tumbling")
    STREAM_STATS["stream_tumbling"] = SJ.run_available(agg, sink, ckpt, "append")
    out = spark.read.parquet(sink).drop("batch_id")
    return out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"),
                            "window_end": F.col("window_end").cast("timestamp_ntz")})


def q_stream_rolling(spark, sf_dir):
    pin_utc(spark)
    feats = SJ.rolling_features_stream(_event_stream(spark, sf_dir), 60, FAILED_TYPE)
    sink, ckpt = scratch_path(spark, "stream-rolling"), scratch_path(spark, "ckpt-rolling")
    STREAM_STATS["stream_rolling"] = SJ.run_available(feats, sink, ckpt, "append")
    out = spark.read.parquet(sink).drop("batch_id")
    return out.select("event_id", "user_id",
                      F.timestamp_micros("t_us").cast("timestamp_ntz").alias("event_time"),
                      "txn_count_1h", "avg_amount_1h", "max_amount_1h", "failed_attempts_1h",
                      "unique_locations_1h")


def q_stream_dedupe(spark, sf_dir):
    """S7 on a stream: the replay contains every event twice (the staged slices
    plus the whole table again); the first copy per event_id survives."""
    pin_utc(spark)
    raw = read_table(spark, sf_dir, "events")
    staged = scratch_path(spark, "stream-dup")
    SJ.stage_time_slices(raw, staged, STREAM_SLICES, "ts", files=SLICE_FILES)
    raw.write.mode("append").parquet(staged)
    stream = SJ.with_event_timestamp(canonical_events(
        spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", SLICE_FILES).parquet(staged)))
    dedup = SJ.dedupe_stream(stream.select("event_id", "user_id", "event_time", "transaction_amount"))
    sink, ckpt = scratch_path(spark, "stream-dedupe"), scratch_path(spark, "ckpt-dedupe")
    SJ.run_available(dedup, sink, ckpt, "append")
    return (spark.read.parquet(sink).drop("batch_id")
            .withColumn("event_time", F.col("event_time").cast("timestamp_ntz")))


QUERIES.update({
    "stream_tumbling": q_stream_tumbling,
    "stream_rolling": q_stream_rolling,
    "stream_dedupe": q_stream_dedupe,
})


# ---------------------------------------------------------------------------
# Wire format and table writes
# ---------------------------------------------------------------------------


def q_wire_roundtrip(spark, sf_dir):
    """S4 then S3: events -> (key, JSON value) -> typed events again."""
    ev = _events(spark, sf_dir).select("event_id", "user_id", "session_id", "event_time",
                                       "transaction_amount", "location", "device_type", "event_type")
    wire = to_wire(ev)
    back = parse_events(wire)
    return back.select(F.col("event_id"), "user_id", F.col("event_time").alias("event_time"),
                       "transaction_amount", "location", "device_type", "event_type")


def q_wire_keys(spark, sf_dir):
    """Message keys (user id) per partition key, counted."""
    ev = _events(spark, sf_dir).select("event_id", "user_id", "event_time", "transaction_amount")
    return to_wire(ev).groupBy("key").agg(F.count(F.lit(1)).alias("messages"))


def q_alerts_idempotent(spark, sf_dir):
    """Alerts of the first half inserted, then every alert inserted again;
    each alert id lands once."""
    al = alerts_frame(spark, sf_dir).select("alert_id", "rule_name", "event_id", "severity", "triggered_at")
    first = al.filter(F.col("triggered_at") < F.lit(MIDPOINT).cast("timestamp_ntz"))
    return ST.idempotent_insert(first, al, key="alert_id", arrival_cols=["triggered_at"])


def q_processed_events_table(spark, sf_dir):
    """The processed-events table's fixed 14-column projection."""
    enr = enriched_events(spark, sf_dir, window_minutes=60)
    return ST.with_write_defaults(enr)


QUERIES.update({
    "wire_roundtrip": q_wire_roundtrip,
    "wire_keys": q_wire_keys,
    "alerts_idempotent": q_alerts_idempotent,
    "processed_events_table": q_processed_events_table,
})


# ---------------------------------------------------------------------------
# Skew: one user holding ~40% of all events (derived from the events table)
# ---------------------------------------------------------------------------

HOT_USER = "hot"
HOT_TYPES = ["click", "view"]


def hot_user_events(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return ev.withColumn("user_id", F.when(F.col("event_type").isin(HOT_TYPES), F.lit(HOT_USER))
                         .otherwise(F.col("user_id")))


def q_rolling_hot_user(spark, sf_dir):
    ev = hot_user_events(spark, sf_dir).select("event_id", "user_id", "event_time", "transaction_amount",
                                               "event_type", "location")
    out = rolling_user_features(ev, window_minutes=60, failed_type=FAILED_TYPE)
    return out.select("event_id", "user_id", "event_time", "txn_count_1h", "avg_amount_1h",
                      "max_amount_1h", "failed_attempts_1h", "unique_locations_1h")


def dense_user_events(spark, sf_dir):
    """One user holds every event, an event a millisecond or less apart: the
    whole table lies inside two windows."""
    ev = _events(spark, sf_dir)
    start = 1_704_067_200_000_000
    squeezed = F.expr(f"{start} + (unix_micros(CAST(event_time AS timestamp)) - {start}) div 360")
    return ev.withColumns({"user_id": F.lit("dense"), "event_time": F.timestamp_micros(squeezed).cast("timestamp_ntz")})


def q_rolling_dense_user(spark, sf_dir):
    ev = dense_user_events(spark, sf_dir).select("event_id", "user_id", "event_time", "transaction_amount",
                                                 "event_type", "location")
    out = rolling_user_features(ev, window_minutes=60, failed_type=FAILED_TYPE)
    return out.select("event_id", "user_id", "event_time", "txn_count_1h", "avg_amount_1h",
                      "max_amount_1h", "failed_attempts_1h", "unique_locations_1h")


QUERIES.update({"rolling_hot_user": q_rolling_hot_user, "rolling_dense_user": q_rolling_dense_user})


# ---------------------------------------------------------------------------
# Streaming pipeline (L2): rolling state -> rules, per micro-batch
# ---------------------------------------------------------------------------


def q_stream_alerts(spark, sf_dir):
    """The streaming job's alert table: the same alerts as the batch job."""
    pin_utc(spark)
    out = scratch_path(spark, "stream-pipeline")
    STREAM_STATS["stream_alerts"] = run_stream_pipeline(
        spark, _event_stream(spark, sf_dir), out, scratch_path(spark, "ckpt-pipeline"),
        rules=AL.default_rules(**RULE_PARAMS), window_minutes=RULE_WINDOW_MINUTES, failed_type=FAILED_TYPE,
        validate_kw=VALIDATE)
    return spark.read.parquet(f"{out}/alerts").drop("batch_id", "resolved")


def q_stream_insights(spark, sf_dir):
    """The streaming job's insights: a window closes every 100 events over all
    micro-batches; equal to the batch insights.  The given scores stand."""
    pin_utc(spark)
    out = scratch_path(spark, "stream-insights")
    STREAM_STATS["stream_insights"] = run_stream_pipeline(
        spark, _event_stream(spark, sf_dir), out, scratch_path(spark, "ckpt-insights"),
        rules=AL.default_rules(**RULE_PARAMS), window_minutes=RULE_WINDOW_MINUTES, failed_type=FAILED_TYPE,
        validate_kw=VALIDATE, insight_every=INSIGHT_EVERY)
    return _flat_insights(stream_insights(spark, out))


QUERIES.update({"stream_alerts": q_stream_alerts, "stream_insights": q_stream_insights})


def q_stream_from_json(spark, sf_dir):
    """S4 -> S1 -> S3 -> A7: events serialised to the JSON wire format, read
    back by the text-stream twin of the Kafka source, summarised per minute.
    The wire carries no fraud flag, so fraud counts are 0."""
    pin_utc(spark)
    wire_cols = ["event_id", "user_id", "session_id", "event_time", "transaction_amount", "location",
                 "device_type", "event_type", "currency"]
    staged = scratch_path(spark, "stream-json")
    SJ.stage_time_slices(_events(spark, sf_dir), staged, STREAM_SLICES, "event_time",
                         to_text=lambda d: to_wire(d.select(*wire_cols)).select("value"), files=SLICE_FILES)
    stream = SJ.with_event_timestamp(json_file_stream(spark, staged, max_files_per_trigger=SLICE_FILES))
    agg = SJ.tumbling_summary_stream(stream, "1 minute", "10 minutes")
    sink, ckpt = scratch_path(spark, "stream-json-out"), scratch_path(spark, "ckpt-json")
    STREAM_STATS["stream_from_json"] = SJ.run_available(agg, sink, ckpt, "update")
    out = SJ.read_latest(spark, sink, ["window_start"])
    return out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"),
                            "window_end": F.col("window_end").cast("timestamp_ntz")})


QUERIES.update({"stream_from_json": q_stream_from_json})


def q_stream_counters(spark, sf_dir):
    """S19 on a stream: per-user event counters, update mode, newest value
    per key read back from the idempotent sink."""
    pin_utc(spark)
    counts = SJ.counters_stream(_event_stream(spark, sf_dir), "user_id")
    sink, ckpt = scratch_path(spark, "stream-counters"), scratch_path(spark, "ckpt-counters")
    STREAM_STATS["stream_counters"] = SJ.run_available(counts, sink, ckpt, "update")
    return SJ.read_latest(spark, sink, ["user_id"])


QUERIES.update({"stream_counters": q_stream_counters})


# ---------------------------------------------------------------------------
# Small reads and rows that the driver table alone doesn't hold
# ---------------------------------------------------------------------------


def q_status_row(spark, sf_dir):
    """A13 over all events, and over none: a row of defaults."""
    ev = _events(spark, sf_dir)
    none = ev.filter(F.col("event_id").isNull())
    both = [("all", S.in_latest_windows(ev, "1 minute", 1)), ("none", none)]
    rows = [S.status_row(S.window_summary(d, "1 minute")).withColumn("scope", F.lit(name)) for name, d in both]
    return rows[0].unionByName(rows[1])


def flawed_events(spark, sf_dir):
    """The events with negative and unrounded amounts, missing users and
    currencies and unknown devices, by id."""
    n = F.col("event_id").cast("long")
    amount = F.col("transaction_amount")
    return _events(spark, sf_dir).withColumns({
        "transaction_amount": F.when(n % 7 == 0, -amount - 1).otherwise(amount / F.lit(3.0)),
        "user_id": F.when(n % 11 != 0, F.col("user_id")),
        "device_type": F.when(n % 13 == 0, F.lit("toaster")).otherwise(F.col("device_type")),
        "currency": F.when(n % 5 != 0, F.col("currency"))})


def q_validated_events(spark, sf_dir):
    """Reasons, 2-dp amounts and defaults of valid and rejected rows."""
    checked = validate_events(flawed_events(spark, sf_dir), **VALIDATE)
    return checked.select("event_id", "user_id", "transaction_amount", "currency",
                          F.array_join("reject_reasons", ",").alias("reasons"))


def flawed_wire(spark, sf_dir):
    """The events as wire text, by id: unreadable times, times left out,
    amounts in words, amounts sent as text, cut lines, negative amounts."""
    wire_cols = ["event_id", "user_id", "session_id", "event_time", "transaction_amount", "location",
                 "device_type", "event_type"]
    ev = _events(spark, sf_dir).select(*wire_cols)
    n = F.col("event_id").cast("long")
    text = to_wire(ev.withColumn("transaction_amount", F.when(n % 13 == 0, -F.col("transaction_amount") - 1)
                                 .otherwise(F.col("transaction_amount"))), key_col="event_id")
    n, value = F.col("key").cast("long"), F.col("value")
    when, amount = '"timestamp":"[^"]*"', '"transaction_amount":([-0-9.E]+)'
    return text.select(
        F.when(n % 17 == 0, F.regexp_replace(value, when, '"timestamp":"next tuesday"'))
         .when(n % 19 == 0, F.regexp_replace(value, when, '"timestamp":null'))
         .when(n % 23 == 0, F.regexp_replace(value, amount, '"transaction_amount":"a lot"'))
         .when(n % 29 == 0, F.regexp_replace(value, amount, '"transaction_amount":"$1"'))
         .when(n % 31 == 0, F.expr("left(value, length(value) - 9)"))
         .otherwise(value).alias("value"))


def _quarantined(bad):
    sent_id = F.regexp_extract("corrupt_record", '"event_id":"([^"]*)"', 1)
    return bad.select(F.when(F.col("corrupt_record").isNull(), F.col("event_id")).otherwise(sent_id).alias("event_id"),
                      F.array_join("reject_reasons", ",").alias("reasons"),
                      F.when(F.col("event_time") < F.localtimestamp() - F.expr("INTERVAL 30 DAYS"), F.col("event_time")).alias("event_time"),
                      F.col("corrupt_record").isNotNull().alias("has_text"))


def q_bad_records(spark, sf_dir):
    """Lines that can't be read in full go to quarantine, each bad
    field named; an absent time is no fault."""
    _, bad = split_valid(parse_events(flawed_wire(spark, sf_dir)), **VALIDATE)
    return _quarantined(bad)


def q_stream_bad_records(spark, sf_dir):
    """The streaming job's quarantine for the same lines, all in one batch (lines without a time move the watermark to now)."""
    pin_utc(spark)
    rows = _events(spark, sf_dir).count()
    staged, out = scratch_path(spark, "stream-flawed"), scratch_path(spark, "stream-flawed-out")
    flawed_wire(spark, sf_dir).write.text(staged)
    run_stream_pipeline(spark, SJ.with_event_timestamp(json_file_stream(spark, staged)), out,
                        scratch_path(spark, "ckpt-flawed"), rules=AL.default_rules(**RULE_PARAMS),
                        failed_type=FAILED_TYPE, validate_kw=VALIDATE, user_groups=SJ.user_groups_for(rows))
    bad = spark.read.parquet(f"{out}/quarantine")
    return _quarantined(bad.withColumn("event_time", F.col("event_time").cast("timestamp_ntz")))


def q_model_replies(spark, sf_dir):
    """Replies that parse (some after white space), and replies that don't."""
    ins, _ = _insights(spark, sf_dir)
    reply = F.concat(F.lit(' \n{"insight_text": "seen '), F.col("risk_level"), F.lit('", "key_findings": ["f"], "recommendations": ["r"], "risk_level": "high"}'))
    third = F.minute("window_start") % 3
    ins = ins.withColumn("model_response", F.when(third == 0, reply).when(third == 1, F.lit("Sorry, no JSON today.")))
    out = IN.apply_model_response(ins, "model_response", "external")
    return out.select("insight_id", "insight_text", F.array_join("key_findings", "\n").alias("key_findings"),
                      "risk_level", "model_used")


def q_insight_rows(spark, sf_dir):
    """Insights as stored, lists as JSON text, each id once."""
    ins, _ = _insights(spark, sf_dir)
    rows = ins.select("insight_id", F.to_json("key_findings").alias("key_findings"),
                      F.to_json("recommendations").alias("recommendations"), "risk_level")
    return ST.idempotent_insert(rows, rows, key="insight_id", arrival_cols=["risk_level"])


def q_ml_unseen(spark, sf_dir):
    """M2: a device that the encoders never saw becomes class 0."""
    ev = enriched_events(spark, sf_dir, window_minutes=60)
    f = ML.encode_features(ev.filter(F.col("device_type") != "api"), ev)
    return f.select("event_id", "device_type_enc")


QUERIES.update({
    "status_row": q_status_row,
    "validated_events": q_validated_events,
    "bad_records": q_bad_records,
    "stream_bad_records": q_stream_bad_records,
    "model_replies": q_model_replies,
    "insight_rows": q_insight_rows,
    "ml_unseen": q_ml_unseen,
})


# ---------------------------------------------------------------------------
# Scoring with a model that is written down
# ---------------------------------------------------------------------------

# 10 trees of depth 3 fitted on the training split of sf0.01 (equal weights).
FIXED_MODEL = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixed_model.json")


def q_scaled_vector(spark, sf_dir):
    """M6 + M7: the 16 scaled inputs, 9 dp."""
    rows = FM.scaled_features(_ml_frame(spark, sf_dir), FM.load_spec(FIXED_MODEL))
    return rows.select("event_id", *[round_to(F.col("features")[i], 9).alias(f"s{i:02d}")
                                     for i in range(len(ML.feature_columns()))])


def q_score_fixed_model(spark, sf_dir):
    """Every event; one weekday's amounts and another's devices are
    taken away (failure defaults, class 0)."""
    day = F.col("day_of_week")
    rows = _ml_frame(spark, sf_dir).withColumns({
        "transaction_amount": F.when(day != 2, F.col("transaction_amount")),
        "device_type": F.when(day != 4, F.col("device_type"))})
    return FM.score_fixed(rows, FM.load_spec(FIXED_MODEL), keep=["event_id", "user_id"])


def q_score_requests(spark, sf_dir):
    """Requests with a few fields, no location column at all."""
    req = _events(spark, sf_dir).select("event_id", "transaction_amount", "device_type", "event_type")
    return FM.score_fixed(with_inference_defaults(req), FM.load_spec(FIXED_MODEL), keep=["event_id"])


QUERIES.update({
    "scaled_vector": q_scaled_vector,
    "score_fixed_model": q_score_fixed_model,
    "score_requests": q_score_requests,
})
