"""The streaming job: events in, processed events, alerts, deliveries, insights and an archive out, per batch.

source -> validation (rejected rows go to the quarantine sink with their
reasons) -> dedupe within the watermark -> W8 rolling features (keyed state)
-> foreachBatch: calendar features -> optional model score -> {processed
events with all raw columns, alerts, deliveries, JSON archive, insights}.

Insights close a window every ``insight_every`` events while the stream runs.
Events carry one sequence over all batches: a log holds the total after each
batch and a bounded buffer the last ``insight_every`` events, both written
under the batch id and read from the batch before, so a retried batch numbers
its events as it did at first.  Windows that a batch closes go to
``insights``; the window over the newest events, which the next batch
replaces, to ``insights_open``.  ``stream_insights`` reads both.

Each micro-batch is persisted once inside ``foreachBatch`` (it feeds all
writes) and written to ``batch_id=N`` folders, so a retried batch overwrites
its own output; readers union the folders.  The window summary (A7) is a
separate streaming query over the same source.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.time import with_time_features
from vigil.operators import alerts as AL
from vigil.operators import insights as IN
from vigil.operators import ml as ML
from vigil.operators import summary as S
from vigil.schemas import FAILED_LOGIN, PARSE_COLUMNS
from vigil.operators.validation import validate_events
from vigil.sources.json_events import archive_events
from vigil.streaming.jobs import USER_GROUPS, finished_progress, rolling_features_stream, run_available, run_totals, start_stream


SEQUENCE = "_sequence"


def write_insights(batch: DataFrame, batch_id: int, out_dir: str, every: int) -> None:
    """A8 + I1–I8 for one micro-batch; the sequence log's row comes last."""
    spark = batch.sparkSession
    path = lambda table, b=batch_id: f"{out_dir}/{table}/batch_id={b}"
    before, total = None, 0
    if batch_id:
        before = spark.read.parquet(path("_tail", batch_id - 1))
        total = spark.read.parquet(path(SEQUENCE, batch_id - 1)).first().total
    tagged, tail, total = S.continue_count_windows(batch, before, total, every)
    tail.write.mode("overwrite").parquet(path("_tail"))
    # A window is ``every`` rows: brought together once, its summary, breakdowns and their join need no other exchange.
    tagged = tagged.repartition("window_index", "is_tail").persist()
    metrics = S.count_window_metrics(None, every, tagged=tagged).persist()
    try:
        for table, rows in (("insights", ~F.col("is_tail")), ("insights_open", F.col("is_tail"))):
            (IN.template_insights(metrics.filter(rows), "first_event_time", "last_event_time")
               .write.mode("overwrite").parquet(path(table)))
    finally:
        metrics.unpersist()
        tagged.unpersist()
    spark.createDataFrame([(total,)], "total long").coalesce(1).write.mode("overwrite").parquet(path(SEQUENCE))


def stream_insights(spark: SparkSession, out_dir: str) -> DataFrame:
    """Insights as of the last finished batch: all closed windows, and the
    window over the newest events."""
    last = spark.read.parquet(f"{out_dir}/{SEQUENCE}").agg(F.max("batch_id")).first()[0]
    closed = spark.read.parquet(f"{out_dir}/insights").filter(F.col("batch_id") <= last).drop("batch_id")
    return closed.unionByName(spark.read.parquet(f"{out_dir}/insights_open/batch_id={last}"))


def run_stream_pipeline(spark: SparkSession, stream: DataFrame, out_dir: str, checkpoint: str,
                        rules: list | None = None, model: PipelineModel | None = None,
                        window_minutes: int = 60, failed_type: str = FAILED_LOGIN,
                        watermark: str = "10 minutes", validate_kw: dict | None = None,
                        insight_every: int | None = None, archive: bool = False, user_groups: int = USER_GROUPS) -> dict:
    """Run the stream until the available input is processed; returns run
    totals (batches, rows, watermark drops, quarantined rows).  Insights are
    made if ``insight_every`` is given, the archive if ``archive`` is set.
    ``user_groups``: see ``rolling_features_stream``."""
    checked = validate_events(stream, **(validate_kw or {})).withColumn("event_time", F.col("event_time").cast("timestamp"))
    ok = F.size("reject_reasons") == 0
    rejected = run_available(checked.filter(~ok), f"{out_dir}/quarantine", f"{checkpoint}/quarantine", "append")
    keep = [c for c in stream.columns if c not in ("event_id", "user_id", "event_time", *PARSE_COLUMNS)]
    feats = rolling_features_stream(checked.filter(ok).drop("reject_reasons", *PARSE_COLUMNS), window_minutes, failed_type, watermark,
                                    passthrough=keep, user_groups=user_groups)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        enriched = with_time_features(
            batch.withColumn("event_time", F.timestamp_micros("t_us").cast("timestamp_ntz")).drop("t_us"))
        if model is not None:
            enriched = ML.score(model, enriched.drop("fraud_probability", "is_fraud"),
                                keep=[c for c in enriched.columns if c not in ("fraud_probability", "is_fraud")])
        elif "fraud_probability" not in enriched.columns:   # nothing scored: the failure defaults (M17)
            enriched = enriched.withColumns({"fraud_probability": F.lit(0.0), "is_fraud": F.lit(False)})
        enriched = enriched.persist()
        try:
            enriched.write.mode("overwrite").parquet(f"{out_dir}/processed/batch_id={batch_id}")
            alerts = AL.evaluate_alerts(enriched, rules).persist()
            alerts.write.mode("overwrite").parquet(f"{out_dir}/alerts/batch_id={batch_id}")
            AL.alert_deliveries(alerts).write.mode("overwrite").parquet(f"{out_dir}/deliveries/batch_id={batch_id}")
            alerts.unpersist()
            if archive:
                archive_events(enriched, f"{out_dir}/archive/batch_id={batch_id}", mode="overwrite")
            if insight_every:
                write_insights(enriched, batch_id, out_dir, insight_every)
        finally:
            enriched.unpersist()

    w = (feats.writeStream.outputMode("append").option("checkpointLocation", f"{checkpoint}/events")
         .foreachBatch(per_batch).trigger(availableNow=True))
    totals = run_totals(finished_progress(start_stream(stream.sparkSession, w)))
    totals["quarantine_batches"] = rejected["batches"]
    return totals
