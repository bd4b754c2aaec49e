"""The end-to-end batch job: events in, every output table maintained.

parse/validate -> dedupe -> calendar + rolling features -> score ->
{processed events, alerts, deliveries, payloads, window metrics, insights}.

Runs are incremental, idempotent and atomic:

* a run writes each table once, into ``<table>/run=k``, overwriting what an
  unfinished attempt left there, and its row in the commit log
  (``_commits/run=k``) last.  Readers (``committed``, ``latest_version``) take
  runs up to the last committed one, so a run that stops between two writes
  leaves nothing to see, and running it again replaces all of its files.  One
  job writes to an ``out_dir`` at a time;
* processed events (partitioned by event date below the run) receive only
  events whose (date, id) is new; the anti join prunes the table to the dates
  the run touches.  New events are enriched together with the stored events of
  the previous ``window`` (read with date partition pruning), so their rolling
  features are exactly those of a single run over all the data;
* every other table is derived from the run's stored events, read back, so all
  tables of a run agree even where a step (scores, default ids and times) would
  not repeat itself;
* quarantined rows and insights have deterministic ids and are kept once;
  alerts belong to new events only, so a replayed batch inserts nothing twice;
* count windows continue a running sequence (only the run's rows are
  sorted); window metrics recompute only the windows the run touches; the
  recent-events buffer merges the previous buffer with the new rows.  These
  derived tables are whole in each version and never rescan history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from vigil.functions.time import window_bounds
from vigil.operators import alerts as AL
from vigil.operators import insights as IN
from vigil.operators import ml as ML
from vigil.operators import summary as S
from vigil.operators.store import bounded_history, rows_to_insert, with_write_defaults
from vigil.operators.validation import dedupe_events, enrich_events, validate_events
from vigil.schemas import FAILED_LOGIN, METRICS_HISTORY_MAX, PARSE_COLUMNS, RECENT_EVENTS_MAX

COMMITS = "_commits"
COUNTERS = ["processed", "inserted", "quarantined", "alerts", "insights", "fraud_detected"]


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def last_commit(spark: SparkSession, out_dir: str) -> Row | None:
    """``run`` (the last committed one) and ``events`` (stored by all committed
    runs); None before the first commit."""
    log = read_if_exists(spark, f"{out_dir}/{COMMITS}")
    if log is None:
        return None
    last = log.agg(F.max("run").alias("run"), F.sum("inserted").alias("events")).first()
    return None if last.run is None else last


def runs_through(spark: SparkSession, out_dir: str, table: str, run: int | None) -> DataFrame | None:
    """The rows of ``table`` from all runs up to ``run``."""
    df = None if run is None else read_if_exists(spark, f"{out_dir}/{table}")
    return None if df is None else df.filter(F.col("run") <= run).drop("run")


def committed(spark: SparkSession, out_dir: str, table: str) -> DataFrame | None:
    """A table as its readers see it: the rows of all committed runs."""
    last = last_commit(spark, out_dir)
    return runs_through(spark, out_dir, table, None if last is None else last.run)


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The last committed version of a derived table (None if absent)."""
    out_dir = path.rstrip("/").rsplit("/", 1)[0]
    last = last_commit(spark, out_dir)
    return None if last is None else spark.read.parquet(f"{path}/run={last.run}")


class RunWriter:
    """Writes one run's tables.  ``after_write`` is called with each table's
    name once it is written (``_commits`` last)."""

    def __init__(self, spark: SparkSession, out_dir: str, run: int, after_write: Callable[[str], None] | None = None):
        self.spark, self.out_dir, self.run, self.after_write = spark, out_dir, run, after_write

    def path(self, table: str) -> str:
        return f"{self.out_dir}/{table}/run={self.run}"

    def write(self, df: DataFrame, table: str, partition_col: str | None = None) -> DataFrame:
        """Write the run's part of ``table`` and return it as stored."""
        # Static overwrite: an unfinished attempt's partitions go as a whole.
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(partition_col) if partition_col else writer).parquet(self.path(table))
        if self.after_write:
            self.after_write(table)
        # The schema is given, as a partitioned write of no rows has no file.
        return self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])) \
                         .parquet(self.path(table))


def count_windows_incremental(spark: SparkSession, new_rows: DataFrame, out: RunWriter, prev_total: int,
                              every: int) -> DataFrame:
    """A8 across runs: the sequence goes on from the commit log's total, the
    last rows of the run before are kept with it."""
    tail = spark.read.parquet(f"{out.out_dir}/_tail/run={out.run - 1}") if out.run else None
    tagged, tail, _ = S.continue_count_windows(new_rows, tail, prev_total, every)
    out.write(tail, "_tail")
    return S.count_window_metrics(None, every, tagged=tagged)


def run_pipeline(spark: SparkSession, events: DataFrame, out_dir: str, model: PipelineModel | None = None,
                 window_minutes: int = 60, metrics_every: str = "1 minute", insight_every: int = 100,
                 failed_type: str = FAILED_LOGIN, rules: list | None = None,
                 validate_kw: dict | None = None, after_write: Callable[[str], None] | None = None) -> DataFrame:
    """Run the job for one batch of events; returns the run counters."""
    last = last_commit(spark, out_dir)
    prev_run, prev_total = (None, 0) if last is None else (last.run, int(last.events or 0))
    out = RunWriter(spark, out_dir, 0 if prev_run is None else prev_run + 1, after_write)

    # Input and quarantine counts come from the quarantine write itself
    # (observe), not from extra jobs.  A rejected row's id is a hash of the row
    # as it came, before defaults, so a replay finds it stored.
    sent_id = F.sha2(F.to_json(F.struct(*[F.col(c) for c in events.columns]), {"ignoreNullFields": "false"}), 256)
    checked = validate_events(events.withColumn("quarantine_id", sent_id), **(validate_kw or {}))
    ok = F.size("reject_reasons") == 0
    v_obs = Observation("validated")
    rejected = (checked.observe(v_obs, F.count(F.lit(1)).alias("rows"), F.sum(ok.cast("long")).alias("valid"))
                       .filter(~ok))
    known = runs_through(spark, out_dir, "quarantine", prev_run)
    if known is not None:
        rejected = rejected.join(known.select("quarantine_id"), "quarantine_id", "left_anti")
    out.write(rejected, "quarantine")
    valid = validate_events(events, **(validate_kw or {})).filter(ok).drop("reject_reasons", *PARSE_COLUMNS)

    stored = runs_through(spark, out_dir, "processed_events", prev_run)
    batch = dedupe_events(valid).withColumn("event_date", F.to_date("event_time"))
    raw_cols = batch.columns
    if stored is None:
        fresh, context = batch, None
    else:
        # Events not stored yet; the anti join matches on the partition column
        # so only the batch's dates are read from the table.
        fresh = rows_to_insert(stored, batch, "event_id", ["event_time"], "event_date").select(*raw_cols)
        fresh = fresh.checkpoint()                      # reused below; cuts lineage reliably
        lo = fresh.agg(F.min("event_time")).first()[0]  # one scalar
        if lo is None:
            context = None
        else:
            since = F.lit(lo).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(window_minutes)} MINUTES")
            context = (stored.filter((F.col("event_date") >= F.to_date(since)) & (F.col("event_time") >= since))
                             .select(*raw_cols))
    to_enrich = fresh.withColumn("_new", F.lit(True))
    if context is not None:
        to_enrich = to_enrich.unionByName(context.withColumn("_new", F.lit(False)))

    enriched = enrich_events(to_enrich, window_minutes=window_minutes, failed_type=failed_type)
    enriched = enriched.filter(F.col("_new")).drop("_new")
    if model is not None:
        keep = [c for c in enriched.columns if c not in ("fraud_probability", "is_fraud", "confidence")]
        enriched = ML.score(model, enriched, keep=keep)

    # Range-partition on (date, user, id) before the partitioned write: each
    # task holds one or two dates (files ~ tasks + dates, not tasks x dates),
    # and a hot date (or a hot user within it) is split across tasks.
    # The stored rows, read back, feed everything below.
    enriched = out.write(enriched.checkpoint().repartitionByRange("event_date", "user_id", "event_id"),
                         "processed_events", partition_col="event_date")
    out.write(with_write_defaults(enriched), "processed_events_table")

    alerts = out.write(AL.evaluate_alerts(enriched, rules), "alerts")
    out.write(AL.alert_deliveries(alerts), "deliveries")
    out.write(AL.alert_payloads(alerts), "payloads")

    # Each version is made of the previous one and this run's rows only.
    recent_in = enriched
    if prev_run is not None:
        previous = spark.read.parquet(f"{out_dir}/recent_events/run={prev_run}")
        recent_in = enriched.unionByName(previous.drop("pos"), allowMissingColumns=True)
    out.write(bounded_history(recent_in, RECENT_EVENTS_MAX, ["event_time", "event_id"]), "recent_events")

    stats = enriched.agg(F.count(F.lit(1)).alias("n"), F.min("event_time").alias("lo"), F.max("event_time").alias("hi"),
                         F.coalesce(F.sum(F.col("is_fraud").cast("long")), F.lit(0)).alias("fraud")).first()
    touched = enriched
    if stats.n:
        bounds = [F.lit(b).cast("timestamp_ntz") for b in window_bounds(stats.lo, stats.hi, metrics_every)]
        day = F.col("event_date")
        touched = runs_through(spark, out_dir, "processed_events", out.run).filter(
            (day >= F.to_date(bounds[0])) & (day <= F.to_date(bounds[1]))
            & (F.col("event_time") >= bounds[0]) & (F.col("event_time") < bounds[1]))
    metrics = S.window_metrics(touched, metrics_every)
    if prev_run is not None:
        previous = spark.read.parquet(f"{out_dir}/metrics/run={prev_run}")
        metrics = previous.join(metrics.select("window_start"), "window_start", "left_anti").unionByName(metrics)
    metrics = out.write(metrics, "metrics")
    out.write(bounded_history(metrics, METRICS_HISTORY_MAX, ["window_start"]), "metrics_history")

    insights = IN.template_insights(count_windows_incremental(spark, enriched, out, prev_total, insight_every),
                                    "first_event_time", "last_event_time")
    known = runs_through(spark, out_dir, "insights", prev_run)
    if known is not None:
        insights = insights.join(known.select("insight_id"), "insight_id", "left_anti")
    insights = out.write(insights, "insights")

    seen = v_obs.get
    n_valid = int(seen.get("valid") or 0)
    counts = [n_valid, stats.n, int(seen.get("rows") or 0) - n_valid, alerts.count(), insights.count(), int(stats.fraud)]
    commit = spark.createDataFrame([tuple(counts)], ", ".join(f"{c} long" for c in COUNTERS)).coalesce(1)
    out.write(commit, COMMITS)
    return spark.createDataFrame(list(zip(COUNTERS, counts)), "counter string, value long")
