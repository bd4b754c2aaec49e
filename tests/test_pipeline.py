"""End-to-end batch job on the sf0.001 events (the reference's smoke test,
at table scale)."""

import os

import pytest
from pyspark.sql import functions as F

from vigil.operators import ml as ML
from vigil.operators.alerts import default_rules
from vigil.plans.pipeline import committed, latest_version, run_pipeline
from vigil.plans.queries import RULE_PARAMS
from vigil.session import scratch_path
from vigil.sources.tables import load_events

SF = "/root/testdata/sf0.001"
DRIVER_TYPES = ["click", "error", "purchase", "signup", "view"]


def test_pipeline_counters_and_tables(spark):
    out = scratch_path(spark, "pipeline-test")
    counters = {r.counter: r.value for r in run_pipeline(
        spark, load_events(spark, SF), out, failed_type="error", rules=default_rules(**RULE_PARAMS),
        validate_kw={"event_types": DRIVER_TYPES}).collect()}
    assert counters["processed"] == counters["inserted"] == 1000 and counters["quarantined"] == 0
    assert counters["insights"] == 10                      # every 100 events, no tail
    alerts = committed(spark, out, "alerts")
    assert counters["alerts"] == alerts.count() > 0
    assert counters["fraud_detected"] == load_events(spark, SF).filter("is_fraud").count()
    processed = committed(spark, out, "processed_events")
    assert processed.select("event_date").distinct().count() == 30
    assert processed.select("event_id").distinct().count() == 1000
    assert committed(spark, out, "quarantine").count() == 0
    assert len(committed(spark, out, "processed_events_table").columns) == 14
    recent = latest_version(spark, f"{out}/recent_events")
    assert recent.count() == 1000 and sorted(r.pos for r in recent.select("pos").collect()) == list(range(1000))
    assert latest_version(spark, f"{out}/metrics_history").count() == 500
    d = committed(spark, out, "deliveries")
    assert d.count() >= 2 * alerts.count()
    assert committed(spark, out, "insights").filter(F.col("risk_level").isNull()).count() == 0


def test_pipeline_with_model_scores(spark):
    ev = load_events(spark, SF)
    from vigil.plans.queries import enriched_events
    train = enriched_events(spark, SF, window_minutes=60).withColumn(
        "label", F.col("is_fraud").cast("int")).drop("fraud_probability", "is_fraud")
    model = ML.fit_model(train, params=ML.GBTParams(max_iter=5, max_depth=3))
    out = scratch_path(spark, "pipeline-model")
    counters = {r.counter: r.value for r in run_pipeline(
        spark, ev, out, model=model, failed_type="error",
        validate_kw={"event_types": DRIVER_TYPES}).collect()}
    processed = committed(spark, out, "processed_events")
    assert counters["inserted"] == 1000 and "confidence" in processed.columns
    bad = processed.filter((F.col("fraud_probability") < 0) | (F.col("fraud_probability") > 1)).count()
    assert bad == 0


def test_scale_conf_sizes_partitions():
    from vigil.session import scale_conf
    c = scale_conf(100 << 40, executors=1000, cores_per_executor=4)
    parts = int(c["spark.sql.shuffle.partitions"])
    assert parts % 4000 == 0 and 50 * (1 << 40) / parts <= 1 << 30 and parts <= 100_000
    assert int(scale_conf(1 << 30, 2, 4)["spark.sql.shuffle.partitions"]) == 8


def test_pipeline_rerun_is_idempotent_and_exact(spark):
    """Run 1: events before the 16th; run 2: every event (a replay plus the
    rest).  Stored events, their rolling features, alerts and insights equal
    one run over everything, with nothing duplicated."""
    ev = load_events(spark, SF)
    kw = dict(failed_type="error", rules=default_rules(**RULE_PARAMS), window_minutes=24 * 60,
              validate_kw={"event_types": DRIVER_TYPES})
    once, twice = scratch_path(spark, "pipe-once"), scratch_path(spark, "pipe-twice")
    run_pipeline(spark, ev, once, **kw).collect()
    first = {r.counter: r.value for r in run_pipeline(
        spark, ev.filter(F.col("event_time") < F.lit("2024-01-16").cast("timestamp_ntz")), twice, **kw).collect()}
    second = {r.counter: r.value for r in run_pipeline(spark, ev, twice, **kw).collect()}
    assert first["inserted"] + second["inserted"] == 1000 and second["processed"] == 1000
    feats = ["event_id", "txn_count_1h", "avg_amount_1h", "max_amount_1h", "failed_attempts_1h",
             "unique_locations_1h"]
    a = committed(spark, once, "processed_events").select(*feats)
    b = committed(spark, twice, "processed_events").select(*feats)
    assert b.count() == 1000 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    for table, key in [("alerts", "alert_id"), ("insights", "insight_id"), ("deliveries", "alert_id")]:
        x = committed(spark, once, table).select(key)
        y = committed(spark, twice, table).select(key)
        if table != "insights":
            assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0, table
        assert y.count() == y.distinct().count() or table == "deliveries"
    # Count windows continue across runs: every single-run insight appears,
    # plus at most run 1's own tail window.
    i1 = {r.insight_id for r in committed(spark, once, "insights").collect()}
    i2 = {r.insight_id for r in committed(spark, twice, "insights").collect()}
    assert i1 <= i2 and len(i2 - i1) <= 1
    # Window metrics and the recent buffer, updated incrementally, equal the
    # single run's.
    for table in ("metrics", "recent_events"):
        m1 = latest_version(spark, f"{once}/{table}").drop("pos")
        m2 = latest_version(spark, f"{twice}/{table}").drop("pos")
        cols = [c for c in m1.columns if c != "processed_at" and not c.endswith("breakdown")]
        assert m1.select(*cols).exceptAll(m2.select(*cols)).count() == 0, table
        assert m2.count() == m1.count(), table
    # A third run of the same batch inserts nothing.
    third = {r.counter: r.value for r in run_pipeline(spark, ev, twice, **kw).collect()}
    assert third["inserted"] == 0 and third["alerts"] == 0


TABLES = ["quarantine", "processed_events", "processed_events_table", "alerts", "deliveries", "payloads",
          "recent_events", "metrics", "metrics_history", "_tail", "insights"]
VERSIONED = {"recent_events", "metrics", "metrics_history"}


class Stopped(Exception):
    pass


def contents(spark, out):
    """Every table as readers see it, rows in a fixed order, the wall clock left out."""
    seen = {}
    for table in TABLES:
        df = latest_version(spark, f"{out}/{table}") if table in VERSIONED else committed(spark, out, table)
        cols = sorted(c for c in df.columns if c not in ("processed_at", "created_at"))
        seen[table] = sorted(repr([str(v) for v in r]) for r in df.select(*cols).collect())
    return seen


def test_a_run_stopped_after_any_write_leaves_no_trace(spark):
    """Run 2 is stopped after each of its writes and run again: readers see run 1 until the commit, and
    all tables then equal those of two undisturbed runs.  A replay of the whole adds nothing."""
    ev = load_events(spark, SF).filter(F.col("event_time") < F.lit("2024-01-12").cast("timestamp_ntz"))
    flawed = ev.withColumn("device_type", F.when(F.col("event_id").cast("long") % 50 == 0, F.lit("toaster"))
                           .otherwise(F.col("device_type")))
    first = flawed.filter(F.col("event_time") < F.lit("2024-01-06").cast("timestamp_ntz"))
    kw = dict(failed_type="error", rules=default_rules(**RULE_PARAMS), window_minutes=24 * 60,
              validate_kw={"event_types": DRIVER_TYPES})
    calm, rough = scratch_path(spark, "pipe-calm"), scratch_path(spark, "pipe-rough")
    for out in (calm, rough):
        run_pipeline(spark, first, out, **kw)
    before = contents(spark, rough)
    counters = run_pipeline(spark, flawed, calm, **kw).collect()
    for stop in TABLES:
        def halt(table):
            if table == stop:
                raise Stopped(table)
        with pytest.raises(Stopped):
            run_pipeline(spark, flawed, rough, after_write=halt, **kw)
    assert contents(spark, rough) == before
    assert run_pipeline(spark, flawed, rough, **kw).collect() == counters
    after = contents(spark, rough)
    expected = contents(spark, calm)
    for table in TABLES:
        assert after[table] == expected[table], table
    assert len(after["quarantine"]) == flawed.filter("device_type = 'toaster'").count() > 0
    run_pipeline(spark, flawed, rough, **kw)
    replayed = contents(spark, rough)
    assert all(replayed[t] == after[t] for t in TABLES if t not in ("_tail", "insights"))


def test_a_run_without_events(spark):
    """No events, before and after others: tables exist, empty or as they were."""
    ev = load_events(spark, SF)
    none, out = ev.filter("false"), scratch_path(spark, "pipe-empty")
    kw = dict(failed_type="error", validate_kw={"event_types": DRIVER_TYPES})
    assert {r.value for r in run_pipeline(spark, none, out, **kw).collect()} == {0}
    assert latest_version(spark, f"{out}/metrics").count() == 0
    counters = {r.counter: r.value for r in run_pipeline(spark, ev, out, **kw).collect()}
    assert counters["inserted"] == 1000 and counters["insights"] == 10
    run_pipeline(spark, none, out, **kw)
    assert committed(spark, out, "processed_events").count() == 1000
    assert latest_version(spark, f"{out}/recent_events").count() == 1000
