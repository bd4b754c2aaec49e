"""Streaming specifics: late data beyond the watermark, counters, dedupe."""

from datetime import timedelta

from helpers import EVENT_SCHEMA, T0, event, frame
from vigil.session import scratch_path
from vigil.streaming import jobs as SJ


def _stream_of(spark, batches):
    src = scratch_path(spark, "late-src")
    for rows in batches:                      # one file per micro-batch, in order
        frame(spark, rows).coalesce(1).write.mode("append").parquet(src)
    return SJ.with_event_timestamp(
        spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))


def test_late_event_dropped_and_counted(spark):
    # Spark's contract: once the watermark has passed a window and its state
    # is evicted (end of the batch that advanced past it), later rows for it
    # are dropped and counted.
    on_time = [event(i, t=T0 + timedelta(minutes=i)) for i in range(30)]
    more = [event(i, t=T0 + timedelta(minutes=i)) for i in range(30, 36)]
    late = [event(100, t=T0 + timedelta(minutes=2)),          # 33 min behind the max: dropped
            event(101, t=T0 + timedelta(minutes=33))]         # within the watermark: kept
    stream = SJ.with_run_counters(_stream_of(spark, [on_time, more, late]))
    agg = SJ.tumbling_summary_stream(stream, "1 minute", "10 minutes")
    sink = scratch_path(spark, "late-sink")
    stats = SJ.run_available(agg, sink, scratch_path(spark, "late-ckpt"), "update")
    assert stats["input_rows"] == 38 and stats["dropped_by_watermark"] == 1
    assert stats["observed"]["processed"] == 38 and stats["batches"] == 3
    final = {r.window_start.minute: r.total_transactions
             for r in SJ.read_latest(spark, sink, ["window_start"]).collect()}
    assert final[2] == 1 and final[33] == 2                   # late one not added; on-time one added


def test_stream_dedupe_first_copy(spark):
    first = [event(i, t=T0 + timedelta(minutes=i), amount=1.0) for i in range(5)]
    replay = [event(i, t=T0 + timedelta(minutes=i), amount=2.0) for i in range(3, 8)]
    stream = _stream_of(spark, [first, replay])
    sink = scratch_path(spark, "dedupe-sink")
    SJ.run_available(SJ.dedupe_stream(stream), sink, scratch_path(spark, "dedupe-ckpt"), "append")
    got = {r.event_id: r.transaction_amount for r in spark.read.parquet(sink).collect()}
    assert got == {"e0000": 1.0, "e0001": 1.0, "e0002": 1.0, "e0003": 1.0, "e0004": 1.0,
                   "e0005": 2.0, "e0006": 2.0, "e0007": 2.0}


def test_rolling_state_across_batches(spark):
    b1 = [event(i, t=T0 + timedelta(minutes=20 * i), amount=10.0 * (i + 1)) for i in range(3)]
    b2 = [event(3, t=T0 + timedelta(minutes=70), amount=40.0),
          event(4, t=T0 + timedelta(minutes=200), amount=50.0)]
    feats = SJ.rolling_features_stream(_stream_of(spark, [b1, b2]), 60, "failed_login")
    sink = scratch_path(spark, "roll-sink")
    SJ.run_available(feats, sink, scratch_path(spark, "roll-ckpt"), "append")
    got = {r.event_id: (r.txn_count_1h, r.avg_amount_1h, r.max_amount_1h)
           for r in spark.read.parquet(sink).collect()}
    assert got["e0003"] == (3, 30.0, 40.0)      # e0001 (20m), e0002 (40m) from state + itself
    assert got["e0004"] == (1, 50.0, 50.0)


def test_stateful_stream_runs_without_package_on_workers():
    """Python workers must not need `vigil` importable (they start outside
    the repo on a cluster); the processor ships by value."""
    import os
    import subprocess
    import sys
    import tempfile
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['stream_rolling'](s, '/root/testdata/sf0.001').count())\n" % repo)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=tempfile.gettempdir(), env=env,
                       capture_output=True, text=True, timeout=600)
    assert "ROWS 1000" in r.stdout, r.stderr[-2000:]


def test_console_sink_runs(spark, capsys):
    stream = _stream_of(spark, [[event(i, t=T0 + timedelta(minutes=i)) for i in range(3)]])
    q = SJ.console_sink(SJ.counters_stream(stream, "user_id"), trigger="1 second")
    try:
        q.processAllAvailable()
        assert q.isActive and q.lastProgress["numInputRows"] == 3
    finally:
        q.stop()


def _stream_features(spark, batches, window=60, **kw):
    feats = SJ.rolling_features_stream(_stream_of(spark, batches), window, "failed_login", **kw)
    sink = scratch_path(spark, "feat")
    SJ.run_available(feats, sink, scratch_path(spark, "feat-ck"), "append")
    return {r.event_id: (r.txn_count_1h, r.avg_amount_1h, r.max_amount_1h, r.failed_attempts_1h,
                         r.unique_locations_1h) for r in spark.read.parquet(sink).collect()}


def _batch_features(spark, rows, window=60):
    from vigil.operators.rolling import rolling_user_features
    return {r.event_id: (r.txn_count_1h, r.avg_amount_1h, r.max_amount_1h, r.failed_attempts_1h, r.unique_locations_1h)
            for r in rolling_user_features(frame(spark, rows), window, failed_type="failed_login").collect()}


def _mixed(n, seconds, hot_share=10):
    """Events of one hot user and, one in ``hot_share``, of others."""
    return [event(i, user="hot" if i % hot_share else f"u{i % 3}", t=T0 + timedelta(seconds=seconds * i),
                  amount=float(i * 7 % 17) + 0.25, location=f"L{i * i % 11}",
                  etype="failed_login" if i % 6 == 0 else "purchase") for i in range(n)]


def test_stream_features_match_batch_for_hot_user(spark):
    """One user holds 90 % of every batch; frames end in stored slices, in new ones and span whole ones."""
    rows = _mixed(1200, 19)                                      # 6 h in event order, 4 micro-batches
    batches = [rows[k:k + 300] for k in range(0, 1200, 300)]
    expect = _batch_features(spark, rows)
    assert _stream_features(spark, batches) == expect
    assert _stream_features(spark, batches, slices=60) == expect


def test_stream_features_with_gaps_and_equal_times(spark):
    rows = [event(i, user="u", t=T0 + timedelta(minutes=m), amount=float(i), location=f"L{i % 3}")
            for i, m in enumerate([0, 0, 10, 10, 59, 60, 60, 61, 70, 119, 120, 300, 301, 361, 362])]
    assert _stream_features(spark, [rows[:4], rows[4:7], rows[7:11], rows[11:]]) == _batch_features(spark, rows)


def test_range_answers_by_brute_force():
    import numpy as np
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 200):
        t = np.sort(rng.integers(0, n, n))
        v, code = rng.random(n), rng.integers(0, 5, n)
        w = int(rng.integers(0, n + 1))
        lo, hi = np.searchsorted(t, t - w, "left"), np.searchsorted(t, t, "right")
        assert SJ.range_max(v, lo, hi).tolist() == [v[x:y].max() for x, y in zip(lo, hi)]
        assert SJ.range_distinct(t, code, t - w, t + 1).tolist() == [len(set(code[x:y])) for x, y in zip(lo, hi)]


def test_late_event_within_watermark_sees_its_frame(spark):
    b1 = [event(i, t=T0 + timedelta(minutes=10 * i), amount=10.0) for i in range(10)]     # 0..90 min
    late = [event(50, t=T0 + timedelta(minutes=85), amount=40.0)]                         # 5 min behind
    got = _stream_features(spark, [b1, late])
    # frame [25, 85] min: events at 30..80 (6 of them) plus itself
    assert got["e0050"][:3] == (7, round((6 * 1000 + 4000) / 7) / 100.0, 40.0)


def test_tumbling_stream_approx_distinct_users(spark):
    rows = [event(i, user=f"u{i % 7}", t=T0 + timedelta(seconds=5 * i)) for i in range(24)]  # 2 minutes
    out = {}
    for mode in ("exact", "approx"):
        agg = SJ.tumbling_summary_stream(_stream_of(spark, [rows]), "1 minute", "10 minutes", distinct_users=mode)
        sink = scratch_path(spark, f"hll-{mode}")
        SJ.run_available(agg, sink, scratch_path(spark, f"hll-ck-{mode}"), "update")
        out[mode] = {r.window_start.minute: r.unique_users
                     for r in SJ.read_latest(spark, sink, ["window_start"]).collect()}
    assert out["exact"] == {0: 7, 1: 7}
    assert out["approx"] == out["exact"]        # HLL is exact at this cardinality


def test_tumbling_stream_appends_each_window_once_without_sets(spark):
    rows = [event(i, user=None if i % 9 == 8 else f"u{i % 7}", t=T0 + timedelta(seconds=5 * i), amount=None if i == 3 else float(i))
            for i in range(48)]                                                    # 4 minutes
    late = [event(100, user="u99", t=T0 + timedelta(seconds=30))]                  # its window is closed by then
    close = [event(200, t=T0 + timedelta(hours=1))]
    more = [event(201, t=T0 + timedelta(minutes=61))]                              # the batch after which windows are closed to late rows
    agg = SJ.tumbling_summary_append(_stream_of(spark, [rows[:20], rows[20:], close, more, late]), "1 minute", "10 minutes")
    assert "collect_set" not in agg._jdf.queryExecution().logical().toString()
    sink = scratch_path(spark, "append-sink")
    stats = SJ.run_available(agg, sink, scratch_path(spark, "append-ckpt"), "append")
    got = {r.window_start.minute: r for r in spark.read.parquet(sink).collect()}
    assert stats["dropped_by_watermark"] == 1 and sorted(got) == [0, 1, 2, 3]
    for m, r in got.items():
        own = rows[12 * m:12 * m + 12]
        amounts = [x[4] or 0.0 for x in own]
        assert (r.total_transactions, r.unique_users) == (12, len({x[1] for x in own} - {None}))
        assert (r.total_amount, r.max_amount, r.min_amount) == (sum(amounts), max(amounts), min(amounts))


def test_stream_pipeline_quarantines_and_dedupes(spark):
    """Malformed lines and invalid rows go to quarantine, copies count once."""
    from vigil.operators.alerts import default_rules
    from vigil.plans.stream_pipeline import run_stream_pipeline
    from vigil.sources.json_events import json_file_stream, to_wire
    cols = ["event_id", "user_id", "session_id", "event_time", "transaction_amount", "location", "device_type", "event_type"]
    rows = [event(i, t=T0 + timedelta(minutes=i), amount=100.0 * (i + 1)) for i in range(6)]
    bad = [event(50, amount=-5.0), event(51, device="toaster"), event(52, etype=None)]
    src = scratch_path(spark, "wire-src")
    lines = to_wire(frame(spark, rows + rows + bad).select(*cols)).select("value")
    lines.union(spark.createDataFrame([("not json",)], "value string")).coalesce(1).write.text(src)
    out, ckpt = scratch_path(spark, "wire-out"), scratch_path(spark, "wire-ckpt")
    stats = run_stream_pipeline(spark, SJ.with_event_timestamp(json_file_stream(spark, src)), out, ckpt, rules=default_rules())
    done = {r.event_id: r for r in spark.read.parquet(f"{out}/processed").collect()}
    assert sorted(done) == [f"e{i:04d}" for i in range(6)]
    assert [done[f"e{i:04d}"].txn_count_1h for i in range(6)] == [1, 2, 3, 4, 5, 6]
    assert {"session_id", "metadata", "currency"} <= set(spark.read.parquet(f"{out}/processed").columns)
    reasons = sorted(",".join(r.reject_reasons) for r in spark.read.parquet(f"{out}/quarantine").collect())
    assert reasons == sorted(["negative_amount", "unknown_device_type", "missing_event_type", "malformed_json"])
    assert stats["input_rows"] == 16 and stats["quarantine_batches"] == 1


def test_totals_of_more_than_a_hundred_batches(spark):
    src = scratch_path(spark, "many-src")
    frame(spark, [event(i, t=T0 + timedelta(minutes=i)) for i in range(115)]).repartition(115, "event_id") \
        .write.option("maxRecordsPerFile", 1).parquet(src)
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    stats = SJ.run_available(SJ.with_run_counters(stream), scratch_path(spark, "many-sink"),
                             scratch_path(spark, "many-ckpt"), "append")
    assert stats["batches"] == 115 and stats["input_rows"] == 115 and stats["observed"]["processed"] == 115


def test_stream_insights_over_batches_and_retries(spark):
    """Windows of 10 over micro-batches of other sizes equal the batch job's; a batch written twice changes nothing."""
    from vigil.operators import insights as IN
    from vigil.operators import summary as S
    from vigil.plans.stream_pipeline import stream_insights, write_insights
    rows = [event(i, user=f"u{i % 4}", t=T0 + timedelta(minutes=i), amount=float(i), score=0.9 if i % 7 == 0 else 0.1)
            for i in range(57)]
    expect = IN.template_insights(S.count_window_metrics(frame(spark, rows), 10), "first_event_time", "last_event_time").collect()
    out = scratch_path(spark, "ins-out")
    cuts = [0, 3, 3, 20, 41, 57]                                  # the second batch is empty
    for b, (x, y) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2 if b in (1, 3) else 1):
            write_insights(frame(spark, rows[x:y]), b, out, 10)
        so_far = {r.insight_id for r in stream_insights(spark, out).collect()}
        assert len(so_far) == y // 10 + (y % 10 > 0)
    got = stream_insights(spark, out).collect()
    assert sorted(map(str, got)) == sorted(map(str, expect))


def test_stream_state_has_one_partition_a_slot(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    slots = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * slots))
    try:
        stream = _stream_of(spark, [[event(i, user=f"u{i % 5}") for i in range(20)]])
        SJ.run_available(SJ.counters_stream(stream, "user_id"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(3 * slots)     # the session's own stays
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(p.name for p in (tmp_path / "ckpt/state/0").iterdir() if p.name.isdigit()) == sorted(map(str, range(slots)))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "value").collect()) == \
        [(f"u{i}", 4) for i in range(5)]


def test_stream_insights_bring_a_window_together_once(spark, monkeypatch):
    from vigil.plans import stream_pipeline as SP

    plans, metrics = [], SP.S.count_window_metrics

    def seen(*args, **kw):
        found = metrics(*args, **kw)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found
    monkeypatch.setattr(SP.S, "count_window_metrics", seen)
    spark.conf.set("spark.sql.adaptive.enabled", "false")                           # as in a stream's batch
    try:
        rows = [event(i, user=f"u{i % 3}") for i in range(25)]
        out = scratch_path(spark, "insights-plan")
        SP.write_insights(frame(spark, rows), 0, out, 10)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(plans) == 1 and "ENSURE_REQUIREMENTS" not in plans[0]
    assert SP.stream_insights(spark, out).count() == 3


def test_bad_records_spread_a_large_batch_over_more_state_keys(spark, monkeypatch):
    from vigil.plans import queries as Q
    assert [SJ.user_groups_for(n) for n in (0, 640_000, 36_000_000)] == [64, 64, 3600]
    seen = []
    run = Q.run_stream_pipeline

    def watched(*args, **kw):
        seen.append(kw["user_groups"])
        return run(*args, **kw)
    monkeypatch.setattr(Q, "run_stream_pipeline", watched)
    monkeypatch.setattr(SJ, "ROWS_PER_GROUP", 10)
    from conftest import SF_SMALL
    rows = {tuple(r)[:2] for r in Q.q_stream_bad_records(spark, SF_SMALL).collect()}
    assert seen == [100] and rows == {tuple(r)[:2] for r in Q.q_bad_records(spark, SF_SMALL).collect()}


def test_features_do_not_depend_on_the_number_of_state_keys(spark):
    rows = [event(i, user=f"u{i % 7}", t=T0 + timedelta(minutes=3 * i), amount=1.0 + i) for i in range(60)]
    got = []
    for groups in (1, 64, 3600):
        sink = scratch_path(spark, "groups-sink")
        SJ.run_available(SJ.rolling_features_stream(_stream_of(spark, [rows]), 60, "failed_login", user_groups=groups),
                         sink, scratch_path(spark, "groups-ckpt"), "append")
        got.append(sorted(map(tuple, spark.read.parquet(sink).drop("batch_id").collect())))
    assert len(got[0]) == 60 and got[0] == got[1] == got[2]
