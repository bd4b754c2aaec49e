"""Window summaries, breakdowns, count windows, roll-ups."""

from datetime import timedelta

from pyspark.sql import functions as F

from helpers import T0, event, frame
from vigil.operators import summary as S


def test_summary_basics_and_null_amount(spark):
    rows = [event(0, t=T0, amount=100.0, score=0.9), event(1, t=T0 + timedelta(seconds=10), amount=None),
            event(2, user="u2", t=T0 + timedelta(seconds=20), amount=250.5)]
    r = S.window_summary(frame(spark, rows), "1 minute").collect()[0]
    assert r.total_transactions == 3 and r.total_amount == 350.5
    assert r.min_amount == 0.0 and r.max_amount == 250.5 and r.avg_amount == 116.83
    assert r.unique_users == 2 and r.fraud_count == 1 and r.fraud_rate == 0.3333


def test_summary_without_flag_column(spark):
    df = frame(spark, [event(0)]).drop("is_fraud")
    r = S.window_summary(df, "1 minute").collect()[0]
    assert r.fraud_count == 0 and r.fraud_rate == 0.0


def test_breakdown_ties_and_top10(spark):
    rows = []
    for i, loc in enumerate(["b", "a", "c", "c"] + [f"z{k:02d}" for k in range(10)]):
        rows.append(event(i, t=T0 + timedelta(seconds=i), location=loc,
                          etype="transfer" if i % 2 else "purchase"))
    long = S.breakdown_counts(frame(spark, rows), "1 hour").filter(F.col("dimension") == "location")
    got = [(r.value, r.cnt) for r in long.orderBy("rnk").collect()]
    assert len(got) == 10
    assert got[:3] == [("c", 2), ("a", 1), ("b", 1)]      # count desc, then name asc
    wm = S.window_metrics(frame(spark, rows), "1 hour")
    maps = wm.collect()[0]
    keys = wm.select(F.map_keys("location_breakdown").alias("k")).collect()[0].k   # Spark-side order
    assert keys[:3] == ["c", "a", "b"]
    assert maps.event_type_breakdown == {"purchase": 7, "transfer": 7}


def test_count_windows_with_tail(spark):
    rows = [event(i, t=T0 + timedelta(seconds=i), amount=float(i)) for i in range(250)]
    out = {(r.window_index, r.is_tail): r for r in S.count_windows(frame(spark, rows), every=100).collect()}
    assert sorted(out) == [(0, False), (1, False), (2, True)]
    assert out[(2, True)].total_transactions == 100
    assert out[(2, True)].min_amount == 150.0 and out[(1, False)].max_amount == 199.0


def test_count_windows_exact_multiple(spark):
    rows = [event(i, t=T0 + timedelta(seconds=i)) for i in range(200)]
    out = S.count_windows(frame(spark, rows), every=100).collect()
    assert sorted((r.window_index, r.is_tail) for r in out) == [(0, False), (1, False)]


def test_global_index_is_dense(spark):
    rows = [event(i, t=T0 + timedelta(seconds=(i * 37) % 500)) for i in range(500)]
    ix = S.global_index(frame(spark, rows).repartition(7), ["event_time", "event_id"])
    got = sorted((r.event_time, r.event_id, r.idx) for r in ix.collect())
    assert [g[2] for g in got] == list(range(500))


def test_metrics_rollup_skips_zero_averages(spark):
    m = spark.createDataFrame(
        [(T0 + timedelta(minutes=i), a, r, n) for i, (a, r, n) in
         enumerate([(100.0, 0.1, 10), (0.0, 0.0, 0), (200.0, 0.2, 30)])],
        "window_start timestamp_ntz, avg_amount double, fraud_rate double, total_transactions long")
    r = S.metrics_rollup(m, n=60).collect()[0]
    assert (r.windows_analysed, r.avg_transaction_value, r.avg_fraud_rate) == (3, 150.0, 0.1)
    assert (r.peak_transactions, r.total_transactions) == (30, 40)
