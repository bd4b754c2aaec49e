"""Calendar and rolling features (P4, W1–W7), incl. brute-force checks."""

from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import T0, event, frame
from vigil.functions.time import with_time_features
from pyspark.sql import functions as F
from vigil.operators.rolling import rolling_user_features
from vigil.sources.tables import load_events

FEATS = ["txn_count_1h", "avg_amount_1h", "max_amount_1h", "failed_attempts_1h", "unique_locations_1h"]


def feats(df, **kw):
    out = rolling_user_features(df, **kw)
    return {r["event_id"]: tuple(r[c] for c in FEATS) for r in out.collect()}


def test_five_events_one_hour(spark):
    rows = [event(i, amount=100.0 * (i + 1), t=T0 + timedelta(minutes=5 * i)) for i in range(5)]
    f = feats(frame(spark, rows))
    assert f["e0004"][:3] == (5, 300.0, 500.0)


def test_window_lower_bound_inclusive(spark):
    rows = [event(0, t=T0), event(1, t=T0 + timedelta(minutes=60)),
            event(2, t=T0 + timedelta(minutes=120, microseconds=1))]
    f = feats(frame(spark, rows))
    assert f["e0001"][0] == 2          # exactly 60 minutes old: kept
    assert f["e0002"][0] == 1          # 60 min + 1 us after e0001: e0001 dropped


def test_failed_and_locations_and_nulls(spark):
    rows = [event(0, etype="failed_login", location="A"), event(1, etype="failed_login", location=None),
            event(2, amount=None, location="B")]
    f = feats(frame(spark, rows))
    count, avg, mx, failed, locs = f["e0002"]
    assert (count, failed, locs) == (3, 2, 3)
    assert mx == 100.0 and avg == 66.67       # null amount counts as 0


def test_more_than_ten_locations(spark):
    rows = [event(i, location=f"L{i}") for i in range(12)]
    assert feats(frame(spark, rows))["e0011"][4] == 12


def test_time_features(spark):
    stamps = [datetime(2024, 1, 12, 5), datetime(2024, 1, 12, 6), datetime(2024, 1, 13, 21),
              datetime(2024, 1, 13, 22), datetime(2024, 1, 15, 0)]
    rows = [event(i, t=t) for i, t in enumerate(stamps)]
    out = {r["event_id"]: (r["hour_of_day"], r["day_of_week"], r["is_weekend"], r["is_night"])
           for r in with_time_features(frame(spark, rows)).collect()}
    assert out["e0000"] == (5, 4, 0, 1)      # Friday 05:00 is night
    assert out["e0001"] == (6, 4, 0, 0)
    assert out["e0002"] == (21, 5, 1, 0)     # Saturday
    assert out["e0003"] == (22, 5, 1, 1)
    assert out["e0004"] == (0, 0, 0, 1)      # Monday = 0


def brute(rows, window):
    out = {}
    for r in rows:
        eid, user, _, t = r[0], r[1], r[2], r[3]
        frame_rows = [x for x in rows if x[1] == user and t - window <= x[3] <= t]
        amts = [x[4] if x[4] is not None else 0.0 for x in frame_rows]
        cents = sum(round(a * 100) for a in amts)
        q = cents / len(frame_rows)
        avg = (int(q) + (1 if q - int(q) >= 0.5 else 0)) / 100.0
        out[eid] = (len(frame_rows), avg, max(amts),
                    sum(1 for x in frame_rows if x[7] == "failed_login"),
                    len({x[5] if x[5] is not None else "" for x in frame_rows}))
    return out


event_st = st.tuples(st.integers(0, 3), st.integers(0, 240), st.integers(0, 100000),
                     st.sampled_from(["purchase", "failed_login"]), st.sampled_from(["A", "B", "C", None]))


@settings(max_examples=15, deadline=None)
@given(st.lists(event_st, min_size=1, max_size=40))
def test_rolling_matches_brute_force(spark, evs):
    rows = [event(i, user=f"u{u}", t=T0 + timedelta(minutes=m), amount=c / 100.0, etype=e, location=loc)
            for i, (u, m, c, e, loc) in enumerate(evs)]
    assert feats(frame(spark, rows)) == brute(rows, timedelta(minutes=60))


def test_dense_hot_user_matches_brute_force(spark):
    # One user holds most rows, many of them inside one window and at equal times.
    rows = [event(i, user="hot" if i % 4 else f"c{i}", t=T0 + timedelta(seconds=(37 * i) % 5000, hours=(i % 3)),
                  amount=float(i % 13), etype="failed_login" if i % 5 == 0 else "purchase",
                  location=f"L{i % 6}") for i in range(400)]
    assert feats(frame(spark, rows)) == brute(rows, timedelta(minutes=60))
    assert feats(frame(spark, rows), window_minutes=7) == brute(rows, timedelta(minutes=7))


def test_rows_with_nulls_and_clashing_columns(spark):
    rows = [event(0, user=None, amount=None, location=None, etype=None), event(1, user=None, etype=None),
            event(2, user="u", t=T0)]
    df = frame(spark, rows).selectExpr("*", "1 as n", "map('a', 1) as metadata")
    timeless = df.withColumn("event_time", F.when(F.col("event_id") != "e0002", F.col("event_time")))
    got = {r.event_id: r for r in rolling_user_features(timeless).collect()}
    assert [got[f"e000{k}"].txn_count_1h for k in range(3)] == [1, 2, 0]
    assert [got[f"e000{k}"].unique_locations_1h for k in range(3)] == [1, 2, 0]
    assert [got[f"e000{k}"].failed_attempts_1h for k in range(3)] == [0, 0, 0]
    assert got["e0002"].avg_amount_1h == 0.0 and got["e0001"].max_amount_1h == 100.0


def test_series_from_text_drops_bad(spark):
    from vigil.functions.time import series_from_text
    df = spark.createDataFrame([("2024-01-15T14:01:00", 2), ("garbage", 9), ("2024-01-15T14:00:00", 1)],
                               "window_start string, n int")
    got = [r.n for r in series_from_text(df, "window_start").collect()]
    assert got == [1, 2]


def test_ranges_split_a_dense_user_and_get_their_halo(spark):
    # Many small ranges: windows span several of them, and ranges begin and end inside a user.
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        rows = [event(i, user=("hot" if i % 6 else None) if i % 4 else f"c{i % 7}", t=T0 + timedelta(seconds=(37 * i) % 9000),
                      amount=float((7 * i) % 23), etype="failed_login" if i % 5 == 0 else "purchase",
                      location=f"L{(i * i) % 11}" if i % 9 else None) for i in range(500)]
        df = frame(spark, rows)
        from vigil.operators import rolling
        ranges = rolling._ranges_with_halo(df.select(F.col("user_id").alias("_u"), F.unix_micros(F.col("event_time").cast("timestamp")).alias("_t")),
                                           3600 * 10**6)
        sizes = [r["n"] for r in ranges.where("_own and _u = 'hot'").groupBy("_range").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 4 and sum(sizes) == sum(r[1] == "hot" for r in rows)
        assert feats(df) == brute(rows, timedelta(minutes=60))
        assert feats(df, window_minutes=5) == brute(rows, timedelta(minutes=5))
        plan = rolling_user_features(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 2
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_halo_grows_with_the_rows_not_with_the_ranges(spark, monkeypatch):
    from vigil.operators import rolling
    monkeypatch.setattr(rolling, "RANGE_ROWS", 25, raising=False)
    monkeypatch.setattr(rolling, "LEAST_ROWS", 25, raising=False)
    rows = [event(i, user="dense" if i % 20 else None, t=T0 + timedelta(seconds=(37 * i) % 6000), amount=float((7 * i) % 23),
                  etype="failed_login" if i % 5 == 0 else "purchase", location=f"L{(i * i) % 7}" if i % 9 else None) for i in range(600)]
    df = frame(spark, rows)
    base = df.select(F.col("user_id").alias("_u"), F.unix_micros(F.col("event_time").cast("timestamp")).alias("_t"))
    ranges = rolling._ranges_with_halo(base, 3600 * 10**6)
    own, halo = (ranges.where(c).groupBy("_range").agg(F.count("*").alias("n")).collect() for c in ("_own", "not _own"))
    assert len(own) >= 20 and max(r["n"] for r in own) <= 60      # ranges of bounded size, whatever the session's settings
    assert 0 < sum(r["n"] for r in halo) <= 600 + len(own)        # a row is copied about once, whole ranges come summed up
    assert feats(df) == brute(rows, timedelta(minutes=60))
    assert feats(df, window_minutes=9) == brute(rows, timedelta(minutes=9))
