"""Idempotent writes and latest / recent / history reads as tables.

The reference keeps these in an OLTP database, a key-value cache and a search
index; here each is a table plus a DataFrame read.  Reads that return "the
last N" are top-N plans (per-task partial top-N, then a merge), and per-key
"last N" uses a ranked filter that Spark limits per task before the shuffle,
so a hot key never sends all of its rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.time import iso_text
from vigil.schemas import METRICS_TTL_SECONDS

# The processed-events table's 14 written columns and their defaults.
PROCESSED_COLUMNS = {
    "event_id": "", "user_id": "", "session_id": "", "event_time": None, "event_type": "",
    "device_type": "", "location": "", "transaction_amount": 0.0, "fraud_probability": 0.0,
    "is_fraud": False, "hour_of_day": 0, "day_of_week": 0, "txn_count_1h": 0, "failed_attempts_1h": 0,
}


def with_write_defaults(df: DataFrame) -> DataFrame:
    """Fixed projection; missing columns and nulls take defaults
    (event time defaults to the processing time)."""
    cols = []
    for c, d in PROCESSED_COLUMNS.items():
        src = F.col(c) if c in df.columns else F.lit(None)
        default = F.localtimestamp() if d is None else F.lit(d)
        cols.append(F.coalesce(src, default).alias(c))
    return df.select(*cols)


def first_by_key(df: DataFrame, key: str | list[str], order_cols: list[str]) -> DataFrame:
    """One row per key: the first by ``order_cols`` (partial aggregate)."""
    keys = [key] if isinstance(key, str) else key
    cols = df.columns
    best = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order_cols]))
    return df.groupBy(*keys).agg(best.alias("_r")).select("_r.*")


def latest_by_key(df: DataFrame, key: str | list[str], order_cols: list[str]) -> DataFrame:
    """One row per key, the last by ``order_cols`` (last write wins).

    ``max_by`` aggregates partially on the map side, so a key with millions
    of versions is reduced before the shuffle.
    """
    keys = [key] if isinstance(key, str) else key
    cols = df.columns
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(c) for c in order_cols]))
    return df.groupBy(*keys).agg(best.alias("_r")).select("_r.*")


def rows_to_insert(target: DataFrame, incoming: DataFrame, key: str = "event_id",
                   arrival_cols: list[str] | None = None, partition_col: str | None = None) -> DataFrame:
    """The rows an ``ON CONFLICT DO NOTHING`` insert appends: first arrival per
    key, minus keys already in ``target``.  A sink appends exactly these, so
    the target is never rewritten."""
    arrival_cols = arrival_cols or [key]
    keys = [partition_col, key] if partition_col else [key]
    fresh = first_by_key(incoming, keys, arrival_cols)
    return fresh.join(target.select(*keys), on=keys, how="left_anti")


def idempotent_insert(target: DataFrame, incoming: DataFrame, key: str = "event_id",
                      arrival_cols: list[str] | None = None,
                      partition_col: str | None = None) -> DataFrame:
    """``INSERT … ON CONFLICT (key) DO NOTHING`` as a new table version.

    Incoming rows are first reduced to the first arrival per key, then rows
    whose key already exists in ``target`` are dropped (left anti join).  When
    the target is partitioned (e.g. by event date) and ``partition_col`` is
    given, the anti join also matches on it, so dynamic partition pruning
    reads only the target partitions the batch touches.
    """
    new_rows = rows_to_insert(target, incoming, key, arrival_cols, partition_col)
    return target.unionByName(new_rows.select(*target.columns))


def recent(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """Newest ``n`` rows by ``order_cols`` (descending)."""
    return df.orderBy(*[F.desc(c) for c in order_cols]).limit(n)


def recent_events(events: DataFrame, n: int = 100, order_cols: list[str] | None = None,
                  time_cols: list[str] | None = None) -> DataFrame:
    """S11 + S21: newest events with their timestamps rendered as ISO text."""
    order_cols = order_cols or ["processed_at"]
    top = recent(events, n, order_cols)
    time_cols = time_cols or [f.name for f in events.schema.fields
                              if f.dataType.typeName() in ("timestamp", "timestamp_ntz")]
    return top.withColumns({c: iso_text(F.col(c)) for c in time_cols})


def risky_events(events: DataFrame, min_score: float = 0.8, n: int = 20,
                 score_col: str = "fraud_probability", time_col: str = "event_time",
                 tie_col: str = "event_id") -> DataFrame:
    """Events with score >= ``min_score``, newest first, top ``n``
    (the filter reaches the scan as a pushed predicate)."""
    return recent(events.filter(F.col(score_col) >= F.lit(min_score)), n, [time_col, tie_col])


def latest_row(df: DataFrame, order_col: str = "window_start") -> DataFrame:
    """The single newest row (global partial aggregate)."""
    cols = df.columns
    return df.agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("_r")).select("_r.*")


def fresh_rows(df: DataFrame, as_of: Column, ttl_seconds: int | None = None,
               updated_col: str = "updated_at") -> DataFrame:
    """Rows whose value has not expired at ``as_of``.  A ttl of 0 or
    None means the default, like the reference's ``ttl or default``."""
    ttl = ttl_seconds or METRICS_TTL_SECONDS
    return df.filter(F.col(updated_col) > as_of - F.expr(f"INTERVAL {int(ttl)} SECONDS"))


def bounded_history(df: DataFrame, max_len: int, order_cols: list[str],
                    key: str | None = None) -> DataFrame:
    """Keep the newest ``max_len`` rows (per ``key`` when given), with
    ``pos`` = 0 for the oldest kept row.

    The ranked filter is planned as a per-task group limit before the shuffle,
    so each task ships at most ``max_len`` rows per key.
    """
    part = [key] if key else []
    if not key:
        df = recent(df, max_len, order_cols)  # global: top-N plan, then rank N rows
    w_desc = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order_cols])
    kept = df.withColumn("_rd", F.row_number().over(w_desc)).filter(F.col("_rd") <= max_len)
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    return kept.withColumn("pos", (n - F.col("_rd")).cast("long")).drop("_rd")


def list_range(history: DataFrame, start: int = 0, end: int = -1, key: str | None = None) -> DataFrame:
    """``LRANGE key start end`` over a bounded history (``pos`` from
    ``bounded_history``): inclusive bounds, negatives count from the end."""
    part = [key] if key else []
    h = history.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*part)))
    n = F.col("_n")
    lo = F.lit(start) if start >= 0 else n + F.lit(start)
    hi = F.lit(end) if end >= 0 else n + F.lit(end)
    return h.filter((F.col("pos") >= F.greatest(lo, F.lit(0))) & (F.col("pos") <= hi)).drop("_n")


def increment_counters(counters: DataFrame | None, deltas: DataFrame, key: str,
                       amount_col: str | None = None) -> DataFrame:
    """Counter table + increments -> new counter table."""
    inc = deltas.groupBy(key).agg(
        (F.sum(amount_col) if amount_col else F.count(F.lit(1))).cast("long").alias("value"))
    if counters is None:
        return inc
    return counters.select(key, "value").unionByName(inc).groupBy(key).agg(
        F.sum("value").cast("long").alias("value"))
