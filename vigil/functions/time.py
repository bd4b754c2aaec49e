"""Calendar features and epoch helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since the epoch for a TIMESTAMP_NTZ or TIMESTAMP column.

    ``timestampdiff`` is time-zone free on NTZ input, so results do not depend
    on the session zone.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), ts.cast("timestamp_ntz"))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def is_night(ts: Column) -> Column:
    """Night is hour < 6 or hour >= 22."""
    h = F.hour(ts)
    return ((h < 6) | (h >= 22)).cast("int")


def with_time_features(df: DataFrame, ts_col: str = "event_time") -> DataFrame:
    """hour_of_day, day_of_week, is_weekend, is_night (narrow, no shuffle)."""
    ts = F.col(ts_col)
    return df.withColumns({
        "hour_of_day": hour_of_day(ts),
        "day_of_week": day_of_week(ts),
        "is_weekend": is_weekend(ts),
        "is_night": is_night(ts),
    })


def iso_text(ts: Column, sep: str = "T") -> Column:
    """``datetime.isoformat(sep)`` text: microseconds shown only when non-zero."""
    date_part = f"yyyy-MM-dd'{sep}'HH:mm:ss"
    whole = F.date_format(ts, date_part)
    frac = F.date_format(ts, "SSSSSS")
    return F.when(frac == F.lit("000000"), whole).otherwise(F.concat(whole, F.lit("."), frac))


def series_from_text(df: DataFrame, text_col: str, out_col: str | None = None) -> DataFrame:
    """Text -> timestamp with coercion (bad text becomes null), drop the
    rows that failed, order by time (chart series preparation)."""
    out_col = out_col or text_col
    parsed = df.withColumn(out_col, F.try_to_timestamp(F.col(text_col).cast("string")))
    return parsed.filter(F.col(out_col).isNotNull()).orderBy(out_col)


def interval_us(text: str) -> int:
    """'10 minutes' -> microseconds (units: second, minute, hour, day)."""
    n, unit = text.split()
    scale = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(float(n) * scale * 1_000_000)


def window_bounds(lo, hi, every: str):
    """Epoch-aligned tumbling-window cover [start, end) of naive datetimes
    ``lo``..``hi`` (Spark's ``window`` alignment without offset)."""
    from datetime import datetime, timedelta
    epoch = datetime(1970, 1, 1)
    w = interval_us(every)
    to_us = lambda d: (d - epoch) // timedelta(microseconds=1)
    start = to_us(lo) // w * w
    end = (to_us(hi) // w + 1) * w
    return epoch + timedelta(microseconds=start), epoch + timedelta(microseconds=end)
