"""Validation with quarantine, defaults and enrichment.

Validation never drops rows silently: every row lands either in the valid
frame or in the quarantine frame with the list of reasons it failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.numeric import py_round
from vigil.functions.time import with_time_features
from vigil.operators.rolling import rolling_user_features
from vigil.schemas import DEFAULT_CURRENCY, DEVICE_TYPES, EVENT_TYPES, FAILED_LOGIN, INFERENCE_DEFAULTS, MALFORMED, PARSE_COLUMNS

REQUIRED = ["user_id", "session_id", "transaction_amount", "location", "device_type", "event_type"]


def round2(x: Column) -> Column:
    """Python ``round(x, 2)`` (half-even on the exact binary value)."""
    return py_round(x, 2)


def reject_reasons(required: list[str] = REQUIRED, event_types: list[str] = EVENT_TYPES,
                   device_types: list[str] = DEVICE_TYPES, parse_errors: Column | None = None) -> Column:
    """Array of failed checks (empty when the row is valid).

    With the parser's ``parse_errors``, those come first; a field that was
    sent but could not be read is bad, not missing, and of a malformed line
    nothing else is said.
    """
    missing = {c: F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in required}
    others = [
        F.when(F.col("transaction_amount") < 0, F.lit("negative_amount")),
        F.when(F.col("event_type").isNotNull() & ~F.col("event_type").isin(event_types),
               F.lit("unknown_event_type")),
        F.when(F.col("device_type").isNotNull() & ~F.col("device_type").isin(device_types),
               F.lit("unknown_device_type")),
    ]
    found = lambda checks: F.filter(F.array(*checks), lambda r: r.isNotNull())
    if parse_errors is None:
        return found([*missing.values(), *others])
    errors = F.coalesce(parse_errors, F.array().cast("array<string>"))
    absent = [F.when(~F.array_contains(errors, f"bad_{c}"), check) for c, check in missing.items()]
    return F.when(F.array_contains(errors, MALFORMED), errors).otherwise(F.concat(errors, found([*absent, *others])))


def validate_events(df: DataFrame, **kw) -> DataFrame:
    """P1–P3 in one projection: reasons, defaults and 2-dp amounts.

    event_id defaults to a UUID (non-deterministic: persist or write the
    result before reading it twice), an absent timestamp to the processing
    time and the currency to USD.  A timestamp that could not be read
    (``parse_errors``) rejects the row and stays null.
    """
    errors = F.col("parse_errors") if "parse_errors" in df.columns else None
    out = df.withColumn("reject_reasons", reject_reasons(parse_errors=errors, **kw))
    defaults = {
        "transaction_amount": round2(F.col("transaction_amount")),
        "event_id": F.coalesce(F.col("event_id"), F.expr("uuid()")),
    }
    if "currency" in df.columns:
        defaults["currency"] = F.coalesce(F.col("currency"), F.lit(DEFAULT_CURRENCY))
    if "event_time" in df.columns:
        now = F.localtimestamp()
        if errors is not None:
            now = F.when(errors.isNull(), now)
        defaults["event_time"] = F.coalesce(F.col("event_time"), now)
    return out.withColumns(defaults)


def split_valid(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``reject_reasons``)."""
    checked = validate_events(df, **kw)
    ok = F.size("reject_reasons") == 0
    return checked.filter(ok).drop("reject_reasons", *PARSE_COLUMNS), checked.filter(~ok)


def dedupe_events(df: DataFrame, key: str = "event_id", order_col: str = "event_time") -> DataFrame:
    """One row per ``key``, the earliest by ``order_col`` (ties broken by
    a hash of the whole row, so the choice is deterministic), before window
    features count it.

    ``min_by`` is a partial aggregate, so copies of a hot id collapse on the
    map side before the shuffle.
    """
    cols = df.columns
    # Maps can't be hashed or compared: they are ordered by their sorted entries.
    hashed = [F.to_json(F.sort_array(F.map_entries(c))) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c)
              for c in cols]
    best = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(order_col), F.xxhash64(*hashed)))
    return df.groupBy(key).agg(best.alias("_r")).select("_r.*")


def enrich_events(df: DataFrame, window_minutes: int = 60, failed_type: str = FAILED_LOGIN, **kw) -> DataFrame:
    """P5: raw columns + calendar features + rolling features + processed_at."""
    df = df.withColumn("user_id", F.coalesce(F.col("user_id"), F.lit("unknown")))
    out = rolling_user_features(with_time_features(df), window_minutes=window_minutes, failed_type=failed_type, **kw)
    return out.withColumn("processed_at", F.current_timestamp())


def with_inference_defaults(df: DataFrame) -> DataFrame:
    """Optional request fields take their defaults."""
    present = {k: v for k, v in INFERENCE_DEFAULTS.items() if k in df.columns}
    missing = {k: F.lit(v) for k, v in INFERENCE_DEFAULTS.items() if k not in df.columns}
    return df.fillna(present).withColumns(missing)
