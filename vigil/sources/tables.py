"""Parquet table access and the canonical event view.

The driver's ``events`` table carries (event_id, ts, user_id, event_type,
value, props).  The canonical view maps it onto the transaction-event shape
all operators consume; device, location and a given fraud score are derived
deterministically from the ``k`` value in ``props`` (and the session from
user and day) so every downstream result is reproducible in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.schemas import DEVICE_TYPES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Canonical mapping of the driver table (fixed so the SQL oracle can mirror it).
N_LOCATIONS = 15
LOCATION_PREFIX = "loc_"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def props_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def canonical_events(raw: DataFrame) -> DataFrame:
    """Driver ``events`` rows -> canonical transaction events.

    Pure projection: Catalyst prunes the scan to the six source columns and
    keeps the whole mapping inside one codegen stage.
    """
    k = props_k(F.col("props"))
    devices = F.array(*[F.lit(d) for d in DEVICE_TYPES])
    score = (k.cast("double") / F.lit(100.0))
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.col("ts").alias("event_time"),
        F.col("value").alias("transaction_amount"),
        F.concat(F.lit(LOCATION_PREFIX), (k % N_LOCATIONS).cast("string")).alias("location"),
        F.try_element_at(devices, (k % len(DEVICE_TYPES)) + 1).alias("device_type"),
        F.col("event_type"),
        F.lit("USD").alias("currency"),
        score.alias("fraud_probability"),
        (score >= 0.5).alias("is_fraud"),
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(read_table(spark, sf_dir, "events"))


# SQL text of the same view, for the DuckDB oracle (kept next to the Spark
# form so the two cannot drift apart).
CANONICAL_EVENTS_SQL = f"""
SELECT CAST(event_id AS VARCHAR) AS event_id,
       CAST(user_id AS VARCHAR) AS user_id,
       CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id,
       ts AS event_time,
       value AS transaction_amount,
       '{LOCATION_PREFIX}' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % {N_LOCATIONS} AS VARCHAR) AS location,
       ([{", ".join(repr(d) for d in DEVICE_TYPES)}])[CAST(json_extract_string(props, '$.k') AS INTEGER) % {len(DEVICE_TYPES)} + 1] AS device_type,
       event_type,
       'USD' AS currency,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(100 AS DOUBLE) AS fraud_probability,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) / CAST(100 AS DOUBLE) >= 0.5 AS is_fraud
FROM events
"""
