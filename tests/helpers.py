from datetime import datetime, timedelta

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("event_time", T.TimestampNTZType()),
    T.StructField("transaction_amount", T.DoubleType()),
    T.StructField("location", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("fraud_probability", T.DoubleType()),
    T.StructField("is_fraud", T.BooleanType()),
])

T0 = datetime(2024, 1, 15, 14, 0, 0)


def event(i, user="user_0001", t=None, amount=100.0, location="New York", device="mobile",
          etype="purchase", score=0.1, session="s1"):
    t = t if t is not None else T0 + timedelta(minutes=i)
    return (f"e{i:04d}", user, session, t, amount, location, device, etype, score,
            None if score is None else score >= 0.5)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)
