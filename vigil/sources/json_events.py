"""The JSON wire format, stream sources/sinks and the raw archive.

The same ``parse_events`` runs on a Kafka stream, a JSON file stream and a
batch frame of text lines.  Kafka needs the ``spark-sql-kafka`` package on the
cluster's classpath; it is not present in this environment, where tests use
the file source with the identical parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.schemas import MALFORMED, PARSE_COLUMNS, RAW_EVENT_SCHEMA


def parse_events(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """S3: JSON text -> typed event columns; ISO text -> ``event_time``.

    No line is lost and no bad value is taken for an absent one: a field whose
    text is there but does not fit its type is null and leaves ``bad_<field>``
    in ``parse_errors``; a line that is no JSON object has nulls only and
    ``malformed_json``.  ``corrupt_record`` keeps the text of such lines.
    Numbers sent as text ("12.5") are read as numbers.  Validation sends rows
    with parse errors to quarantine; both columns are null for good lines.
    """
    text = F.col(value_col).cast("string")
    both = raw.select(text.alias("_text"), F.from_json(text, RAW_EVENT_SCHEMA).alias("e"),
                      F.from_json(text, "map<string,string>").alias("_sent"))
    sent = lambda c: F.col("_sent")[c]
    malformed = F.col("_sent").isNull()
    typed = {}
    for f in RAW_EVENT_SCHEMA.fields:
        value = F.col(f"e.{f.name}")
        if f.name == "timestamp":
            value = F.try_to_timestamp(value).cast("timestamp_ntz")
        elif isinstance(f.dataType, T.NumericType):
            value = F.coalesce(value, sent(f.name).try_cast(f.dataType))
        typed[f.name] = F.when(~malformed, value)
    bad = [F.when(typed[c].isNull() & sent(c).isNotNull(), F.lit(f"bad_{c}")) for c in typed]
    errors = F.when(malformed, F.array(F.lit(MALFORMED))) \
              .otherwise(F.filter(F.array(*bad), lambda e: e.isNotNull()))
    parsed = both.select(*[c.alias("event_time" if name == "timestamp" else name) for name, c in typed.items()],
                         errors.alias("parse_errors"), F.col("_text").alias("corrupt_record"))
    flawed = F.size("parse_errors") > 0
    first = [c for c in parsed.columns if c not in ("event_time", *PARSE_COLUMNS)]
    return parsed.select(*first, "event_time", *[F.when(flawed, F.col(c)).alias(c) for c in PARSE_COLUMNS])


def to_wire(df: DataFrame, key_col: str = "user_id", time_col: str = "event_time") -> DataFrame:
    """(key, value) rows for a message sink; the time travels as ISO text."""
    body = df.withColumn("timestamp", F.date_format(time_col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).drop(time_col)
    return body.select(F.col(key_col).cast("string").alias("key"),
                       F.to_json(F.struct(*[F.col(c) for c in body.columns]),
                                 {"ignoreNullFields": "false"}).alias("value"))


def kafka_stream(spark: SparkSession, servers: str, topic: str,
                 starting_offsets: str = "earliest", fail_on_data_loss: bool | None = None) -> DataFrame:
    """Kafka source parsed into events.

    Reading from the earliest offset (S1) fails when offsets are lost; the
    monitoring source that starts at the latest (S2) goes on.
    """
    if fail_on_data_loss is None:
        fail_on_data_loss = starting_offsets != "latest"
    raw = (spark.readStream.format("kafka")
           .option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic)
           .option("startingOffsets", starting_offsets)
           .option("failOnDataLoss", str(fail_on_data_loss).lower())
           .load())
    return parse_events(raw)


def json_file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File-stream twin of the Kafka source: one JSON document per line."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_events(reader.load(path))


def archive_events(df: DataFrame, path: str, time_col: str = "event_time", mode: str = "append") -> None:
    """Raw archive as JSON under ``year=YYYY/month=MM/day=DD/hour=HH``.

    Partition values are zero-padded text on disk; reading the archive back
    infers them as integers.  Rows are sorted by the partition columns inside
    each task (no shuffle), so a task writes one file per hour it holds and a
    hot hour is still written by many tasks in parallel.
    """
    parts = {
        "year": F.date_format(time_col, "yyyy"),
        "month": F.date_format(time_col, "MM"),
        "day": F.date_format(time_col, "dd"),
        "hour": F.date_format(time_col, "HH"),
    }
    out = df.withColumns(parts)
    (out.sortWithinPartitions(*parts)
        .write.mode(mode).partitionBy(*parts).json(path))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
