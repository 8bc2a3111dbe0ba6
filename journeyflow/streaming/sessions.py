"""The inactivity rule as an event-time session window.

A journey ends when its owner is inactive for ``gap``; in a stream this is a session window
per key with a watermark: a session is emitted (append mode) once the watermark passes its
end, i.e. once ``gap`` of event time went by without a new event of that key. The same
aggregation runs on a static DataFrame as the batch twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def journey_sessions(df: DataFrame, key: str, ts: str, gap: str, success: F.Column | None = None,
                     watermark: str | None = None) -> DataFrame:
    """Sessions per key: (key, session_start, session_end, n_events, reached_success).

    ``session_end`` is the last event time (the window end minus the gap)."""
    t = F.col(ts).cast("timestamp")
    d = df.withColumn("_t", t)
    if watermark:
        d = d.withWatermark("_t", watermark)
    succ = success if success is not None else F.lit(False)
    g = d.groupBy(F.col(key), F.session_window("_t", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max("_t").alias("_last"), F.bool_or(succ).alias("reached_success"))
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("_last").cast("timestamp_ntz").alias("session_end"), F.col("n_events").cast("long").alias("n_events"),
                    "reached_success")


def stream_journeys(spark: SparkSession, path: str, gap: str = "12 hours", watermark: str | None = None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming journeys from a folder of event parquet files (file source, explicit schema).
    ``max_files_per_trigger`` sets the files of a batch (None: all that are there).

    Returns the streaming DataFrame; start it with ``writeStream`` in append mode (sessions are
    final once the watermark passes them) into a sink with a checkpoint location."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = reader.parquet(path)
    return journey_sessions(ev, "user_id", "ts", gap, F.col("event_type") == "purchase", watermark or gap)

