"""Streaming forms of event deduplication and daily aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuria.operators.silver import daily_measures

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of bronze-shaped events from parquet files."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).select(
        "event_id",
        F.col("user_id").alias("customer_id"),
        "event_type",
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        F.col("props").alias("event_properties"),
        F.col("value").cast("decimal(12,2)").alias("minutes"),
    )


def dedup(events: DataFrame, delay: str = "1 day", key: str = "event_id") -> DataFrame:
    """First arrival per event id; ids are forgotten once the watermark passes them."""
    return events.withWatermark("event_timestamp", delay).dropDuplicatesWithinWatermark([key])


def daily_engagement(
    events: DataFrame,
    login_types: Sequence[str],
    feature_types: Sequence[str],
    feature_key: Column,
    minutes: Column,
    delay: str | None = "1 day",
) -> DataFrame:
    """One row per (customer, day), emitted when the watermark passes midnight; later events are dropped.

    The state per day is three numbers and the set of features used. Pass delay=None when
    the input already has a watermark.
    """
    if delay is not None:
        events = events.withWatermark("event_timestamp", delay)
    measures = daily_measures(login_types, feature_types, feature_key, minutes)
    days = events.groupBy("customer_id", F.window("event_timestamp", "1 day").alias("w")).agg(
        *[c.alias(n) for n, c in measures.items()]
    )
    return days.select("customer_id", F.to_date("w.start").alias("activity_date"), *measures)
