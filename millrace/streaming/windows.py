"""Event-time operators: de-duplication and throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(df: DataFrame, ts_col: str, delay: str, out: str = "event_time") -> DataFrame:
    """Zone-less UTC times become instants, which watermarks need."""
    return df.withColumn(out, F.col(ts_col).cast("timestamp")).withWatermark(out, delay)


def first_arrivals(stream: DataFrame, ts_col: str = "txn_ts", delay: str = "10 minutes", key: str = "txn_id") -> DataFrame:
    """Each id once; state for an id is dropped when the watermark passes it."""
    return with_event_time(stream, ts_col, delay).dropDuplicatesWithinWatermark([key]).drop("event_time")


def sliding_throughput(
    stream: DataFrame, ts_col: str = "ingest_ts", width: str = "60 seconds", slide: str = "1 second", delay: str = "5 seconds"
) -> DataFrame:
    """Rows per trailing window, one window per slide.

    Rows are first counted per slide step, so each row is one step row before it
    is spread over its windows.
    """
    stepped = (
        with_event_time(stream, ts_col, delay)
        .groupBy(F.window("event_time", slide).alias("step"))
        .agg(F.count("*").alias("n"))
    )
    windowed = stepped.groupBy(F.window(F.window_time("step"), width, slide).alias("w")).agg(F.sum("n").alias("n_rows"))
    return windowed.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "n_rows",
    )
