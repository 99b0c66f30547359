"""Threshold detection per time window on a stream of telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.schemas import ERROR_LEVELS, LATENCY_METRIC, LATENCY_THRESHOLD


def signal_rows(metrics: DataFrame, logs: DataFrame, metric: str = LATENCY_METRIC) -> DataFrame:
    """Both signals as one long table (service_id, at, latency, is_error).

    One stream instead of two: windows are then aggregated without a stream-stream join.
    """
    peaks = metrics.filter(F.col("metric_name") == metric).select(
        "service_id",
        F.col("timestamp").alias("at"),
        F.col("metric_value").alias("latency"),
        F.lit(False).alias("is_error"),
    )
    errors = logs.filter(F.col("level").isin(*ERROR_LEVELS)).select(
        "service_id",
        F.col("timestamp").alias("at"),
        F.lit(None).cast("double").alias("latency"),
        F.lit(True).alias("is_error"),
    )
    return peaks.unionByName(errors)


def window_signals(signals: DataFrame, window: str, late: str | None = None) -> DataFrame:
    """Peak and errors per service and tumbling window; ``late`` is the watermark delay."""
    kind = signals.schema["at"].dataType
    if late:
        # A watermark wants a zoned timestamp; the session zone is UTC.
        signals = signals.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    grouped = signals.groupBy(F.window("at", window).alias("_w"), "service_id").agg(
        F.max("latency").alias("max_latency"), F.count_if("is_error").alias("errors")
    )
    return grouped.select(
        "service_id",
        F.col("_w.start").cast(kind).alias("window_start"),
        F.col("_w.end").cast(kind).alias("window_end"),
        "max_latency",
        "errors",
    )


def detected(threshold: float = LATENCY_THRESHOLD) -> Column:
    return (F.coalesce("max_latency", F.lit(0.0)) >= threshold) & (F.col("errors") > 0)


def stream_detect(
    signals: DataFrame, target: str, checkpoint: str, *,
    window: str = "10 minutes", late: str = "10 minutes",
    threshold: float | None = LATENCY_THRESHOLD, available_now: bool = True,
):
    """Start the detector: a window's row is appended once the watermark has passed it.

    State per open (service, window) is two numbers. Without a threshold every window's
    signals are written.
    """
    rows = window_signals(signals, window, late)
    if threshold is not None:
        rows = rows.filter(detected(threshold))
    writer = (
        rows.writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
