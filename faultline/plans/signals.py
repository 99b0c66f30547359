"""Service signals that ingest keeps up to date: mergeable partials instead of full scans.

A partial holds what an epoch's facts say about a service and day: the metric's peak and
rows, error logs, and when the peak first reached the threshold. All of it merges (max, sum,
min), in any order and grouping, so readers fold partials and no fact is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.schemas import ERROR_LEVELS, LATENCY_METRIC, LATENCY_THRESHOLD
from faultline.sources.changes import ChangeLog

TABLE = "service_days"


def partials(
    metrics: DataFrame, logs: DataFrame, metric: str = LATENCY_METRIC, threshold: float = LATENCY_THRESHOLD
) -> DataFrame:
    """(service_id, day, max_latency, n_metrics, errors, first_breach) of some facts."""
    value = F.col("metric_value")
    of_metrics = metrics.where(F.col("metric_name") == metric).select(
        "service_id", F.to_date("timestamp").alias("day"), value.alias("max_latency"), F.lit(1).alias("n_metrics"),
        F.lit(0).alias("errors"), F.when(value >= threshold, F.col("timestamp")).alias("first_breach"),
    )
    of_logs = logs.where(F.col("level").isin(*ERROR_LEVELS)).select(
        "service_id", F.to_date("timestamp").alias("day"), F.lit(1).alias("errors")
    )
    return merged(of_metrics.unionByName(of_logs, allowMissingColumns=True), "service_id", "day")


def merged(rows: DataFrame, *keys: str) -> DataFrame:
    """Partials of the same keys as one; folded where they lie before they are shuffled."""
    return rows.groupBy(*keys).agg(
        F.max("max_latency").alias("max_latency"),
        F.coalesce(F.sum("n_metrics"), F.lit(0)).cast("long").alias("n_metrics"),
        F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("errors"),
        F.min("first_breach").alias("first_breach"),
    )


def keep(log: ChangeLog, stream: str, epoch: int, metric: str = LATENCY_METRIC, threshold: float = LATENCY_THRESHOLD) -> None:
    """Set the partials of an epoch from the facts that it has stored; no other file is read."""
    facts = {}
    for table in ("metric_points", "log_entries"):
        facts[table] = log.epoch(table, stream, epoch)
    if any(rows is not None for rows in facts.values()):
        empty = log.spark.createDataFrame(
            [], "service_id string, timestamp timestamp_ntz, metric_name string, metric_value double, level string"
        )
        metrics, logs = (rows if rows is not None else empty for rows in facts.values())
        log.write(TABLE, partials(metrics, logs, metric, threshold), stream, epoch)


def kept_signals(log: ChangeLog, services: DataFrame, start=None, end=None) -> DataFrame:
    """The signals of every service from the kept partials, as a scan of all facts gives them.

    ``start`` and ``end`` (dates, both inclusive) leave out the partials of other days.
    """
    rows = log.facts(TABLE)
    if rows is None:
        rows = log.spark.createDataFrame(
            [], "service_id string, day date, max_latency double, n_metrics long, errors long, first_breach timestamp_ntz"
        )
    if start is not None:
        rows = rows.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("day") <= F.lit(end).cast("date"))
    found = merged(rows, "service_id")
    named = services.select(F.col("id").alias("service_id"), F.col("name").alias("service_name"))
    none = F.lit(0).cast("long")
    return named.join(found, "service_id", "left").select(
        "service_id", "service_name", "max_latency", F.coalesce("errors", none).alias("errors"),
        F.coalesce("n_metrics", none).alias("n_metrics"), "first_breach",
    )
