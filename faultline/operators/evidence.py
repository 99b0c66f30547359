"""What surrounds an incident, for all incidents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.positions import (
    first_in_span,
    last_in_span,
    locate_spans,
    summarize_spans,
)
from faultline.schemas import (
    INCIDENT_DEPLOYMENT_LIMIT,
    INCIDENT_LOG_LIMIT,
    LOOKAHEAD,
    LOOKBACK,
)


def incident_spans(
    incidents: DataFrame, lookback: str | None = LOOKBACK, lookahead: str = LOOKAHEAD
) -> DataFrame:
    """[started - lookback, detected + lookahead] per incident; no lookback, no lower end."""
    closes = F.expr(f"detected_at + INTERVAL {lookahead}")
    opens = (
        F.expr(f"started_at - INTERVAL {lookback}")
        if lookback
        else F.lit(None).cast(incidents.schema["detected_at"].dataType)
    )
    return incidents.select(
        F.col("id").alias("span_id"), "service_id", opens.alias("opens"), closes.alias("closes")
    )


def _by_incident(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("span_id", "incident_id")


def incident_logs(
    incidents: DataFrame,
    logs: DataFrame,
    lookback: str = LOOKBACK,
    lookahead: str = LOOKAHEAD,
    limit: int = INCIDENT_LOG_LIMIT,
) -> DataFrame:
    """The earliest ``limit`` logs of the service in the window, ranked by time."""
    spans = incident_spans(incidents, lookback, lookahead)
    columns = ["id", "service_id", "timestamp", "level", "message", "attributes"]
    facts, located = locate_spans(
        logs.select(*columns), spans, key="service_id", time="timestamp", tie="id"
    )
    return _by_incident(first_in_span(facts, located, limit))


def incident_metric_summary(
    incidents: DataFrame,
    metrics: DataFrame,
    lookback: str = LOOKBACK,
    lookahead: str = LOOKAHEAD,
) -> DataFrame:
    """min, max, avg and samples per metric and unit in the window."""
    spans = incident_spans(incidents, lookback, lookahead)
    columns = ["id", "service_id", "timestamp", "metric_name", "unit", "metric_value"]
    facts, located = locate_spans(
        metrics.select(*columns), spans, key="service_id", time="timestamp", tie="id"
    )
    return _by_incident(summarize_spans(facts, located, ["metric_name", "unit"], "metric_value"))


def incident_deployments(
    incidents: DataFrame,
    deployments: DataFrame,
    lookahead: str = LOOKAHEAD,
    limit: int = INCIDENT_DEPLOYMENT_LIMIT,
) -> DataFrame:
    """The newest ``limit`` deployments up to the end of the window, however old."""
    spans = incident_spans(incidents, None, lookahead)
    columns = [
        "id", "service_id", "version", "commit_sha", "deployed_by", "status", "deployed_at", "metadata",
    ]
    facts, located = locate_spans(
        deployments.select(*columns), spans, key="service_id", time="deployed_at", tie="id"
    )
    return _by_incident(last_in_span(facts, located, limit))


def last_deployment_before(incidents: DataFrame, deployments: DataFrame) -> DataFrame:
    """The latest deployment at or before the start, and the seconds between the two."""
    spans = incidents.select(
        F.col("id").alias("span_id"),
        "service_id",
        F.lit(None).cast(incidents.schema["started_at"].dataType).alias("opens"),
        F.col("started_at").alias("closes"),
    )
    facts, located = locate_spans(
        deployments.select("id", "service_id", "version", "status", "deployed_at"),
        spans,
        key="service_id",
        time="deployed_at",
        tie="id",
    )
    latest = _by_incident(last_in_span(facts, located, 1)).drop("rank", "service_id")
    starts = incidents.select(F.col("id").alias("incident_id"), "service_id", "started_at")
    gap = F.timestamp_diff("MICROSECOND", F.col("deployed_at"), F.col("started_at")) / 1_000_000
    return (
        starts.join(latest.withColumnRenamed("id", "deployment_id"), "incident_id")
        .withColumn("gap_seconds", gap)
    )
