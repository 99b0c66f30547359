"""Accepted batches -> table rows, in the order the keys need: services, deployments, facts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators import keyed
from faultline.session import materialize
from faultline.sources import batches as B

# Table shapes in DDL, used when a store is still empty.
SERVICES = (
    "id string, name string, display_name string, description string, owner_team string, "
    "runtime string, criticality string"
)
DEPLOYMENTS = (
    "id string, service_id string, version string, commit_sha string, deployed_by string, "
    "environment string, status string, deployed_at timestamp_ntz, metadata map<string,string>"
)
INCIDENTS = (
    "id string, scenario_id string, service_id string, title string, severity string, "
    "status string, detected_at timestamp_ntz, started_at timestamp_ntz, detection_reason string, "
    "suspected_root_cause string, "
    "metadata struct<scenarioId:string,affectedSignals:array<string>,synthetic:boolean>"
)


def moment(text: Column) -> Column:
    """A contract date-time (always UTC) as a zone-free timestamp."""
    return F.rtrim(text, F.lit("Z")).cast("timestamp_ntz")


def service_rows(items: DataFrame) -> DataFrame:
    return items.select(
        keyed.stable_id(F.lit("service"), "name").alias("id"),
        "name",
        F.col("displayName").alias("display_name"),
        "description",
        F.col("ownerTeam").alias("owner_team"),
        "runtime",
        "criticality",
        "batch_seq",
    )


def deployment_rows(items: DataFrame, services: DataFrame) -> DataFrame:
    named = items.withColumnRenamed("serviceName", "service_name")
    known, _ = keyed.resolve_service(named, services, ["batch_id", "ordinal"])
    return known.select(
        keyed.stable_id(F.lit("deployment"), "service_id", "version", "environment").alias("id"),
        "service_id",
        "version",
        F.col("commitSha").alias("commit_sha"),
        F.col("deployedBy").alias("deployed_by"),
        "environment",
        "status",
        moment(F.col("deployedAt")).alias("deployed_at"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        "batch_seq",
    )


def log_rows(items: DataFrame, services: DataFrame, deployments: DataFrame) -> DataFrame:
    """Rows to append; not deduplicated, so a batch posted twice counts twice."""
    named = items.withColumnsRenamed(
        {"serviceName": "service_name", "deploymentVersion": "deployment_version"}
    )
    known, _ = keyed.resolve_service(named, services, ["batch_id", "ordinal"])
    known = keyed.resolve_deployment(known, deployments, ["batch_id", "ordinal"])
    return known.select(
        keyed.stable_id(F.lit("log"), "batch_id", "ordinal").alias("id"),
        "service_id",
        "deployment_id",
        moment(F.col("timestamp")).alias("timestamp"),
        "level",
        "message",
        F.col("traceId").alias("trace_id"),
        F.col("spanId").alias("span_id"),
        F.coalesce("attributes", F.parse_json(F.lit("{}"))).alias("attributes"),
    )


def metric_rows(items: DataFrame, services: DataFrame) -> DataFrame:
    """Rows to append; not deduplicated."""
    named = items.withColumnRenamed("serviceName", "service_name")
    known, _ = keyed.resolve_service(named, services, ["batch_id", "ordinal"])
    return known.select(
        keyed.stable_id(F.lit("metric"), "batch_id", "ordinal").alias("id"),
        "service_id",
        moment(F.col("timestamp")).alias("timestamp"),
        F.col("metricName").alias("metric_name"),
        F.col("metricValue").alias("metric_value"),
        "unit",
        F.coalesce("attributes", F.parse_json(F.lit("{}"))).alias("attributes"),
    )


def incident_rows(items: DataFrame, services: DataFrame) -> DataFrame:
    named = items.withColumnRenamed("serviceName", "service_name")
    known, _ = keyed.resolve_service(named, services, ["batch_id", "ordinal"])
    return known.select(
        F.col("id").alias("scenario_id"),
        "service_id",
        "title",
        "severity",
        moment(F.col("detectedAt")).alias("detected_at"),
        moment(F.col("startedAt")).alias("started_at"),
        F.col("detectionReason").alias("detection_reason"),
        F.col("suspectedRootCause").alias("suspected_root_cause"),
        F.coalesce("affectedSignals", F.array().cast("array<string>")).alias("affected_signals"),
        "batch_seq",
    )


def resolve_tables(
    tables: Mapping[str, DataFrame], parts: Mapping[str, DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Services and deployments after the batch, written out: every fact looks them up."""
    services = keyed.upsert_services(tables["services"], service_rows(parts["services"]))
    services = materialize(services, "services")
    deployments = keyed.upsert_deployments(
        tables["deployments"], deployment_rows(parts["deployments"], services)
    )
    return services, materialize(deployments, "deployments")


def ingest(
    tables: Mapping[str, DataFrame], batches: DataFrame
) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """(rewritten tables, rows to append, summary) for typed batches."""
    parts = B.split(batches)
    services, deployments = resolve_tables(tables, parts)
    logs = log_rows(parts["logs"], services, deployments)
    metrics = metric_rows(parts["metrics"], services)
    scenarios = incident_rows(parts["incidents"], services)
    incidents = keyed.insert_absent_incidents(tables["incidents"], scenarios)
    return (
        {"services": services, "deployments": deployments, "incidents": incidents},
        {"log_entries": logs, "metric_points": metrics},
        ingest_summary(logs, metrics, scenarios, tables["incidents"], parts["incidents"]),
    )


def ingest_summary(
    logs: DataFrame,
    metrics: DataFrame,
    scenarios: DataFrame,
    stored_incidents: DataFrame,
    sent_incidents: DataFrame | None = None,
) -> DataFrame:
    """{insertedLogs, insertedMetrics, incidents}.

    An incident counts when it is stored already, even under a service name that is now
    unknown, or when its service is known.
    """
    counted = scenarios.select("scenario_id", "batch_seq")
    if sent_incidents is not None:
        stored = stored_incidents.select("scenario_id").distinct()
        sent = sent_incidents.select(F.col("id").alias("scenario_id"), "batch_seq")
        counted = counted.unionByName(sent.join(stored, "scenario_id", "left_semi")).distinct()
    kinds = [
        logs.select(F.lit("logs").alias("kind")),
        metrics.select(F.lit("metrics").alias("kind")),
        counted.select(F.lit("incidents").alias("kind")),
    ]

    def of(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    return reduce(DataFrame.unionByName, kinds).agg(
        of("logs").alias("insertedLogs"),
        of("metrics").alias("insertedMetrics"),
        of("incidents").alias("incidents"),
    )
