"""Lists, look-ups and searches over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.schemas import LOG_LIST_DEFAULT, LOG_LIST_MAX
from faultline.session import lookup_join

SERVICE_COLUMNS = (
    "id", "name", "display_name", "description", "owner_team", "runtime", "criticality", "created_at",
)
INCIDENT_COLUMNS = (
    "id", "service_name", "title", "severity", "status", "detected_at", "started_at",
    "detection_reason", "suspected_root_cause", "metadata",
)


def service_names(services: DataFrame) -> DataFrame:
    return services.select(F.col("id").alias("service_id"), F.col("name").alias("service_name"))


def with_service_name(rows: DataFrame, services: DataFrame, how: str = "inner") -> DataFrame:
    return lookup_join(rows, service_names(services), ["service_id"], how, spread=["id"])


def service_list(services: DataFrame) -> DataFrame:
    columns = [c for c in SERVICE_COLUMNS if c in services.columns]
    return services.select(*columns).orderBy("name")


def service_lookup(services: DataFrame, keys: DataFrame) -> DataFrame:
    """The service each ``key`` names by id or by name; an id match comes first."""
    keys = keys.select("key").distinct()
    found = [
        keys.join(
            services.select(by.alias("key"), F.lit(rank).alias("_rank"), F.struct("*").alias("_row")),
            "key",
        )
        for rank, by in enumerate((services["id"].cast("string"), services["name"]))
    ]
    return (
        found[0]
        .unionByName(found[1])
        .groupBy("key")
        .agg(F.min_by("_row", "_rank").alias("_row"))
        .select("key", "_row.*")
    )


def log_search(
    logs: DataFrame,
    services: DataFrame,
    *,
    service: str | None = None,
    level: str | None = None,
    start=None,
    end=None,
    limit: int | None = None,
) -> DataFrame:
    """Newest logs that meet every given filter; an empty filter counts as absent."""
    by_day = "day" in logs.columns  # stored logs have a folder per day
    if start:
        logs = logs.filter(F.col("timestamp") >= F.lit(start))
        logs = logs.filter(F.col("day") >= F.lit(start).cast("date")) if by_day else logs
    if end:
        logs = logs.filter(F.col("timestamp") <= F.lit(end))
        logs = logs.filter(F.col("day") <= F.lit(end).cast("date")) if by_day else logs
    if level:
        logs = logs.filter(F.col("level") == level)
    if service:
        services = services.filter(F.col("name") == service)
    rows = min(LOG_LIST_DEFAULT if limit is None else limit, LOG_LIST_MAX)
    columns = ["id", "service_name", "timestamp", "level", "message", "trace_id", "span_id", "attributes"]
    named = with_service_name(logs, services)
    return (
        named.select(*[c for c in columns if c in named.columns])
        .orderBy(F.desc("timestamp"), "id")
        .limit(rows)
    )


def incident_list(incidents: DataFrame, services: DataFrame) -> DataFrame:
    named = with_service_name(incidents, services)
    return named.select(*INCIDENT_COLUMNS).orderBy(F.desc("detected_at"), "id")


def incident_lookup(
    incidents: DataFrame, services: DataFrame, ids: DataFrame, *, with_service_id: bool = False
) -> DataFrame:
    """The incidents with these ids; the investigation form also has the service id."""
    wanted = incidents.join(ids.select("id").distinct(), "id", "left_semi")
    columns = [*INCIDENT_COLUMNS, *(["service_id"] if with_service_id else [])]
    return with_service_name(wanted, services).select(*columns)


def runbook_list(runbooks: DataFrame, services: DataFrame) -> DataFrame:
    named = with_service_name(runbooks, services, "left")
    return named.select("id", "title", "slug", "body", "service_name").orderBy("slug")


def incident_text_search(listed: DataFrame, query: str = "", severity: str = "all") -> DataFrame:
    """Filter of the incident table: a severity and a text found in four joined columns."""
    if severity != "all":
        listed = listed.filter(F.col("severity") == severity)
    # A null joins as an empty text.
    parts = [
        F.coalesce(F.col(c), F.lit("")) for c in ("service_name", "severity", "status", "title")
    ]
    return listed.filter(F.lower(F.concat_ws(" ", *parts)).contains(query.lower()))
