"""Table and message shapes, enumerations and numeric defaults."""

from __future__ import annotations

# Enumerations of the telemetry contract and of the stored tables.
CRITICALITIES = ("low", "medium", "high", "critical")
LOG_LEVELS = ("debug", "info", "warn", "error", "fatal")
SEVERITIES = ("sev1", "sev2", "sev3", "sev4")
INCIDENT_STATUSES = ("detected", "investigating", "analyzed", "closed")
DEPLOYMENT_STATUSES = ("succeeded", "failed", "rolled_back")
INVESTIGATION_STATUSES = ("queued", "running", "completed", "failed")
STEP_TYPES = ("prompt", "tool_call", "observation", "reasoning", "final")
TOOL_STATUSES = ("success", "error")
EVIDENCE_SOURCES = ("log", "metric", "deployment", "runbook")
ROLES = ("system", "user", "assistant")
TOOLS = ("query_logs", "query_metrics", "get_deployments", "search_runbooks")
PROMPT_VERSION = "incident-investigation-v1"

# Sizes and thresholds.
EMBEDDING_DIMENSION = 768
CHUNK_CHARACTERS = 900
SEARCH_LIMIT = 5
SEARCH_LIMIT_MAX = 20
LOG_LIST_DEFAULT = 100
LOG_LIST_MAX = 500
INCIDENT_LOG_LIMIT = 80
INCIDENT_DEPLOYMENT_LIMIT = 5
LOOKBACK = "30 minutes"
LOOKAHEAD = "15 minutes"
LATENCY_METRIC = "p95_latency_ms"
LATENCY_THRESHOLD = 1200.0
ERROR_LEVELS = ("error", "fatal")

# Message shapes as DDL text, so that importing needs no session.


def _nested(ddl: str) -> str:
    """The fields of a DDL text in the form they take inside struct<..>."""
    return ddl.replace(" ", ":").replace(",:", ",")


SERVICE_ITEM = (
    "name string, displayName string, description string, ownerTeam string, "
    "runtime string, criticality string"
)
DEPLOYMENT_ITEM = (
    "serviceName string, version string, commitSha string, deployedBy string, "
    "environment string, status string, deployedAt string, metadata map<string,string>"
)
# Attribute values mix strings, numbers and booleans, so they stay VARIANT.
LOG_ITEM = (
    "serviceName string, deploymentVersion string, timestamp string, level string, "
    "message string, traceId string, spanId string, attributes variant"
)
METRIC_ITEM = (
    "serviceName string, timestamp string, metricName string, metricValue double, "
    "unit string, attributes variant"
)
INCIDENT_ITEM = (
    "id string, title string, serviceName string, severity string, startedAt string, "
    "detectedAt string, detectionReason string, suspectedRootCause string, "
    "affectedSignals array<string>"
)

TELEMETRY_BATCH = (
    "generatedAt string, "
    f"services array<struct<{_nested(SERVICE_ITEM)}>>, "
    f"deployments array<struct<{_nested(DEPLOYMENT_ITEM)}>>, "
    f"logs array<struct<{_nested(LOG_ITEM)}>>, "
    f"metrics array<struct<{_nested(METRIC_ITEM)}>>, "
    f"incidents array<struct<{_nested(INCIDENT_ITEM)}>>"
)
LOGS_BATCH = f"logs array<struct<{_nested(LOG_ITEM)}>>"

REPORT = (
    "summary string, probableRootCause string, confidence double, "
    "evidence array<struct<source string, reference string, detail string>>, "
    "citedRunbooks array<struct<title string, slug string, chunkId string, quote string>>, "
    "recommendedNextDiagnostics array<string>"
)

# Stored tables: column -> rule used by the integrity check.
# The constraints that stored rows have to meet.
REQUIRED = {
    "services": ("id", "name", "display_name", "description", "owner_team", "runtime", "criticality"),
    "deployments": ("id", "service_id", "version", "commit_sha", "deployed_by", "environment", "status", "deployed_at"),
    "log_entries": ("id", "service_id", "timestamp", "level", "message", "attributes"),
    "metric_points": ("id", "service_id", "timestamp", "metric_name", "metric_value", "unit"),
    "incidents": ("id", "service_id", "title", "severity", "status", "detected_at", "started_at", "detection_reason"),
    "runbooks": ("id", "title", "slug", "body"),
    "runbook_chunks": ("id", "runbook_id", "chunk_index", "content"),
    "investigations": ("id", "incident_id", "status", "provider", "model", "prompt_version"),
    "investigation_steps": ("id", "investigation_id", "step_index", "step_type", "title", "content"),
    "tool_calls": ("id", "investigation_id", "tool_name", "input", "output", "status", "latency_ms"),
}
ENUMS = {
    "services": {"criticality": CRITICALITIES},
    "deployments": {"status": DEPLOYMENT_STATUSES},
    "log_entries": {"level": LOG_LEVELS},
    "incidents": {"severity": SEVERITIES, "status": INCIDENT_STATUSES},
    "investigations": {"status": INVESTIGATION_STATUSES},
    "investigation_steps": {"step_type": STEP_TYPES},
    "tool_calls": {"status": TOOL_STATUSES},
}
UNIQUE = {
    "services": (("id",), ("name",)),
    "deployments": (("id",), ("service_id", "version", "environment")),
    "log_entries": (("id",),),
    "metric_points": (("id",),),
    "incidents": (("id",),),
    "runbooks": (("id",), ("slug",)),
    "runbook_chunks": (("id",), ("runbook_id", "chunk_index")),
    "investigations": (("id",),),
    "investigation_steps": (("id",), ("investigation_id", "step_index")),
    "tool_calls": (("id",),),
    "evaluations": (("id",),),
}
FOREIGN = {
    "deployments": {"service_id": "services"},
    "log_entries": {"service_id": "services", "deployment_id": "deployments"},
    "metric_points": {"service_id": "services"},
    "incidents": {"service_id": "services"},
    "runbooks": {"service_id": "services"},
    "runbook_chunks": {"runbook_id": "runbooks"},
    "investigations": {"incident_id": "incidents"},
    "investigation_steps": {"investigation_id": "investigations"},
    "tool_calls": {"investigation_id": "investigations"},
    "evaluations": {"investigation_id": "investigations"},
}
# Numeric ranges, both ends allowed; None means open. Nulls pass, as in a CHECK.
RANGES = {
    "investigations": {"confidence_score": (0, 1)},
    "tool_calls": {"latency_ms": (0, None)},
    "evaluations": {
        "groundedness_score": (0, 1),
        "completeness_score": (0, 1),
        "root_cause_quality_score": (0, 1),
        "citation_score": (0, 1),
        "overall_score": (0, 1),
    },
}
# Child tables removed together with their parent.
CASCADES = {
    "investigations": {
        "investigation_steps": "investigation_id",
        "tool_calls": "investigation_id",
        "evaluations": "investigation_id",
    },
    "runbooks": {"runbook_chunks": "runbook_id"},
}
