"""Registered queries: sources, ingest, keyed writes, checks, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.catalog import workspace as ws
from faultline.catalog.sqltext import ISO, LEVEL, sql
from faultline.operators import keyed
from faultline.operators.lookup import service_names
from faultline.plans import ingest, signals
from faultline.session import lookup_join, materialize, scratch_path
from faultline.sources import adapters as A
from faultline.sources import batches as B
from faultline.sources.changes import ChangeLog
from faultline.streaming import episodes
from faultline.streaming.detect import signal_rows, stream_detect
from faultline.streaming.ingest import stream_ingest


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def telemetry_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = B.read_telemetry(spark, ws.posted_folder(spark, sf_dir))
    parts = B.split(batches)
    shapes = {
        "services": ("name", None, "criticality"),
        "deployments": ("serviceName", "deployedAt", "version"),
        "logs": ("serviceName", "timestamp", "level"),
        "metrics": ("serviceName", "timestamp", "metricName"),
        "incidents": ("serviceName", "detectedAt", "severity"),
    }
    return _union(
        [
            parts[name].select(
                F.lit(name).alias("section"),
                F.col("generatedAt").alias("generated_at"),
                F.col(service).alias("service_name"),
                (F.lit(None).cast("string") if at is None else F.col(at)).alias("at"),
                F.col(label).alias("label"),
            )
            for name, (service, at, label) in shapes.items()
        ]
    )


TELEMETRY_SQL = sql("""
, g AS (SELECT batch_id, max(stamp) AS generated_at FROM m_posted GROUP BY 1)
SELECT 'services' AS section, generated_at, service AS service_name, CAST(NULL AS VARCHAR) AS "at",
       ['low', 'medium', 'high', 'critical'][user_id % 4 + 1] AS label
FROM (SELECT DISTINCT batch_id, service, user_id FROM m_posted) JOIN g USING (batch_id)
UNION ALL SELECT 'deployments', generated_at, service, stamp, 'v' || (event_id % 5)
FROM m_posted JOIN g USING (batch_id) WHERE event_type = 'signup'
UNION ALL SELECT 'logs', generated_at, service, stamp, level FROM m_posted JOIN g USING (batch_id)
UNION ALL SELECT 'metrics', generated_at, service, stamp, event_type FROM m_posted JOIN g USING (batch_id)
UNION ALL SELECT 'incidents', generated_at, service, stamp, 'sev2'
FROM m_posted JOIN g USING (batch_id) WHERE event_type = 'error' AND value >= 100""")


def logs_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the logs of ten events; per service also an empty batch and a cut-off line.

    What is no batch comes out with the reason why.
    """

    def write() -> str:
        log = F.struct(
            F.concat(F.lit("svc-"), F.col("service_id").cast("string")).alias("serviceName"),
            ws.iso(F.col("timestamp")).alias("timestamp"),
            "level",
            "message",
            F.parse_json("attributes").alias("attributes"),
        )
        logs = A.log_entries(spark, sf_dir)
        batches = logs.groupBy(F.floor(F.col("id") / 10).alias("batch_id")).agg(F.collect_list(log).alias("logs"))
        lines = batches.select(F.to_json(F.struct("logs")).alias("value"))
        bad = F.explode(F.array(F.lit('{"logs":[]}'), F.lit('{"logs":[{"serv'))).alias("value")
        path = scratch_path(spark, "log_batches")
        lines.unionByName(logs.select("service_id").distinct().select(bad)).write.text(path)
        return path

    folder = ws.once(spark, sf_dir, "log_batches", write)
    batches = B.read_logs(spark, folder).withColumn("size", F.size("logs").cast("long"))
    good = B.section(batches, "logs").select(
        F.col("serviceName").alias("service_name"),
        F.col("timestamp").alias("at"),
        "level",
        "message",
        F.variant_get("attributes", "$.k", "long").alias("k"),
        F.lit(None).cast("string").alias("rejected_for"),
    )
    nothing = {c: F.lit(None).cast(t) for c, t in good.dtypes if c != "rejected_for"}
    rejected = B.rejected_logs(spark, folder).withColumns(nothing).withColumnRenamed("reason", "rejected_for")
    return good.unionByName(rejected.select(*good.columns))


LOGS_SQL = f"""
SELECT 'svc-' || user_id AS service_name, {ISO} AS "at", {LEVEL} AS level, event_type AS message,
       CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS rejected_for FROM events
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, why
FROM (SELECT DISTINCT user_id FROM events), (VALUES ('logs'), ('json')) w(why)"""


@ws.stored("dirty_batches")
def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.batch_texts(spark, sf_dir, dirty=True)


def validate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.contract_violations(_dirty(spark, sf_dir))


VALIDATE_SQL = sql("""
, log_json AS (SELECT batch_id, event_id, place,
    '{' || CASE WHEN event_id % 29 <> 0 THEN '"serviceName":"' || service || '",' ELSE '' END
    || '"timestamp":"' || CASE WHEN event_id % 19 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE stamp END
    || '","level":"' || CASE WHEN event_id % 17 = 0 THEN 'trace' ELSE level END
    || '","message":' || CASE WHEN event_id % 23 = 0 THEN '5' ELSE '"' || event_type || '"' END
    || ',"metricValue":' || CASE WHEN event_id % 31 = 0 THEN '"high"' ELSE CAST(value AS VARCHAR) END
    || ',"environment":"' || CASE WHEN event_id % 13 = 0 THEN 'staging' ELSE 'production' END
    || '","serviceAlways":"' || service || '"}' AS j, event_type, value FROM m_posted),
checks AS (SELECT *, regexp_matches(json_extract_string(j, '$.timestamp'),
    '^\\d{4}-\\d{2}-\\d{2}T([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\d(\\.\\d+)?Z$') AS good_time FROM log_json),
d AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY event_id) - 1 AS pos FROM checks WHERE event_type = 'signup'),
n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY event_id) - 1 AS pos FROM checks
      WHERE event_type = 'error' AND value >= 100),
s AS (SELECT batch_id, user_id, row_number() OVER (PARTITION BY batch_id ORDER BY user_id) - 1 AS pos
      FROM (SELECT DISTINCT batch_id, user_id FROM m_posted))
SELECT batch_id, 'services' AS section, pos AS ordinal, 'criticality' AS field FROM s WHERE user_id % 11 = 0
UNION ALL SELECT batch_id, 'deployments', pos, 'environment' FROM d WHERE json_extract_string(j, '$.environment') <> 'production'
UNION ALL SELECT batch_id, 'deployments', pos, 'deployedAt' FROM d WHERE NOT good_time
UNION ALL SELECT batch_id, 'logs', place, 'serviceName' FROM checks WHERE json_type(j, '$.serviceName') IS NULL
UNION ALL SELECT batch_id, 'logs', place, 'timestamp' FROM checks WHERE NOT good_time
UNION ALL SELECT batch_id, 'logs', place, 'level' FROM checks
  WHERE json_extract_string(j, '$.level') NOT IN ('debug', 'info', 'warn', 'error', 'fatal')
UNION ALL SELECT batch_id, 'logs', place, 'message' FROM checks WHERE json_type(j, '$.message') <> 'VARCHAR'
UNION ALL SELECT batch_id, 'metrics', place, 'timestamp' FROM checks WHERE NOT good_time
UNION ALL SELECT batch_id, 'metrics', place, 'metricValue' FROM checks
  WHERE json_type(j, '$.metricValue') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT', 'DECIMAL')
UNION ALL SELECT batch_id, 'incidents', pos, f FROM n, (VALUES ('startedAt'), ('detectedAt')) t(f) WHERE NOT good_time""")


def reject_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _dirty(spark, sf_dir)
    accepted, rejected = B.accept(raw, B.contract_violations(raw))
    return accepted.select("batch_id", F.lit(True).alias("accepted")).unionByName(
        rejected.select("batch_id", F.lit(False).alias("accepted"))
    )


REJECT_SQL = sql("""
SELECT batch_id, NOT bool_or(event_id % 29 = 0 OR event_id % 19 = 0 OR event_id % 17 = 0
         OR event_id % 23 = 0 OR event_id % 31 = 0 OR user_id % 11 = 0
         OR (event_type = 'signup' AND event_id % 13 = 0)) AS accepted
FROM m_posted GROUP BY batch_id""")


def _named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under the name of their service, some under a name nobody has."""
    no = F.col("event_id")
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    return A.table(spark, sf_dir, "events").withColumn(
        "service_name", F.when(no % 37 == 0, F.concat(name, F.lit("-retired"))).otherwise(name)
    )


NAME = "'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || CASE WHEN event_id % 37 = 0 THEN '-retired' ELSE '' END"


def resolve_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named_events(spark, sf_dir).select(F.col("event_id").alias("id"), "service_name")
    known, _ = keyed.resolve_service(rows, A.services(spark, sf_dir), ["id"])
    return known.select("id", "service_id")


def unknown_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named_events(spark, sf_dir).select(F.col("event_id").alias("id"), "service_name")
    _, unknown = keyed.resolve_service(rows, A.services(spark, sf_dir), ["id"])
    return unknown.groupBy("service_name").agg(F.count("*").alias("rows"))


def resolve_deployment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    version = lambda n: F.concat(F.lit("v"), (F.col("event_id") % n).cast("string"))
    rows = e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("service_id"), version(7).alias("deployment_version")
    )
    deployed = e.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("service_id"), version(5).alias("version")
    )
    return keyed.resolve_deployment(rows, deployed, ["id"]).select("id", "deployment_id")


def upsert_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    source = _named_events(spark, sf_dir).select(
        F.concat(F.lit("new-"), "event_id").alias("id"),
        F.col("service_name").alias("name"),
        F.concat(F.lit("Service "), F.col("user_id").cast("string")).alias("display_name"),
        kind.alias("description"),
        F.concat(F.lit("team-"), kind).alias("owner_team"),
        F.lit("jvm").alias("runtime"),
        F.when(kind == "error", "critical").otherwise("low").alias("criticality"),
        F.col("event_id").alias("batch_seq"),
    )
    target = A.services(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return keyed.upsert_services(target, source)


UPSERT_SERVICES_SQL = sql(f"""
, src AS (SELECT {NAME} AS name, max_by({{'id': 'new-' || event_id, 'display_name': 'Service ' || user_id,
      'description': event_type, 'owner_team': 'team-' || event_type,
      'criticality': CASE event_type WHEN 'error' THEN 'critical' ELSE 'low' END}}, event_id) AS r
    FROM events GROUP BY 1)
SELECT coalesce(CAST(t.id AS VARCHAR), r.id) AS id, coalesce(t.name, s.name) AS name,
       CASE WHEN s.name IS NULL THEN t.display_name ELSE r.display_name END AS display_name,
       CASE WHEN s.name IS NULL THEN t.description ELSE r.description END AS description,
       CASE WHEN s.name IS NULL THEN t.owner_team ELSE r.owner_team END AS owner_team,
       CASE WHEN s.name IS NULL THEN t.runtime ELSE 'jvm' END AS runtime,
       CASE WHEN s.name IS NULL THEN t.criticality ELSE r.criticality END AS criticality
FROM m_services t FULL JOIN src s ON s.name = t.name""")


def upsert_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed deployments stand for the stored rows, the others for the batch."""
    no = F.col("id")
    rows = A.deployments(spark, sf_dir).withColumn("batch_seq", no)
    failed = F.col("status") == "failed"
    stored = keyed.latest_per_key(
        rows.filter(failed).withColumn("version", F.concat(F.lit("v"), (no % 50).cast("string"))),
        ["service_id", "version", "environment"],
        "batch_seq",
        first=True,
    ).drop("batch_seq")
    sent = rows.filter(~failed).withColumn("version", F.concat(F.lit("v"), (no % 60).cast("string")))
    merged = keyed.upsert_deployments(stored.select(*A.deployments(spark, sf_dir).columns), sent)
    return merged.select("id", "service_id", "version", "commit_sha", "status", "deployed_at", "metadata")


UPSERT_DEPLOYMENTS_SQL = sql("""
, stored AS (SELECT service_id, 'v' || (id % 50) AS version, min(id) AS id FROM m_deployments WHERE status = 'failed' GROUP BY ALL),
old AS (SELECT s.id, s.service_id, s.version, d.status, d.deployed_at, d.metadata FROM stored s JOIN m_deployments d USING (id)),
sent AS (SELECT service_id, 'v' || (id % 60) AS version, max(id) AS id FROM m_deployments WHERE status <> 'failed' GROUP BY ALL),
new AS (SELECT s.id, s.service_id, s.version, d.status, d.deployed_at, d.metadata FROM sent s JOIN m_deployments d USING (id))
SELECT coalesce(o.id, n.id) AS id, coalesce(o.service_id, n.service_id) AS service_id,
       coalesce(o.version, n.version) AS version, sha1(CAST(coalesce(n.id, o.id) AS VARCHAR)) AS commit_sha,
       coalesce(n.status, o.status) AS status, coalesce(n.deployed_at, o.deployed_at) AS deployed_at,
       coalesce(n.metadata, o.metadata) AS metadata
FROM old o FULL JOIN new n ON o.service_id = n.service_id AND o.version = n.version""")


def append_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = B.section(ws.typed_batches(spark, sf_dir), "metrics")
    rows = ingest.metric_rows(items, ws.posted_services(spark, sf_dir))
    return rows.drop("attributes")


APPEND_METRICS_SQL = sql("""
SELECT sha256('metric/' || batch_id || '/' || place) AS id, sha256('service/' || service) AS service_id,
       ts AS timestamp, event_type AS metric_name, value AS metric_value, 'u' AS unit FROM m_posted""")


def append_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = ws.typed_batches(spark, sf_dir)
    services = ws.posted_services(spark, sf_dir)
    empty = spark.createDataFrame([], ingest.DEPLOYMENTS)
    deployments = keyed.upsert_deployments(
        empty, ingest.deployment_rows(B.section(batches, "deployments"), services)
    )
    # The logs name a deployment version that exists for some services.
    items = B.section(batches, "logs").withColumn(
        "deploymentVersion", F.concat(F.lit("v"), (F.variant_get("attributes", "$.k", "long") % 6).cast("string"))
    )
    rows = ingest.log_rows(items, services, deployments)
    return rows.select(
        "id", "service_id", "deployment_id", "timestamp", "level", "message",
        F.variant_get("attributes", "$.k", "long").alias("k"),
    )


APPEND_LOGS_SQL = sql("""
, d AS (SELECT DISTINCT service, 'v' || (event_id % 5) AS version FROM m_posted WHERE event_type = 'signup'),
l AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM m_posted)
SELECT sha256('log/' || batch_id || '/' || place) AS id, sha256('service/' || l.service) AS service_id,
       CASE WHEN d.service IS NOT NULL THEN
         sha256('deployment/' || sha256('service/' || l.service) || '/' || d.version || '/production') END AS deployment_id,
       ts AS timestamp, level, event_type AS message, k
FROM l LEFT JOIN d ON d.service = l.service AND d.version = 'v' || (l.k % 6)""")


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.incidents(spark, sf_dir).select(
        F.concat(F.lit("sc-"), F.col("service_id").cast("string")).alias("scenario_id"),
        "service_id", "title", "severity", "detected_at", "started_at", "detection_reason",
        "suspected_root_cause",
        F.array(F.lit("value")).alias("affected_signals"),
        F.col("id").alias("batch_seq"),
    )


def insert_absent_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scenarios(spark, sf_dir)
    empty = spark.createDataFrame([], ingest.INCIDENTS.replace("service_id string", "service_id long"))
    stored = keyed.insert_absent_incidents(empty, rows.filter(F.col("severity").isin("sev1", "sev2")))
    merged = keyed.insert_absent_incidents(stored, rows)
    return merged.select(
        "id", "scenario_id", "service_id", "severity", "status", "detected_at",
        F.col("metadata.scenarioId").alias("metadata_scenario"), F.col("metadata.synthetic").alias("synthetic"),
    )


INSERT_ABSENT_SQL = sql("""
, r AS (SELECT 'sc-' || service_id AS scenario_id, *, severity IN ('sev1', 'sev2') AS kept FROM m_incidents),
pick AS (SELECT scenario_id, coalesce(min(id) FILTER (kept), min(id)) AS id FROM r GROUP BY 1)
SELECT sha256('incident/' || scenario_id) AS id, scenario_id, service_id, severity, 'detected' AS status,
       detected_at, scenario_id AS metadata_scenario, TRUE AS synthetic
FROM pick JOIN (SELECT id, service_id, severity, detected_at FROM m_incidents) i USING (id)""")


def _upsert_runbooks(body_only: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        target = A.runbooks(spark, sf_dir).select(
            "id", "title", "slug", "body", F.lit(None).cast("string").alias("source_path"), "version",
            at.alias("updated_at"),
        )
        later = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
        revised = A.table(spark, sf_dir, "labels").select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"),
            F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("body"),
            F.col("doc_id").alias("id"),
        )
        added = A.table(spark, sf_dir, "benchmark").select(
            F.concat(F.lit("bench-"), F.col("item_id").cast("string")).alias("slug"),
            F.col("text").alias("body"),
            (-1 - F.col("item_id")).alias("id"),
        )
        source = revised.unionByName(added).select(
            "*",
            F.lit("revised").alias("title"),
            F.lit("posted").alias("source_path"),
            F.lit(2).alias("version"),
            later.alias("updated_at"),
            F.lit(0).alias("batch_seq"),
        )
        merged = keyed.upsert_runbooks(target, source, body_only=body_only)
        return merged.withColumn("body", F.md5("body")).withColumn("version", F.col("version").cast("long"))

    return run


def _upsert_runbooks_sql(body_only: bool) -> str:
    def kept(stored: str, sent: str) -> str:
        return f"CASE WHEN t.id IS NULL OR (s.id IS NOT NULL AND {not body_only}) THEN {sent} ELSE {stored} END"

    return f"""
WITH s AS (SELECT 'doc-' || doc_id AS slug, 'quality ' || quality AS body, doc_id AS id FROM labels
      UNION ALL SELECT 'bench-' || item_id, text, -1 - item_id FROM benchmark),
t AS (SELECT doc_id AS id, source AS title, 'doc-' || doc_id AS slug, text AS body FROM documents)
SELECT coalesce(t.id, s.id) AS id, {kept('t.title', "'revised'")} AS title, coalesce(t.slug, s.slug) AS slug,
       md5(coalesce(s.body, t.body)) AS body, {kept('CAST(NULL AS VARCHAR)', "'posted'")} AS source_path,
       CAST({kept('1', '2')} AS BIGINT) AS version,
       CASE WHEN s.id IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS updated_at
FROM t FULL JOIN s ON s.slug = t.slug"""


def _upsert_chunks(prune: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        target = ws.chunks(spark, sf_dir).select(
            "runbook_id", "chunk_index", "content", F.lit(None).cast("array<float>").alias("embedding"), "metadata"
        )
        source = A.table(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("runbook_id"),
            F.lit(0).alias("chunk_index"),
            F.concat(F.lit("revised "), F.col("quality").cast("string")).alias("content"),
            F.lit(None).cast("array<float>").alias("embedding"),
            F.lit(None).cast(target.schema["metadata"].dataType).alias("metadata"),
            F.lit(0).alias("batch_seq"),
        )
        merged = keyed.upsert_chunks(target, source, prune_stale=prune)
        return merged.select("runbook_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                             F.md5("content").alias("content"))

    return run


def _upsert_chunks_sql(prune: bool) -> str:
    stale = "AND runbook_id NOT IN (SELECT doc_id FROM labels)" if prune else ""
    return sql(f"""
SELECT runbook_id, chunk_index, md5(content) AS content FROM m_chunks
WHERE NOT (chunk_index = 0 AND runbook_id IN (SELECT doc_id FROM labels)) {stale}
UNION ALL SELECT doc_id, 0, md5('revised ' || quality) FROM labels""")


def apply_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events posted as deployments with some fields left out."""
    no = F.col("event_id")
    rows = A.table(spark, sf_dir, "events").select(
        F.when(no % 3 == 0, F.concat(F.lit("given-"), no.cast("string"))).alias("id"),
        F.col("user_id").alias("service_id"),
        no.alias("event_id"),
        F.when(no % 2 == 0, F.lit("staging")).alias("environment"),
        F.when(no % 5 == 0, F.col("props")).alias("metadata"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return keyed.apply_defaults(rows, ["service_id", "event_id"], as_of)


DEFAULTS_SQL = """
SELECT CASE WHEN event_id % 3 = 0 THEN 'given-' || event_id ELSE sha256(user_id || '/' || event_id) END AS id,
       user_id AS service_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'staging' ELSE 'production' END AS environment,
       CASE WHEN event_id % 5 = 0 THEN props ELSE '{}' END AS metadata, TIMESTAMP '2024-02-01' AS created_at
FROM events"""


def check_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as several tables that break each kind of rule somewhere."""
    e = A.table(spark, sf_dir, "events")
    no, value = F.col("event_id"), F.col("value")
    service = F.col("user_id").alias("service_id")
    tables = {
        "services": A.table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.when(F.col("s_acctbal") < 0, None).otherwise("supplier").alias("description"),
            F.lit("high").alias("criticality"),
        ),
        "deployments": A.deployments(spark, sf_dir).withColumn(
            "version", F.concat(F.lit("v"), (F.col("id") % 5).cast("string"))
        ),
        "log_entries": e.select(
            no.alias("id"), service, F.col("ts").alias("timestamp"), F.col("event_type").alias("level"),
            F.col("props").alias("message"),
        ),
        "incidents": A.incidents(spark, sf_dir).withColumn(
            "severity", F.when(F.col("severity") != "sev4", F.col("severity"))
        ),
        "investigations": e.select(
            no.alias("id"), no.alias("incident_id"), F.lit("done").alias("status"), (value / 100).alias("confidence_score")
        ),
        "tool_calls": e.select(
            no.alias("id"), no.alias("investigation_id"), F.lit("success").alias("status"), (value - 50).alias("latency_ms")
        ),
    }
    return keyed.check_integrity(tables)


INTEGRITY_SQL = sql("""
, v AS (
SELECT 'services' AS table_name, 'not_null' AS rule, 'description' AS columns, count(*) AS rows FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'deployments', 'unique', 'service_id,version,environment', sum(n) FROM
  (SELECT count(*) AS n FROM m_deployments GROUP BY service_id, id % 5 HAVING count(*) > 1)
UNION ALL SELECT 'deployments', 'foreign_key', 'service_id', count(*) FROM m_deployments WHERE service_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'log_entries', 'enum', 'level', count(*) FROM events WHERE event_type NOT IN ('debug', 'info', 'warn', 'error', 'fatal')
UNION ALL SELECT 'log_entries', 'foreign_key', 'service_id', count(*) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'incidents', 'not_null', 'severity', count(*) FROM m_incidents WHERE severity = 'sev4'
UNION ALL SELECT 'incidents', 'foreign_key', 'service_id', count(*) FROM m_incidents WHERE service_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'investigations', 'enum', 'status', count(*) FROM events
UNION ALL SELECT 'investigations', 'range', 'confidence_score', count(*) FROM events WHERE value / 100 < 0 OR value / 100 > 1
UNION ALL SELECT 'investigations', 'foreign_key', 'incident_id', count(*) FROM events WHERE event_id NOT IN (SELECT id FROM m_incidents)
UNION ALL SELECT 'tool_calls', 'range', 'latency_ms', count(*) FROM events WHERE value - 50 < 0)
SELECT table_name, rule, columns, CAST(rows AS BIGINT) AS rows FROM v WHERE rows > 0""")


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posted batches over a store that knows the incidents' scenarios partly."""
    known = _scenarios(spark, sf_dir).filter(F.col("severity") == "sev1").select(
        F.regexp_replace("scenario_id", "sc-", "scenario-").alias("scenario_id")
    )
    tables = {
        "services": spark.createDataFrame([], ingest.SERVICES),
        "deployments": spark.createDataFrame([], ingest.DEPLOYMENTS),
        "incidents": spark.createDataFrame([], ingest.INCIDENTS).unionByName(known.distinct(), allowMissingColumns=True),
    }
    _, _, summary = ingest.ingest(tables, ws.typed_batches(spark, sf_dir))
    return summary


SUMMARY_SQL = sql("""
SELECT count(*) AS "insertedLogs", count(*) AS "insertedMetrics",
       count(*) FILTER (event_type = 'error' AND value >= 100) AS incidents FROM m_posted""")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    investigations = ws.investigations(spark, sf_dir)
    tables = {
        "investigations": investigations,
        "investigation_steps": ws.steps(spark, sf_dir),
        "tool_calls": ws.tool_calls(spark, sf_dir),
    }
    left = keyed.cascade_delete(tables, "investigations", investigations.filter(F.col("status") == "failed"))
    return _union([df.select(F.lit(name).alias("table_name"), "id") for name, df in left.items()])


CASCADE_SQL = sql("""
, kept AS (SELECT id FROM m_investigations WHERE status = 'completed')
SELECT 'investigations' AS table_name, id FROM kept
UNION ALL SELECT 'investigation_steps', investigation_id || '/' || step_index FROM m_steps
  WHERE investigation_id IN (SELECT id FROM kept)
UNION ALL SELECT 'tool_calls', id FROM m_calls WHERE investigation_id IN (SELECT id FROM kept)""")


def streamed_log(spark: SparkSession, sf_dir: str) -> ChangeLog:
    """The posted folder streamed into a store."""

    def run() -> ChangeLog:
        log = ChangeLog(spark, scratch_path(spark, "store"))
        stream_ingest(spark, ws.posted_folder(spark, sf_dir), log, scratch_path(spark, "ingest"), signal=("view", 100.0)).awaitTermination()
        return log

    return ws.once(spark, sf_dir, "streamed_store", run)


def stream_ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the store that the posted folder was streamed into, with what it says."""
    log = streamed_log(spark, sf_dir)
    services = materialize(log.current("services"), "streamed-services")
    names = service_names(services)

    def rows(df: DataFrame, table: str, label: str, at: str, *content: str) -> DataFrame:
        shown = df.select(
            F.lit(table).alias("table_name"), "service_id", F.col(label).alias("label"),
            F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.concat_ws("|", *content).alias("content"),
            F.col("id").alias("_id"),
        )
        return lookup_join(shown, names, ["service_id"], spread=["_id"]).drop("service_id", "_id")

    deployment = F.coalesce("deployment_id", F.lit("none")) == "none"
    logs = log.facts("log_entries").withColumn("json", F.to_json("attributes")).withColumn("bare", deployment.cast("string"))
    metrics = log.facts("metric_points").withColumn("json", F.to_json("attributes"))
    metrics = metrics.withColumn("metric_value", F.round("metric_value", 6))
    incidents = log.current("incidents").withColumn("json", F.to_json("metadata"))
    own = services.select(
        F.lit("services").alias("table_name"), F.col("name").alias("label"), F.lit(None).cast("string").alias("at"),
        F.concat_ws("|", "id", "display_name", "description", "owner_team", "runtime", "criticality").alias("content"),
        F.col("name").alias("service_name"),
    )
    return _union([
        own,
        rows(log.current("deployments"), "deployments", "version", "deployed_at", "id", "commit_sha", "deployed_by", "environment", "status"),
        rows(incidents, "incidents", "scenario_id", "detected_at", "id", "title", "severity", "status", "detection_reason", "suspected_root_cause", "json"),
        rows(logs, "log_entries", "level", "timestamp", "message", "bare", "json"),
        rows(metrics, "metric_points", "metric_name", "timestamp", "metric_value", "unit", "json"),
    ])


# Of the posted rows of a key the last one counts, or the first; batches are ordered by their time.
STREAM_INGEST_SQL = sql("""
, posted AS (SELECT *, max(stamp) OVER (PARTITION BY batch_id) AS generated,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS shown, CAST(json(props) AS VARCHAR) AS json,
    'v' || (event_id % 5) AS version FROM m_posted),
deployed AS (SELECT * FROM posted WHERE event_type = 'signup'
  QUALIFY row_number() OVER (PARTITION BY service, version ORDER BY generated DESC, event_id DESC) = 1),
raised AS (SELECT * FROM posted WHERE event_type = 'error' AND value >= 100
  QUALIFY row_number() OVER (PARTITION BY service ORDER BY generated, event_id) = 1)
SELECT DISTINCT 'services' AS table_name, service AS label, CAST(NULL AS VARCHAR) AS "at",
  concat_ws('|', sha256('service/' || service), 'Service ' || user_id, 'account service', 'team-' || (user_id % 7), 'jvm',
    ['low', 'medium', 'high', 'critical'][user_id % 4 + 1]) AS content, service AS service_name FROM posted
UNION ALL SELECT 'deployments', version, shown, concat_ws('|', sha256('deployment/' || sha256('service/' || service)
    || '/' || version || '/production'), sha1(CAST(event_id AS VARCHAR)), 'deploy-bot', 'production', 'succeeded'), service FROM deployed
UNION ALL SELECT 'incidents', 'scenario-' || user_id, shown, concat_ws('|', sha256('incident/scenario-' || user_id),
    'error value spike', 'sev2', 'detected', 'the value rose over the threshold of 100', 'unknown',
    '{"scenarioId":"scenario-' || user_id || '","affectedSignals":["value"],"synthetic":true}'), service FROM raised
UNION ALL SELECT 'log_entries', level, shown, concat_ws('|', event_type, 'true', json), service FROM posted
UNION ALL SELECT 'metric_points', event_type, shown, concat_ws('|', CAST(round(value, 6) AS VARCHAR), 'u', '{}'), service FROM posted""")


def kept_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of every service from the partials that ingest has kept."""
    log = streamed_log(spark, sf_dir)
    found = signals.kept_signals(log, log.current("services"))
    return found.withColumn("max_latency", F.round("max_latency", 6))


KEPT_SIGNALS_SQL = sql("""
SELECT sha256('service/' || service) AS service_id, service AS service_name,
  round(max(value) FILTER (event_type = 'view'), 6) AS max_latency, count(*) FILTER (level = 'error') AS errors,
  count(*) FILTER (event_type = 'view') AS n_metrics, min(ts) FILTER (event_type = 'view' AND value >= 100) AS first_breach
FROM m_posted GROUP BY 1, 2""")


def stream_episodes_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of the telemetry that was streamed into the store, streamed from there."""
    log = streamed_log(spark, sf_dir)

    def run() -> str:
        target = scratch_path(spark, "episodes")
        found = episodes.stored_signals(log, "view")
        episodes.stream_episodes(
            found, target, scratch_path(spark, "follow"), window="1 day", quiet="1 day", late="10 minutes", threshold=20.0
        ).awaitTermination()
        return target

    rows = episodes.latest_episodes(spark.read.schema(episodes.ROWS).parquet(ws.once(spark, sf_dir, "streamed_episodes", run)))
    closed = F.col("state") == "closed"
    return rows.select(
        "service_id", "state", F.col("started_at").cast("timestamp_ntz").alias("started_at"),
        F.col("ended_at").cast("timestamp_ntz").alias("ended_at"),
        *[F.when(closed, F.col(c)).alias(c) for c in ("peak", "errors", "windows")],
    )


# An open episode's figures are those of the trigger it opened in, so only its start is compared.
EPISODES_SQL = sql("""
, w AS (SELECT service, time_bucket(INTERVAL 1 DAY, ts) AS started, max(value) FILTER (event_type = 'view') AS peak,
    count(*) FILTER (level = 'error') AS errors FROM m_posted WHERE event_type = 'view' OR level = 'error' GROUP BY 1, 2),
mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS passed
  FROM m_posted WHERE event_type = 'view' OR level = 'error'),
b AS (SELECT service, started, started + INTERVAL 1 DAY AS ended, peak, errors, passed FROM w, mark
  WHERE started + INTERVAL 1 DAY <= passed AND coalesce(peak, 0) >= 20 AND errors > 0),
f AS (SELECT *, CASE WHEN started <= lag(ended) OVER (PARTITION BY service ORDER BY started) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS head FROM b),
g AS (SELECT *, sum(head) OVER (PARTITION BY service ORDER BY started) AS island FROM f),
e AS (SELECT service, min(started) AS started_at, max(ended) AS ended_at, max(peak) AS peak, sum(errors)::BIGINT AS errors,
    count(*) AS windows, max(ended) + INTERVAL 2 DAY < any_value(passed) AS done FROM g GROUP BY service, island)
SELECT sha256('service/' || service) AS service_id, CASE WHEN done THEN 'closed' ELSE 'open' END AS state, started_at,
  CASE WHEN done THEN ended_at END AS ended_at, CASE WHEN done THEN peak END AS peak, CASE WHEN done THEN errors END AS errors,
  CASE WHEN done THEN windows END AS windows FROM e""")


def stream_detect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals per service and hour, streamed; the windows the watermark has closed."""

    def run() -> str:
        target = scratch_path(spark, "windows")
        schema = A.table(spark, sf_dir, "events").schema
        events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
        metrics = events.select(
            F.col("user_id").alias("service_id"), F.col("ts").alias("timestamp"),
            F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"),
        )
        logs = events.select(
            F.col("user_id").alias("service_id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("level")
        )
        stream_detect(
            signal_rows(metrics, logs, "view"), target, scratch_path(spark, "detect"),
            window="6 hours", late="10 minutes", threshold=20.0,
        ).awaitTermination()
        return target

    return spark.read.parquet(ws.once(spark, sf_dir, "streamed_windows", run))


STREAM_DETECT_SQL = """
WITH s AS (SELECT user_id AS service_id, time_bucket(INTERVAL 6 HOUR, ts) AS window_start,
       max(value) FILTER (event_type = 'view') AS max_latency, count(*) FILTER (event_type = 'error') AS errors
  FROM events WHERE event_type IN ('view', 'error') GROUP BY 1, 2),
mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS passed FROM events WHERE event_type IN ('view', 'error'))
SELECT service_id, window_start, window_start + INTERVAL 6 HOUR AS window_end, max_latency, errors
FROM s, mark WHERE window_start + INTERVAL 6 HOUR <= mark.passed AND coalesce(max_latency, 0) >= 20 AND errors > 0"""

QUERIES = {
    "telemetry_source": (telemetry_source, TELEMETRY_SQL),
    "logs_source": (logs_source, LOGS_SQL),
    "validate_contract": (validate_contract, VALIDATE_SQL),
    "reject_batches": (reject_batches, REJECT_SQL),
    "resolve_service": (
        resolve_service,
        f"SELECT event_id AS id, c_custkey AS service_id FROM events JOIN customer ON c_name = {NAME}",
    ),
    "unknown_services": (
        unknown_services,
        f"SELECT {NAME} AS service_name, count(*) AS rows FROM events WHERE {NAME} NOT IN (SELECT c_name FROM customer) GROUP BY 1",
    ),
    "resolve_deployment": (
        resolve_deployment,
        """WITH d AS (SELECT user_id, 'v' || (event_id % 5) AS version, min(event_id) AS id
             FROM events WHERE event_type = 'signup' GROUP BY ALL)
           SELECT event_id AS id, d.id AS deployment_id FROM events e
           LEFT JOIN d ON d.user_id = e.user_id AND d.version = 'v' || (e.event_id % 7)""",
    ),
    "upsert_services": (upsert_services, UPSERT_SERVICES_SQL),
    "upsert_deployments": (upsert_deployments, UPSERT_DEPLOYMENTS_SQL),
    "append_metrics": (append_metrics, APPEND_METRICS_SQL),
    "append_logs": (append_logs, APPEND_LOGS_SQL),
    "insert_absent_incidents": (insert_absent_incidents, INSERT_ABSENT_SQL),
    "upsert_runbooks": (_upsert_runbooks(False), _upsert_runbooks_sql(False)),
    "upsert_runbooks_body_only": (_upsert_runbooks(True), _upsert_runbooks_sql(True)),
    "upsert_chunks": (_upsert_chunks(False), _upsert_chunks_sql(False)),
    "upsert_chunks_pruned": (_upsert_chunks(True), _upsert_chunks_sql(True)),
    "apply_defaults": (apply_defaults, DEFAULTS_SQL),
    "check_integrity": (check_integrity, INTEGRITY_SQL),
    "ingest_summary": (ingest_summary, SUMMARY_SQL),
    "cascade_delete": (cascade_delete, CASCADE_SQL),
    "stream_ingest": (stream_ingest_rows, STREAM_INGEST_SQL),
    "kept_signals": (kept_signals, KEPT_SIGNALS_SQL),
    "stream_episodes": (stream_episodes_rows, EPISODES_SQL),
    "stream_detect": (stream_detect_rows, STREAM_DETECT_SQL),
}
