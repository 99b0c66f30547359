"""Registered queries: investigations, observability tables, dashboard read models."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.catalog import workspace as ws
from faultline.catalog.analytics import RANKED
from faultline.catalog.sqltext import sql
from faultline.functions.text import SPACE
from faultline.plans import investigate as inv
from faultline.plans import observe, readmodel
from faultline.session import sorted_join
from faultline.sources import adapters as A

# --- investigations -------------------------------------------------------------------


def _count(column: str):
    return F.size(column).cast("long")


def evidence_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.bundle(spark, sf_dir).select(
        "incident_id",
        F.col("incident.serviceName").alias("service_name"),
        _count("logs").alias("n_logs"),
        F.array_join(F.transform("logs", lambda x: x["id"].cast("string")), ",").alias("log_ids"),
        F.array_join(F.transform("metrics", lambda x: x["metricName"]), ",").alias("metric_names"),
        F.array_join(F.transform("deployments", lambda x: x["version"]), ",").alias("versions"),
        _count("runbooks").alias("n_runbooks"),
    )


BUNDLE_SQL = sql("""
SELECT b.incident_id, service_name, n_logs,
  (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FROM m_incident_logs x WHERE x.incident_id = b.incident_id) AS log_ids,
  (SELECT string_agg(metric_name, ',' ORDER BY metric_name) FROM m_incident_metrics x WHERE x.incident_id = b.incident_id) AS metric_names,
  coalesce((SELECT string_agg(version, ',' ORDER BY rank) FROM m_incident_deployments x WHERE x.incident_id = b.incident_id), '') AS versions,
  CAST(5 AS BIGINT) AS n_runbooks FROM m_bundle b""")


def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with their parts read back out of the JSON."""
    made = inv.build_prompts(ws.bundle(spark, sf_dir))
    user = F.element_at("messages", 2)["content"]
    return made.select(
        "incident_id",
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.get_json_object(user, "$.task").alias("task"),
        F.get_json_object(user, "$.incident.serviceName").alias("service_name"),
        F.json_array_length(F.get_json_object(user, "$.relevantLogs")).cast("long").alias("n_logs"),
        F.json_array_length(F.get_json_object(user, "$.metricSummaries")).cast("long").alias("n_metrics"),
        F.json_array_length(F.get_json_object(user, "$.deploymentHistory")).cast("long").alias("n_deployments"),
        F.json_array_length(F.get_json_object(user, "$.constraints")).cast("long").alias("n_constraints"),
        (F.col("prompt_text").startswith("system: ") & F.col("prompt_text").contains("\n\nuser: {")).alias("joined"),
    )


def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundle = ws.bundle(spark, sf_dir)
    versions = F.transform("deployments", lambda d: d["version"])
    slugs = F.transform("runbooks", lambda r: r["slug"])
    made = inv.summary_prompt(F.col("incident.title"), versions, slugs)
    return bundle.select("incident_id", F.element_at(made, 2)["content"].alias("content"))


SUMMARY_PROMPT_SQL = sql(f"""{RANKED},
books AS (SELECT incident_id, string_agg('- doc-' || split_part(chunk_id, '#', 1), chr(10) ORDER BY rank) AS slugs
  FROM asked JOIN ranked USING (question) WHERE rank <= 5 GROUP BY 1)
SELECT b.incident_id, 'Investigate this incident for the company.' || chr(10) || chr(10) || 'Incident summary:' || chr(10) || title
  || chr(10) || chr(10) || 'Evidence:' || chr(10) || coalesce((SELECT string_agg('- ' || version, chr(10) ORDER BY rank)
     FROM m_incident_deployments x WHERE x.incident_id = b.incident_id), '- None provided')
  || chr(10) || chr(10) || 'Runbook context:' || chr(10) || coalesce(k.slugs, '- None provided') || chr(10) || chr(10)
  || 'Return: probable root cause, confidence, supporting evidence, and missing information.' AS content
FROM m_bundle b LEFT JOIN books k ON k.incident_id = b.incident_id""")


def build_eval_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = A.incidents(spark, sf_dir).select(
        F.col("id").alias("incident_id"), F.col("detection_reason").alias("expected_finding")
    )
    actual = ws.investigations(spark, sf_dir).select("incident_id", F.col("summary").alias("actual_finding"))
    made = inv.build_eval_prompts(expected, actual)
    return made.select("incident_id", F.element_at("messages", 2)["content"].alias("content"))


EVAL_SQL = sql("""
SELECT incident_id, 'Evaluate the investigation output.' || chr(10) || chr(10) || 'Expected finding:' || chr(10)
  || 'the value rose over the threshold of 100' || chr(10) || chr(10) || 'Actual finding:' || chr(10) || summary
  || chr(10) || chr(10) || 'Return JSON with score from 0 to 1 and a short rationale.' AS content FROM m_investigations""")


def template_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports written from the evidence alone, checked like any model answer."""
    checked = inv.validate_reports(inv.template_report(ws.bundle(spark, sf_dir)))
    return checked.select(
        "incident_id",
        F.col("report").isNotNull().alias("valid"),
        F.col("report.summary").alias("summary"),
        F.col("report.probableRootCause").alias("cause"),
        F.round("report.confidence", 6).alias("confidence"),
        _count("report.evidence").alias("n_evidence"),
    )


TEMPLATE_SQL = sql("""
SELECT incident_id, TRUE AS valid, title || ' at ' || service_name || ': ' || n_logs || ' logs and ' || n_metrics
    || ' metric series in the window.' AS summary,
  CASE WHEN n_deployments > 0 THEN 'Deployment ' || version || ' preceded the incident.'
    ELSE 'No deployment preceded the incident.' END AS cause,
  CAST(round(0.6875 + CASE WHEN n_deployments > 0 THEN 0.2 ELSE 0 END, 6) AS DOUBLE) AS confidence,
  CAST(3 + CASE WHEN n_deployments > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_evidence FROM m_bundle""")


MODEL_ERROR = ws.CALL_ERROR


def _read_service(batch: pd.DataFrame, temperature: float, max_tokens: int) -> pd.Series:
    if (batch["incident_id"] % 25 == 22).any():  # the incidents of ``ws.call_failed``
        raise RuntimeError(MODEL_ERROR)
    asked = batch["prompt_text"].str.split("\n\nuser: ", n=1).str[1]
    return asked.map(lambda text: json.loads(text)["incident"]["serviceName"])


def batch_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in model that answers with the service name it reads in the prompt, or raises."""
    return inv.batch_generate(ws.prompts(spark, sf_dir), _read_service).drop("duration_ms")


def validate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = inv.validate_reports(ws.checked(spark, sf_dir).select("investigation_id", "response", "error_message"))
    return checked.select(
        "investigation_id",
        F.col("report").isNotNull().alias("valid"),
        F.array_join("reasons", ",").alias("reasons"),
        "error_message",
        F.round("report.confidence", 6).alias("confidence"),
    )


def capture_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inv.capture_invalid(ws.checked(spark, sf_dir))
    return rows.select(
        "investigation_id", F.col("step_index").cast("long").alias("step_index"), "step_type", "title",
        F.get_json_object("metadata", "$.parserError").alias("parser_error"), "created_at",
    )


CALL_COLUMNS = ("id", "investigation_id", "tool_name", "status", "latency_ms", "created_at")


def _calls(df: DataFrame) -> DataFrame:
    return df.select(*CALL_COLUMNS).withColumn("latency_ms", F.col("latency_ms").cast("long"))


def tool_call_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = inv.tool_call_ledger(
        ws.bundle(spark, sf_dir), F.col("incident.detectedAt"), ws.tool_latency, ws.tool_failures(spark, sf_dir)
    )
    failed = F.get_json_object("output", "$.error")
    asked = F.coalesce(F.get_json_object("input", "$.query"), F.get_json_object("input", "$.incidentId"))
    return sorted_join(_calls(made), made.select("id", failed.alias("error"), asked.alias("asked")), "id")


LEDGER_SQL = sql("""
SELECT c.id, investigation_id, tool_name, c.status, latency_ms, created_at,
  CASE WHEN c.status = 'error' THEN CASE tool_index WHEN 4 THEN 'search index offline' ELSE 'metric store offline' END END AS error,
  CASE WHEN tool_index = 4 THEN b.title || ' the value rose over the threshold of 100 ' || b.service_name
    ELSE CAST(c.incident_id AS VARCHAR) END AS asked
FROM m_calls c JOIN m_bundle b ON b.incident_id = c.incident_id""")


def tool_output_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.tool_output_summary(ws.tool_calls(spark, sf_dir))


def _steps(df: DataFrame) -> DataFrame:
    return df.select(
        "investigation_id", F.col("step_index").cast("long").alias("step_index"), "step_type", "title", "created_at"
    )


def step_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(
        inv.step_timeline(ws.tool_calls(spark, sf_dir), ws.prompts(spark, sf_dir), ws.checked(spark, sf_dir))
    )


STATE = "status, completed_at, latency_ms, summary, probable_root_cause"


def investigation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = ws.investigations(spark, sf_dir).select(F.col("id").alias("investigation_id"), "started_at")
    events = inv.investigation_events(started, ws.tool_calls(spark, sf_dir), ws.checked(spark, sf_dir))
    return _plain(inv.investigation_status(events), "confidence_score")


def _plain(df: DataFrame, confidence: str) -> DataFrame:
    return df.withColumns(
        {confidence: F.col(confidence).cast("double"), "latency_ms": F.col("latency_ms").cast("long")}
    )


def tool_calls_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(inv.tool_calls_list(ws.tool_calls(spark, sf_dir)))


def steps_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(inv.steps_list(ws.steps(spark, sf_dir)))


def extract_final_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inv.extract_final_report(ws.steps(spark, sf_dir))
    return found.select(
        "investigation_id", F.col("report.summary").alias("summary"),
        F.round("report.confidence", 6).alias("confidence"), _count("report.evidence").alias("n_evidence"),
    )


def investigation_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = ws.detail(spark, sf_dir)
    return _plain(
        detail.select(
            "id", "incident_id", "incident_title", "service_name", "status", "provider", "model",
            "prompt_version", "trace_id", "started_at", "completed_at", "latency_ms", "summary",
            "probable_root_cause", "confidence", "created_at",
            F.array_join(F.transform("tool_calls", lambda c: c["tool_name"]), ",").alias("tools"),
            F.array_join(F.transform("steps", lambda s: s["step_index"].cast("string")), ",").alias("steps"),
            _count("evidence").alias("n_evidence"),
            _count("recommended_next_diagnostics").alias("n_diagnostics"),
        ),
        "confidence",
    )


DETAIL_SQL = sql("""
SELECT v.id, v.incident_id, incident_title, s.name AS service_name, v.status, provider, model, prompt_version, trace_id,
  started_at, completed_at, latency_ms, summary, probable_root_cause, confidence, created_at,
  (SELECT string_agg(tool_name, ',' ORDER BY created_at) FROM m_calls c WHERE c.investigation_id = v.id) AS tools,
  coalesce((SELECT string_agg(CAST(step_index AS VARCHAR), ',' ORDER BY step_index) FROM m_steps c WHERE c.investigation_id = v.id), '') AS steps,
  coalesce(n_evidence, 0) AS n_evidence, CAST(v.status = 'completed' AS BIGINT) AS n_diagnostics
FROM m_investigations v JOIN m_services s ON s.id = v.service_id""")


def investigation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = inv.investigation_report(ws.detail(spark, sf_dir))
    return report.select(
        "investigation_id", "trace_id", "incident_id", "incident_title", "service_name", "status", "generated_at",
        "summary", "probable_root_cause", "confidence",
        F.array_join(F.transform("evidence", lambda e: e["source"]), ",").alias("sources"),
        _count("cited_runbooks").alias("n_cited"),
        F.aggregate("supporting_tool_calls", F.lit(0).cast("long"), lambda t, c: t + c["latency_ms"]).alias("tool_ms"),
    )


REPORT_SQL = sql("""
SELECT v.id AS investigation_id, trace_id, v.incident_id, incident_title, s.name AS service_name, v.status,
  coalesce(completed_at, created_at) AS generated_at, summary, probable_root_cause, confidence,
  CASE WHEN v.status <> 'completed' THEN '' WHEN n_evidence = 4 THEN 'metric,deployment,log,runbook' ELSE 'metric,log,runbook' END AS sources,
  CAST(v.status = 'completed' AS BIGINT) AS n_cited,
  (SELECT CAST(sum(latency_ms) AS BIGINT) FROM m_calls c WHERE c.investigation_id = v.id) AS tool_ms
FROM m_investigations v JOIN m_services s ON s.id = v.service_id""")


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = inv.report_text(inv.investigation_report(ws.detail(spark, sf_dir)))
    # The cited title is the document's source; everything else follows from the evidence.
    return made.select("investigation_id", F.regexp_replace("text", r"(?<=Cited runbooks\n)- .*", "- cited").alias("text"))


REPORT_TEXT_SQL = sql("""
SELECT v.id AS investigation_id, 'Investigation' || n || '=============' || n || 'Investigation: ' || v.id || n || 'Incident: ' || incident_title
  || n || 'Service: ' || s.name || n || 'Confidence: ' || coalesce(printf('%.2f', confidence), 'unknown') || n || n || 'Summary' || n || summary
  || n || n || 'Probable root cause' || n || coalesce(probable_root_cause, 'No root cause returned.') || n || n || 'Evidence' || n
  || CASE WHEN status <> 'completed' THEN '' ELSE '- [metric] Metric summary of the window.' || n
    || CASE WHEN n_evidence = 4 THEN '- [deployment] Deployed before the end of the window.' || n ELSE '' END
    || '- [log] Earliest log of the window.' || n || '- [runbook] Nearest runbook passage.' END
  || n || n || 'Cited runbooks' || n || CASE WHEN status = 'completed' THEN '- cited' ELSE '' END
  || n || n || 'Recommended next diagnostics' || n || CASE WHEN status = 'completed' THEN
    '- Compare the error logs of ' || s.name || ' with the previous day.' ELSE '' END AS text
FROM m_investigations v JOIN m_services s ON s.id = v.service_id, (SELECT chr(10) AS n)""")

# --- observability --------------------------------------------------------------------


def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ws.listed_incidents(spark, sf_dir).select(F.col("id").alias("incident_id"), "service_name")
    rows = observe.trace_rows(ws.investigations(spark, sf_dir), names, ws.steps(spark, sf_dir))
    return rows.withColumns(
        {
            "tags": F.array_join("tags", ","),
            "cited_runbooks": F.coalesce(_count("cited_runbooks"), F.lit(0)),
            "confidence_score": F.round("confidence_score", 6),
        }
    )


TRACE_SQL = sql("""
SELECT v.id, 'investigation.workflow' AS name, v.incident_id, s.name AS service_name, provider, model, prompt_version,
  'faultline,investigation,' || provider AS tags, date_diff('millisecond', started_at, completed_at) AS duration_ms,
  v.status = 'completed' AS success, v.status AS investigation_status,
  CAST(CASE WHEN v.status = 'completed' THEN round(0.0875 + 0.2 * n_evidence, 6) END AS DOUBLE) AS confidence_score,
  CAST(v.status = 'completed' AS BIGINT) AS cited_runbooks, n_evidence AS evidence_count,
  CASE WHEN v.status = 'failed' THEN summary END AS error_message
FROM m_investigations v JOIN m_services s ON s.id = v.service_id""")


def tool_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.tool_spans(ws.tool_calls(spark, sf_dir))


SPANS_SQL = sql("""
SELECT investigation_id AS trace_id, tool_name AS name, created_at - to_milliseconds(latency_ms) AS start_time,
  created_at AS end_time, latency_ms, status = 'success' AS success, result_count,
  CASE WHEN status = 'error' THEN 'Error' END AS error_name,
  CASE WHEN status = 'error' THEN 'ERROR' ELSE 'DEFAULT' END AS level,
  CASE WHEN status = 'error' THEN 'Tool call failed.' END AS status_message FROM m_calls""")


def generation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observe.generation_rows(ws.checked(spark, sf_dir))
    return rows.select(
        *[c for c in rows.columns if c not in ("output", "usage")],
        F.col("output").isNotNull().alias("answered"),
        F.col("usage")["input"].alias("input_tokens"),
        F.col("usage")["total"].alias("total_tokens"),
    )


GENERATION_SQL = sql("""
SELECT investigation_id AS trace_id, 'investigation.llm_generation' AS name, 'model-' || (incident_id % 3) AS model,
  CASE WHEN incident_id % 2 = 0 THEN 'ollama' ELSE 'gemini' END AS provider, tools_at AS start_time, answered_at AS end_time,
  1000 + incident_id % 2000 AS latency_ms, CAST(0.1 AS DOUBLE) AS temperature, reason IS NULL AS structured_output_success,
  CASE WHEN reason IS NULL THEN 'DEFAULT' ELSE 'ERROR' END AS level, coalesce(call_error, 'Invalid report: ' || reason) AS status_message,
  call_error IS NULL AS answered, CASE WHEN call_error IS NULL THEN 42 + incident_id % 10 END AS input_tokens,
  CASE WHEN call_error IS NULL THEN 42 + incident_id % 10 + 9 + incident_id % 5 END AS total_tokens FROM m_answers""")


def _model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as model calls."""
    e = A.table(spark, sf_dir, "events")
    no = F.col("event_id")
    tokens = no % 100
    usage = F.struct(
        tokens.alias("promptTokens"), F.lit(7).cast("long").alias("completionTokens"), (tokens + 7).alias("totalTokens")
    )
    return e.select(
        no.alias("call_id"),
        F.when(F.col("user_id") % 2 == 0, "ollama").otherwise("gemini").alias("provider"),
        F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        usage.alias("usage"),
        F.when(F.col("event_type") == "error", "LLMProviderError").alias("error_name"),
        "event_type", "value", "props",
    )


def llm_call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observe.llm_call_events(_model_calls(spark, sf_dir))
    return rows.withColumn("usage", F.col("usage.totalTokens")).withColumnRenamed("usage", "total_tokens")


MODEL_CALLS = """
WITH c AS (SELECT event_id AS call_id, CASE WHEN user_id % 2 = 0 THEN 'ollama' ELSE 'gemini' END AS provider,
  'model-' || (user_id % 3) AS model, CAST(floor(value * 10) AS BIGINT) AS duration_ms, event_type <> 'error' AS success,
  CASE WHEN event_type <> 'error' THEN event_id % 100 + 7 END AS total_tokens,
  CASE WHEN event_type = 'error' THEN 'LLMProviderError' END AS error_name, event_type, value, props FROM events)"""


def llm_call_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.llm_call_rollup(observe.llm_call_events(_model_calls(spark, sf_dir)))


ROLLUP_SQL = MODEL_CALLS + """
SELECT provider, model, count(*) AS calls, count(*) FILTER (NOT success) AS failures,
  round(count(*) FILTER (NOT success) / count(*), 6) AS failure_rate, quantile_disc(duration_ms, 0.5) AS p50_ms,
  quantile_disc(duration_ms, 0.95) AS p95_ms, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM c GROUP BY ALL"""

# Words and size of a trimmed text, as the estimate takes them.
TOKENS = (
    "CASE WHEN {t} = '' THEN 0 ELSE greatest(1, len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_''-]+')), "
    "CAST(ceil(length({t}) / 4.0) AS BIGINT)) END"
)
TRIMMED = f"regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')"


def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.prompt_tokens(A.messages(spark, sf_dir))


ESTIMATE_SQL = f"""
WITH m AS (SELECT conv_id, {TRIMMED} AS t FROM conversations)
SELECT conv_id, CAST(sum({TOKENS.format(t='t')} + 4) AS BIGINT) AS prompt_tokens FROM m GROUP BY 1"""


def normalize_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn as a call whose prompt is the rest of its conversation."""
    m = A.messages(spark, sf_dir)
    prompt = observe.prompt_tokens(m.filter(F.col("role") != "assistant"))
    conv, turn = F.col("conv_id"), F.col("turn")
    calls = m.filter(F.col("role") == "assistant").join(prompt, "conv_id", "left").select(
        "conv_id",
        "turn",
        F.when(conv % 2 == 0, "ollama").otherwise("gemini").alias("provider"),
        F.when((conv + turn) % 3 != 0, 40 + turn).alias("reported_prompt"),
        F.when((conv + turn) % 5 != 0, 10 + turn).alias("reported_completion"),
        F.when(conv % 4 == 1, F.lit(99).cast("long")).alias("reported_total"),
        F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
        F.col("content").alias("completion"),
    )
    return observe.normalize_usage(calls).select(
        "conv_id", "turn", F.col("usage.promptTokens").alias("prompt"), F.col("usage.completionTokens").alias("completion"),
        F.col("usage.totalTokens").alias("total"), F.col("usage.estimated").alias("estimated"),
    )


USAGE_SQL = f"""
WITH m AS (SELECT conv_id, turn, role, {TRIMMED} AS t FROM conversations),
e AS (SELECT *, {TOKENS.format(t='t')} AS n FROM m),
p AS (SELECT conv_id, sum(n + 4) AS est FROM e WHERE role <> 'assistant' GROUP BY 1),
c AS (SELECT e.conv_id, turn, n, coalesce(est, 0) AS est, e.conv_id % 2 = 1 AS either,
    CASE WHEN (e.conv_id + turn) % 3 <> 0 THEN 40 + turn END AS rp, CASE WHEN (e.conv_id + turn) % 5 <> 0 THEN 10 + turn END AS rc,
    CASE WHEN e.conv_id % 4 = 1 THEN 99 END AS rt FROM e LEFT JOIN p USING (conv_id) WHERE role = 'assistant'),
k AS (SELECT *, CASE WHEN either AND (rp IS NOT NULL OR rc IS NOT NULL) THEN 'own'
    WHEN NOT either AND rp IS NOT NULL AND rc IS NOT NULL THEN 'both' ELSE 'est' END AS kind FROM c)
SELECT conv_id, turn, CAST(CASE kind WHEN 'est' THEN est ELSE coalesce(rp, 0) END AS BIGINT) AS prompt,
  CAST(CASE kind WHEN 'est' THEN n ELSE coalesce(rc, 0) END AS BIGINT) AS completion,
  CAST(CASE kind WHEN 'est' THEN est + n WHEN 'own' THEN coalesce(rt, coalesce(rp, 0) + coalesce(rc, 0)) ELSE rp + rc END AS BIGINT) AS total,
  kind = 'est' AS estimated FROM k"""


def classify_llm_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value, no = F.col("event_type"), F.col("value"), F.col("call_id")
    calls = _model_calls(spark, sf_dir).select(
        "call_id",
        "provider",
        (no % 11 != 0).alias("has_credential"),
        (value < 2).alias("aborted"),
        F.when(kind == "error", F.when(value >= 100, 404).otherwise(500))
        .when(kind == "click", F.lit(None))
        .otherwise(200)
        .alias("http_status"),
        F.when(no % 2 == 0, "Model is loading").otherwise(F.col("props")).alias("body"),
        (kind != "view").alias("parsed"),
    )
    return observe.classify_llm_errors(calls).select("call_id", "error_code")


CLASSIFY_SQL = MODEL_CALLS + """
SELECT call_id, CASE WHEN provider = 'gemini' AND call_id % 11 = 0 THEN 'provider_disabled' WHEN value < 2 THEN 'provider_timeout'
  WHEN event_type = 'click' THEN 'provider_unavailable'
  WHEN event_type = 'error' THEN CASE WHEN provider = 'ollama' AND (value >= 100 OR call_id % 2 = 0) THEN 'model_missing' ELSE 'provider_unavailable' END
  WHEN event_type = 'view' THEN 'bad_response' END AS error_code FROM c"""


def message_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and events read as messages: a role nobody has, a content that is empty."""
    e = A.table(spark, sf_dir, "events")
    read = e.select(
        F.col("user_id").alias("conv_id"),
        F.col("event_id").alias("turn"),
        F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "click", "assistant")
        .when(F.col("event_type") == "signup", "tool").otherwise("system").alias("role"),
        F.when(F.col("value") >= 1, F.col("props")).otherwise("").alias("content"),
    )
    return observe.message_violations(A.messages(spark, sf_dir).unionByName(read))


def conversation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.conversation_payload(A.messages(spark, sf_dir))


def system_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.system_instruction(A.messages(spark, sf_dir))


# --- read models ----------------------------------------------------------------------


def overview_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.overview_cards(
        A.incidents(spark, sf_dir), ws.investigations(spark, sf_dir), ws.tool_calls(spark, sf_dir)
    )


def incident_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.incident_board(ws.listed_incidents(spark, sf_dir), ws.investigations(spark, sf_dir))


BOARD_SQL = sql("""
SELECT i.id AS incident_id, s.name AS service_name, i.title, upper(i.severity) AS severity, i.status AS incident_status,
  'muted' AS incident_class, i.detected_at, coalesce(v.status, 'not started') AS investigation_status,
  CASE v.status WHEN 'completed' THEN 'success' WHEN 'failed' THEN 'error' ELSE 'muted' END AS investigation_class,
  coalesce(CAST(CAST(floor(v.confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%', '—') AS confidence
FROM m_incidents i JOIN m_services s ON s.id = i.service_id
LEFT JOIN m_investigations v ON v.incident_id = i.id""")


def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.timeline_rows(
        ws.investigations(spark, sf_dir), ws.tool_calls(spark, sf_dir), ws.steps(spark, sf_dir)
    )


TIMELINE_SQL = sql("""
, items AS (
SELECT investigation_id, tool_index AS ord, tool_name AS title, status, latency_ms, created_at FROM m_calls
UNION ALL SELECT s.investigation_id, 8, 'LLM', v.status, v.latency_ms, s.created_at
FROM m_steps s JOIN m_investigations v ON v.id = s.investigation_id WHERE step_type = 'final'
UNION ALL SELECT id, 9, 'Final report', status, latency_ms, completed_at FROM m_investigations)
SELECT investigation_id, row_number() OVER (PARTITION BY investigation_id ORDER BY ord) AS "index", title, status, latency_ms, created_at,
  CASE status WHEN 'failed' THEN 'error' WHEN 'completed' THEN 'success' ELSE 'muted' END AS status_class FROM items""")


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = inv.extract_final_report(ws.steps(spark, sf_dir))
    rows = readmodel.evidence_rows(reports, ws.tool_calls(spark, sf_dir))
    # Citation titles and quotes come from the search, which has its own query.
    cited = F.col("section") == 2
    return rows.select(
        "investigation_id", "section", "ordinal",
        F.when(~cited & ~F.col("title").startswith("runbook"), F.col("title")).alias("title"),
        F.when(~cited, F.col("summary")).alias("summary"),
    )


EVIDENCE_SQL = sql("""
, done AS (SELECT v.incident_id, v.id, v.n_evidence, b.version,
    (SELECT min(metric_name) FROM m_incident_metrics x WHERE x.incident_id = v.incident_id) AS metric,
    (SELECT min(id) FROM m_incident_logs x WHERE x.incident_id = v.incident_id AND rank = 1) AS log
  FROM m_investigations v JOIN m_bundle b ON b.incident_id = v.incident_id WHERE v.status = 'completed')
SELECT id AS investigation_id, CAST(1 AS BIGINT) AS section, CAST(0 AS BIGINT) AS ordinal, 'metric · ' || metric AS title, 'Metric summary of the window.' AS summary FROM done
UNION ALL SELECT id, 1, 1, 'deployment · ' || version, 'Deployed before the end of the window.' FROM done WHERE n_evidence = 4
UNION ALL SELECT id, 1, n_evidence - 2, 'log · ' || log, 'Earliest log of the window.' FROM done
UNION ALL SELECT id, 1, n_evidence - 1, NULL, 'Nearest runbook passage.' FROM done
UNION ALL SELECT id, 2, 0, NULL, NULL FROM done
UNION ALL SELECT investigation_id, 3, tool_index - 1, 'tool output · ' || tool_name, status || ' · ' || latency_ms || ' ms' FROM m_calls""")


def trace_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readmodel.trace_panel(
        ws.investigations(spark, sf_dir), ws.tool_calls(spark, sf_dir), "http://traces.example/", "demo"
    )
    return rows.withColumn("observations", F.col("observations").cast("long"))


PANEL_SQL = sql("""
SELECT v.id AS investigation_id, coalesce(trace_id, 'Disabled / unavailable') AS trace, coalesce(latency_ms || ' ms', '—') AS duration,
  1 + (SELECT count(*) FROM m_calls c WHERE c.investigation_id = v.id) AS observations, provider || ' / ' || model AS model,
  coalesce('http://traces.example/project/demo/traces/' || replace(trace_id, '/', '%2F'), 'unavailable') AS link FROM m_investigations v""")

ERROR_TEXT = "'Invalid report: ' || reason"
QUERIES = {
    "evidence_bundle": (evidence_bundle, BUNDLE_SQL),
    "build_prompts": (
        build_prompts,
        sql("""SELECT incident_id, 'system,user' AS roles, 'Investigate the incident and identify the most probable root cause.' AS task,
            service_name, n_logs, n_metrics, n_deployments, CAST(4 AS BIGINT) AS n_constraints, TRUE AS joined FROM m_bundle"""),
    ),
    "summary_prompts": (summary_prompts, SUMMARY_PROMPT_SQL),
    "build_eval_prompts": (build_eval_prompts, EVAL_SQL),
    "template_reports": (template_reports, TEMPLATE_SQL),
    "batch_generate": (
        batch_generate,
        sql("""SELECT a.incident_id, CASE WHEN call_error IS NULL THEN b.service_name END AS response,
            CASE WHEN call_error IS NOT NULL THEN 'RuntimeError' END AS error_name, call_error AS error_message
            FROM m_answers a JOIN m_bundle b ON b.incident_id = a.incident_id"""),
    ),
    "validate_reports": (
        validate_reports,
        sql("""SELECT investigation_id, reason IS NULL AS valid, call_error AS error_message,
            CASE WHEN call_error IS NULL THEN coalesce(reason, '') END AS reasons,
            CAST(CASE WHEN reason IS NULL THEN round(confidence, 6) END AS DOUBLE) AS confidence FROM m_answers"""),
    ),
    "capture_invalid": (
        capture_invalid,
        sql(f"""SELECT investigation_id, CAST(6 AS BIGINT) AS step_index, 'observation' AS step_type, 'Invalid model response' AS title,
            {ERROR_TEXT} AS parser_error, answered_at AS created_at FROM m_answers WHERE reason IS NOT NULL AND call_error IS NULL"""),
    ),
    "tool_call_ledger": (tool_call_ledger, LEDGER_SQL),
    "tool_output_summary": (
        tool_output_summary,
        sql("""SELECT id, investigation_id, tool_name, result_count,
            CASE WHEN status = 'error' THEN 'object' END AS result_type FROM m_calls"""),
    ),
    "step_timeline": (step_timeline, sql("SELECT * FROM m_steps")),
    "investigation_status": (
        investigation_status,
        sql(f"SELECT id AS investigation_id, started_at, {STATE}, confidence AS confidence_score FROM m_investigations"),
    ),
    "tool_calls_list": (tool_calls_list, sql(f"SELECT {', '.join(CALL_COLUMNS)} FROM m_calls")),
    "steps_list": (steps_list, sql("SELECT * FROM m_steps")),
    "extract_final_report": (
        extract_final_report,
        sql("""SELECT investigation_id, summary, CAST(round(confidence, 6) AS DOUBLE) AS confidence, n_evidence FROM m_answers WHERE reason IS NULL"""),
    ),
    "investigation_detail": (investigation_detail, DETAIL_SQL),
    "investigation_report": (investigation_report, REPORT_SQL),
    "report_text": (report_text, REPORT_TEXT_SQL),
    "trace_rows": (trace_rows, TRACE_SQL),
    "tool_spans": (tool_spans, SPANS_SQL),
    "generation_rows": (generation_rows, GENERATION_SQL),
    "llm_call_events": (
        llm_call_events,
        MODEL_CALLS + " SELECT call_id, provider, model, duration_ms, success, total_tokens, error_name FROM c",
    ),
    "llm_call_rollup": (llm_call_rollup, ROLLUP_SQL),
    "estimate_tokens": (estimate_tokens, ESTIMATE_SQL),
    "normalize_usage": (normalize_usage, USAGE_SQL),
    "classify_llm_errors": (classify_llm_errors, CLASSIFY_SQL),
    "message_violations": (
        message_violations,
        """SELECT user_id AS conv_id, event_id AS turn, 'role' AS field FROM events WHERE event_type = 'signup'
           UNION ALL SELECT user_id, event_id, 'content' FROM events WHERE value < 1
           UNION ALL SELECT conv_id, turn, 'content' FROM conversations WHERE coalesce(text, '') = ''""",
    ),
    "conversation_payload": (
        conversation_payload,
        """SELECT conv_id, CASE role WHEN 'system' THEN 'instruction' ELSE 'contents' END AS section, turn,
           CASE role WHEN 'system' THEN NULL WHEN 'assistant' THEN 'model' ELSE 'user' END AS role, text FROM conversations""",
    ),
    "system_instruction": (
        system_instruction,
        """SELECT conv_id, turn, text, TRUE AS has_instruction FROM conversations WHERE role = 'system'
           UNION ALL SELECT conv_id, NULL, NULL, FALSE FROM conversations
           GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0""",
    ),
    "overview_cards": (
        overview_cards,
        sql("""SELECT (SELECT count(*) FROM m_incidents) AS incidents,
            (SELECT max_by(title, detected_at) FROM m_incidents) AS hero_incident, (SELECT count(*) FROM m_investigations) AS investigations,
            (SELECT coalesce(CAST(CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%', '—')
             FROM m_investigations ORDER BY created_at DESC, id DESC LIMIT 1) AS confidence,
            (SELECT count(*) FROM m_calls) AS tool_calls"""),
    ),
    "incident_board": (incident_board, BOARD_SQL),
    "timeline_rows": (timeline_rows, TIMELINE_SQL),
    "evidence_rows": (evidence_rows, EVIDENCE_SQL),
    "trace_panel": (trace_panel, PANEL_SQL),
}
