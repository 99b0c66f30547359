"""Common table expressions of the comparison SQL; a query gets those it names."""

from __future__ import annotations

import re

from faultline.functions.text import SPACE

WINDOW = "l.timestamp BETWEEN i.started_at - INTERVAL 1 DAY AND i.detected_at + INTERVAL 6 HOUR"
LEVEL = (
    "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' "
    "WHEN 'view' THEN 'debug' ELSE 'info' END"
)
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"

CTES: dict[str, str] = {
    "m_services": """
        SELECT c_custkey AS id, c_name AS name, 'Service ' || c_custkey AS display_name,
               c_mktsegment || ' account service' AS description,
               'nation-' || c_nationkey AS owner_team, lower(c_mktsegment) AS runtime,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'critical' WHEN 'AUTOMOBILE' THEN 'high'
                    WHEN 'MACHINERY' THEN 'medium' ELSE 'low' END AS criticality
        FROM customer""",
    "m_logs": f"""
        SELECT event_id AS id, user_id AS service_id, ts AS timestamp, {LEVEL} AS level,
               event_type AS message, props AS attributes FROM events""",
    "m_metrics": """
        SELECT event_id AS id, user_id AS service_id, ts AS timestamp, event_type AS metric_name,
               value AS metric_value, 'u' AS unit FROM events""",
    "m_deployments": """
        SELECT event_id AS id, user_id AS service_id, 'v' || event_id AS version,
               CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'rolled_back' ELSE 'succeeded' END AS status,
               ts AS deployed_at, props AS metadata FROM events WHERE event_type = 'signup'""",
    "m_incidents": """
        SELECT event_id AS id, user_id AS service_id, 'error value spike in ' || event_type AS title,
               CASE WHEN value >= 200 THEN 'sev1' WHEN value >= 150 THEN 'sev2'
                    WHEN value >= 120 THEN 'sev3' ELSE 'sev4' END AS severity,
               'detected' AS status, ts AS detected_at, ts AS started_at,
               'the value rose over the threshold of 100' AS detection_reason,
               CAST(NULL AS VARCHAR) AS suspected_root_cause, props AS metadata
        FROM events WHERE event_type = 'error' AND value >= 100""",
    "m_incident_logs": f"""
        SELECT * FROM (
          SELECT i.id AS incident_id, l.id, l.timestamp, l.level, l.message, l.attributes,
                 row_number() OVER (PARTITION BY i.id ORDER BY l.timestamp, l.id) AS rank
          FROM m_incidents i JOIN m_logs l ON l.service_id = i.service_id AND {WINDOW})
        WHERE rank <= 80""",
    "m_incident_metrics": f"""
        SELECT i.id AS incident_id, l.metric_name, l.unit, min(l.metric_value) AS min,
               max(l.metric_value) AS max, round(avg(l.metric_value), 6) AS avg, count(*) AS samples
        FROM m_incidents i JOIN m_metrics l ON l.service_id = i.service_id AND {WINDOW}
        GROUP BY ALL""",
    "m_incident_deployments": """
        SELECT * FROM (
          SELECT i.id AS incident_id, d.id, d.version, d.status, d.deployed_at,
                 row_number() OVER (PARTITION BY i.id ORDER BY d.deployed_at DESC, d.id DESC) AS rank
          FROM m_incidents i JOIN m_deployments d
            ON d.service_id = i.service_id AND d.deployed_at <= i.detected_at + INTERVAL 6 HOUR)
        WHERE rank <= 5""",
    # Chunking: lines are trimmed, headings get a marker, sentences are packed by a fold.
    "m_lines": f"""
        SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
                 lambda l: regexp_replace(l, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda l: l <> '') AS ls
        FROM documents""",
    "m_marked": f"""
        SELECT doc_id, list_reduce(list_prepend('', list_transform(ls, lambda l, i: CASE
                 WHEN i > 1 AND (regexp_matches(l, '^(#{{1,3}}{SPACE}|[A-Z][A-Za-z0-9 /-]{{2,}}:)')
                   OR (i < len(ls) AND regexp_matches(l, '^#{{1,3}}$'))) THEN chr(1) || l
                 WHEN i > 1 THEN chr(10) || l ELSE l END)), lambda a, b: a || b) AS body
        FROM m_lines""",
    "m_sections": """
        SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) AS no
        FROM (SELECT doc_id, list_filter(string_split(body, chr(1)), lambda s: s <> '') AS parts FROM m_marked)""",
    "m_packed": f"""
        SELECT doc_id, no, CASE WHEN length(content) <= 900
                 THEN {{'done': []::VARCHAR[], 'open': content}}
                 ELSE list_reduce(
                   list_prepend({{'done': []::VARCHAR[], 'open': ''}}, list_transform(
                     string_split(regexp_replace(content, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)),
                     lambda x: {{'done': []::VARCHAR[], 'open': x}})),
                   lambda a, b: CASE WHEN a.open = '' THEN {{'done': a.done, 'open': b.open}}
                     WHEN length(a.open) + 1 + length(b.open) > 900
                       THEN {{'done': list_append(a.done, a.open), 'open': b.open}}
                     ELSE {{'done': a.done, 'open': a.open || ' ' || b.open}} END) END AS r
        FROM m_sections""",
    "m_pieces": """
        SELECT doc_id, no, unnest(parts) AS content, generate_subscripts(parts, 1) AS piece
        FROM (SELECT doc_id, no, list_filter(list_append(r.done, r.open), lambda s: s <> '') AS parts FROM m_packed)""",
    "m_chunks": """
        SELECT doc_id AS runbook_id,
               row_number() OVER (PARTITION BY doc_id ORDER BY no, piece) - 1 AS chunk_index, content
        FROM m_pieces""",
    # Distinct posted services and batches.
    "m_posted": f"""
        SELECT event_id // 100 AS batch_id, event_id, event_id % 100 AS place, user_id,
               'svc-' || user_id AS service, ts, {ISO} AS stamp, {LEVEL} AS level, event_type, value, props
        FROM events""",
    # State of the investigations.
    "m_bundle": """
        SELECT i.id AS incident_id, i.detected_at, s.name AS service_name, i.title,
               (SELECT count(*) FROM m_incident_logs x WHERE x.incident_id = i.id) AS n_logs,
               (SELECT count(*) FROM m_incident_metrics x WHERE x.incident_id = i.id) AS n_metrics,
               (SELECT count(*) FROM m_incident_deployments x WHERE x.incident_id = i.id) AS n_deployments,
               (SELECT min(x.version) FROM m_incident_deployments x WHERE x.incident_id = i.id AND x.rank = 1) AS version
        FROM m_incidents i JOIN m_services s ON s.id = i.service_id""",
    "m_calls": """
        SELECT 'inv-' || incident_id AS investigation_id, incident_id, t.tool_index, t.tool_name,
               'inv-' || incident_id || '/' || t.tool_name AS id,
               CASE WHEN failed = t.tool_index THEN 'error' ELSE 'success' END AS status,
               (incident_id * 7 + t.tool_index * 13) % 400 + 5 AS latency_ms,
               CASE WHEN failed = t.tool_index THEN NULL ELSE
                 [n_logs, n_metrics, n_deployments, 5][t.tool_index] END AS result_count,
               detected_at + to_milliseconds(list_sum(list_transform(range(1, t.tool_index + 1),
                 lambda j: (incident_id * 7 + j * 13) % 400 + 5))::BIGINT) AS created_at
        FROM (SELECT *, CASE incident_id % 25 WHEN 24 THEN 4 WHEN 23 THEN 2 END AS failed FROM m_bundle)
        JOIN (VALUES (1, 'query_logs'), (2, 'query_metrics'), (3, 'get_deployments'), (4, 'search_runbooks'))
             t(tool_index, tool_name) ON failed IS NULL OR t.tool_index <= failed""",
    "m_answers": """
        SELECT b.incident_id, c.investigation_id, c.created_at AS tools_at,
               c.created_at + to_milliseconds(1000 + b.incident_id % 2000) AS answered_at,
               CASE WHEN b.incident_id % 25 = 22 THEN 'model offline' END AS call_error,
               CASE WHEN b.incident_id % 25 = 22 THEN 'call' WHEN b.incident_id % 10 = 0 THEN 'json'
                    WHEN b.incident_id % 10 = 1 THEN 'confidence'
                    WHEN b.incident_id % 10 IN (2, 3) THEN 'evidence' WHEN b.incident_id % 10 = 4 THEN 'summary' END AS reason,
               0.2 * (3 + CASE WHEN n_deployments > 0 THEN 1 ELSE 0 END) + 0.0875 AS confidence,
               CAST(3 + CASE WHEN n_deployments > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_evidence,
               b.title || ' at ' || b.service_name || ': ' || n_logs || ' logs and ' || n_metrics
                 || ' metric series in the window.' AS summary,
               CASE WHEN n_deployments > 0 THEN 'Deployment ' || b.version || ' preceded the incident.'
                    ELSE 'No deployment preceded the incident.' END AS cause
        FROM m_bundle b JOIN m_calls c ON c.incident_id = b.incident_id
        WHERE c.tool_index = 4 AND c.status = 'success'""",
    "m_investigations": """
        SELECT 'inv-' || i.id AS id, i.id AS incident_id, i.service_id, i.title AS incident_title,
               CASE WHEN f.incident_id IS NOT NULL OR a.reason IS NOT NULL THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN i.id % 2 = 0 THEN 'ollama' ELSE 'gemini' END AS provider,
               'model-' || (i.id % 3) AS model, 'incident-investigation-v1' AS prompt_version,
               CASE WHEN i.id % 3 <> 0 THEN 'trace/' || i.id END AS trace_id,
               i.detected_at AS started_at, coalesce(f.created_at, a.answered_at) AS completed_at,
               CASE WHEN a.incident_id IS NOT NULL AND a.reason IS NULL
                    THEN date_diff('millisecond', i.detected_at, a.answered_at) END AS latency_ms,
               CASE WHEN f.incident_id IS NOT NULL
                      THEN CASE f.tool_index WHEN 4 THEN 'search index offline' ELSE 'metric store offline' END
                    WHEN a.reason IS NOT NULL THEN coalesce(a.call_error, 'Invalid report: ' || a.reason) ELSE a.summary END AS summary,
               CASE WHEN a.reason IS NULL THEN a.cause END AS probable_root_cause,
               CAST(CASE WHEN a.reason IS NULL THEN round(a.confidence, 3) END AS DOUBLE) AS confidence,
               CASE WHEN a.reason IS NULL THEN a.n_evidence END AS n_evidence,
               i.detected_at AS created_at
        FROM m_incidents i
        LEFT JOIN (SELECT * FROM m_calls WHERE status = 'error') f ON f.incident_id = i.id
        LEFT JOIN m_answers a ON a.incident_id = i.id""",
    "m_steps": """
        SELECT investigation_id, CAST(tool_index AS BIGINT) AS step_index, 'tool_call' AS step_type, tool_name AS title, created_at
        FROM m_calls WHERE status = 'success'
        UNION ALL SELECT investigation_id, 5, 'prompt', 'Build structured investigation prompt', tools_at FROM m_answers
        UNION ALL SELECT investigation_id, 6, CASE WHEN reason IS NULL THEN 'final' ELSE 'observation' END,
               CASE WHEN reason IS NULL THEN 'Investigation report' ELSE 'Invalid model response' END, answered_at
        FROM m_answers WHERE call_error IS NULL""",
}

NAMES = re.compile(r"\bm_[a-z_]+\b")


def sql(body: str) -> str:
    """``body`` with the expressions it needs, in order of definition.

    A body may open with a comma and further expressions of its own.
    """
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in set(NAMES.findall(text)) & set(CTES):
            if name not in needed:
                needed.add(name)
                need(CTES[name])

    need(body)
    parts = [f"{name} AS ({text})" for name, text in CTES.items() if name in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body
