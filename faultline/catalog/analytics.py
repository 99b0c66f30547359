"""Registered queries: look-ups, evidence, detection, text and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.catalog import workspace as ws
from faultline.catalog.sqltext import sql
from faultline.functions import embedding, text
from faultline.operators import detect, evidence, lookup, search
from faultline.plans import ingest, runbooks
from faultline.session import materialize, spread
from faultline.sources import adapters as A

# --- look-ups -------------------------------------------------------------------------


def service_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.service_list(A.services(spark, sf_dir))


def service_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and names as the orders and events mention them, and names nobody has."""
    ids = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"))
    names = A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("key")
    )
    nobody = A.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"))
    keys = ids.unionByName(names).unionByName(nobody)
    return lookup.service_lookup(A.services(spark, sf_dir), keys).select("key", "id", "name")


def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.log_search(
        A.log_entries(spark, sf_dir), A.services(spark, sf_dir),
        level="error", start="2024-01-05", end="2024-01-20", limit=1000,
    )


def log_search_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.log_search(
        A.log_entries(spark, sf_dir), A.services(spark, sf_dir), service="Customer#000000007", level=""
    )


def incident_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ws.listed_incidents(spark, sf_dir)


def incident_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All error events asked for by id; those that are incidents come back."""
    ids = A.table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id")
    )
    found = lookup.incident_lookup(
        A.incidents(spark, sf_dir), A.services(spark, sf_dir), ids, with_service_id=True
    )
    return found.select("id", "service_id", "service_name", "severity", "started_at")


def runbook_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in English stand for runbooks of a service."""
    owned = A.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", F.col("doc_id")).alias("service_id"),
        F.col("source").alias("title"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"),
        F.col("text").alias("body"),
    )
    return lookup.runbook_list(owned, A.services(spark, sf_dir)).withColumn("body", F.md5("body"))


def incident_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.incident_text_search(ws.listed_incidents(spark, sf_dir), "SEV2 detected Error", "sev2")
    return found.select("id", "service_name", "severity")


def incident_text_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.incident_text_search(ws.listed_incidents(spark, sf_dir)).select("id", "service_name")


# --- evidence -------------------------------------------------------------------------


def incident_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.incident_logs(
        A.incidents(spark, sf_dir), A.log_entries(spark, sf_dir), A.LOOKBACK, A.LOOKAHEAD
    )
    return found.drop("service_id")


def incident_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.incident_metric_summary(
        A.incidents(spark, sf_dir), A.metric_points(spark, sf_dir), A.LOOKBACK, A.LOOKAHEAD
    )
    return found.withColumn("avg", F.round("avg", 6))


def incident_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.incident_deployments(
        A.incidents(spark, sf_dir), A.deployments(spark, sf_dir), A.LOOKAHEAD
    )
    return found.select("incident_id", "id", "version", "status", "deployed_at", "rank")


def last_deployment_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.last_deployment_before(A.incidents(spark, sf_dir), A.deployments(spark, sf_dir))
    return found.select("incident_id", "deployment_id", "version", "deployed_at", "gap_seconds")


LAST_DEPLOYMENT_SQL = sql("""
, r AS (SELECT i.id AS incident_id, d.id AS deployment_id, d.version, d.deployed_at,
    date_diff('microsecond', d.deployed_at, i.started_at) / 1000000.0 AS gap_seconds,
    row_number() OVER (PARTITION BY i.id ORDER BY d.deployed_at DESC, d.id DESC) AS rn
  FROM m_incidents i JOIN m_deployments d ON d.service_id = i.service_id AND d.deployed_at <= i.started_at)
SELECT incident_id, deployment_id, version, deployed_at, CAST(gap_seconds AS DOUBLE) AS gap_seconds FROM r WHERE rn = 1""")


def incident_runbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runbooks.incident_runbooks(
        A.incidents(spark, sf_dir), A.services(spark, sf_dir), ws.chunks(spark, sf_dir), A.runbooks(spark, sf_dir)
    )
    return found.select("incident_id", "rank", "chunk_id", "slug", F.round("score", 6).alias("score"))


# Token counts per text and bucket; the fold runs over the characters of a token.
BUCKETS = """
tokens AS (SELECT k, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS token FROM texts),
hashed AS (SELECT token, list_reduce(list_prepend(0, list_transform(string_split(token, ''), lambda c: ascii(c))),
    lambda h, c: (h * 33 + c) % 768) AS bucket FROM (SELECT DISTINCT token FROM tokens)),
counts AS (SELECT k, bucket, count(*) AS n FROM tokens JOIN hashed USING (token) GROUP BY ALL),
norms AS (SELECT k, sum(n * n) AS square FROM counts GROUP BY 1)"""

NEAREST = """
dots AS (SELECT q.k AS q, i.k AS i, sum(q.n * i.n) AS dot FROM counts q JOIN counts i USING (bucket)
    WHERE q.k LIKE 'q%' AND i.k LIKE 'i%' GROUP BY ALL),
scored AS (SELECT q.k AS q, i.k AS i, coalesce(dot, 0) / sqrt(CAST(qn.square AS DOUBLE) * CAST(n.square AS DOUBLE)) AS score
  FROM (SELECT k FROM texts WHERE k LIKE 'q%') q CROSS JOIN (SELECT k FROM texts WHERE k LIKE 'i%') i
  LEFT JOIN dots d ON d.q = q.k AND d.i = i.k LEFT JOIN norms qn ON qn.k = q.k LEFT JOIN norms n ON n.k = i.k)"""

# Passages by nearness to each incident's question.
RANKED = f"""
, asked AS (SELECT i.id AS incident_id, i.title || ' ' || i.detection_reason || ' ' || s.name AS question
    FROM m_incidents i JOIN m_services s ON s.id = i.service_id),
texts AS (SELECT DISTINCT 'q' || question AS k, question AS t FROM asked
    UNION ALL SELECT 'i' || runbook_id || '#' || chunk_index, content FROM m_chunks),
{BUCKETS}, {NEAREST},
ranked AS (SELECT substr(q, 2) AS question, substr(i, 2) AS chunk_id, score, row_number() OVER (
    PARTITION BY q ORDER BY CASE WHEN score IS NULL THEN 2 ELSE round(1 - score, 6) END, substr(i, 2)) AS rank FROM scored)"""

INCIDENT_RUNBOOKS_SQL = sql(f"""{RANKED}
SELECT incident_id, rank, chunk_id, 'doc-' || split_part(chunk_id, '#', 1) AS slug, round(score, 6) AS score
FROM asked JOIN ranked USING (question) WHERE rank <= 5""")



@ws.stored("embedded_chunks")
def _embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table after an ingest."""
    return runbooks.ingest_runbooks(A.runbooks(spark, sf_dir), A.services(spark, sf_dir))[0]


def search_stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = runbooks.incident_queries(A.incidents(spark, sf_dir), A.services(spark, sf_dir))
    found = runbooks.search_stored_chunks(
        asked, _embedded_chunks(spark, sf_dir), A.runbooks(spark, sf_dir), A.services(spark, sf_dir)
    )
    return found.select(F.md5("text").alias("question"), "rank", "chunk_id", "slug", F.round("score", 6).alias("score"))


# Vectors as they are stored: 8 decimals, then single precision.
STORED_SQL = sql(f"""
, asked AS (SELECT DISTINCT i.title || ' ' || i.detection_reason || ' ' || s.name AS question
    FROM m_incidents i JOIN m_services s ON s.id = i.service_id),
texts AS (SELECT 'q' || question AS k, question AS t FROM asked
    UNION ALL SELECT 'i' || runbook_id || '#' || chunk_index, content FROM m_chunks),
{BUCKETS.replace("counts", "counted").replace("norms", "lengths")},
counts AS (SELECT k, bucket, CASE WHEN k LIKE 'i%' THEN CAST(CAST(round(n / sqrt(square), 8) AS FLOAT) AS DOUBLE) ELSE n END AS n
  FROM counted JOIN lengths USING (k)),
norms AS (SELECT k, sum(n * n) AS square FROM counts GROUP BY 1), {NEAREST},
ranked AS (SELECT substr(q, 2) AS question, substr(i, 2) AS chunk_id, score, row_number() OVER (
    PARTITION BY q ORDER BY CASE WHEN score IS NULL THEN 2 ELSE round(1 - score, 6) END, substr(i, 2)) AS rank FROM scored)
SELECT md5(question) AS question, rank, chunk_id, 'doc-' || split_part(chunk_id, '#', 1) AS slug, round(score, 6) AS score
FROM ranked WHERE rank <= 5""")

# --- detection ------------------------------------------------------------------------

THRESHOLD = 100.0


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.service_signals(
        A.services(spark, sf_dir), A.metric_points(spark, sf_dir), A.log_entries(spark, sf_dir), metric="view"
    )


def service_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).drop("fanout_errors", "n_metrics")


def service_signals_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("service_id", "fanout_errors")


def service_signals_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the order lines: suppliers as services, prices as the metric."""
    lines = A.table(spark, sf_dir, "lineitem")
    services = A.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    metrics = lines.select(
        F.col("l_suppkey").alias("service_id"), F.col("l_returnflag").alias("metric_name"),
        F.col("l_extendedprice").alias("metric_value"),
    )
    logs = lines.select(
        F.col("l_suppkey").alias("service_id"),
        F.when(F.col("l_linestatus") == "O", "error").otherwise("info").alias("level"),
    )
    return detect.service_signals(services, metrics, logs, metric="R")


def detect_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_incidents(_signals(spark, sf_dir), THRESHOLD).select(
        "service_id", "service_name", "max_latency", "errors"
    )


def detection_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detection_outcomes(_signals(spark, sf_dir), THRESHOLD)


@ws.stored("rules")
def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per metric: half its highest value; purchases count warnings as well."""
    metrics = A.metric_points(spark, sf_dir)
    levels = F.when(F.col("metric_name") == "purchase", F.array(F.lit("warn"), F.lit("error"))).otherwise(
        F.array(F.lit("error"), F.lit("fatal"))
    )
    return metrics.groupBy("metric_name").agg((F.max("metric_value") / 2).alias("threshold")).select(
        F.concat(F.lit("half-"), "metric_name").alias("rule_id"), "metric_name", "threshold", levels.alias("levels")
    )


def detect_with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics, logs = A.metric_points(spark, sf_dir), A.log_entries(spark, sf_dir)
    return detect.detect_with_rules(A.services(spark, sf_dir), metrics, logs, _rules(spark, sf_dir))


def detections_to_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected services as incidents, and how many logs the evidence around each has."""
    metrics, logs = A.metric_points(spark, sf_dir), A.log_entries(spark, sf_dir)
    found = detect.detect_incidents(_signals(spark, sf_dir), THRESHOLD)
    found = detect.with_times(found, metrics, logs, metric="view", threshold=THRESHOLD)
    # Scenarios of services whose error count is odd are stored already.
    shape = ingest.INCIDENTS.replace("service_id string", "service_id long")
    stored = detect.detections_to_incidents(
        found.filter(F.col("errors") % 2 == 1), spark.createDataFrame([], shape),
        F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), metric="view", threshold=THRESHOLD,
    )
    merged = materialize(
        detect.detections_to_incidents(found, stored, metric="view", threshold=THRESHOLD), "detected"
    )
    around = evidence.incident_logs(merged, logs, "1 MINUTE", "1 MINUTE").groupBy("incident_id").agg(F.count("*").alias("logs"))
    return merged.join(around, F.col("id") == F.col("incident_id"), "left").select(
        "id", "scenario_id", "service_id", "title", "severity", "started_at", "detected_at", "detection_reason",
        F.array_join("metadata.affectedSignals", ",").alias("signals"), F.coalesce("logs", F.lit(0)).alias("logs"),
    )


SIGNALS = """
, p AS (SELECT service_id, max(metric_value) AS max_latency, count(*) AS n FROM m_metrics WHERE metric_name = 'view' GROUP BY 1),
e AS (SELECT service_id, count(*) AS errors FROM m_logs WHERE level IN ('error', 'fatal') GROUP BY 1),
sig AS (SELECT s.id AS service_id, s.name AS service_name, max_latency, coalesce(errors, 0) AS errors,
    coalesce(n, 0) AS n_metrics FROM m_services s LEFT JOIN p ON p.service_id = s.id LEFT JOIN e ON e.service_id = s.id)
"""

# --- text and vectors -----------------------------------------------------------------


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(A.table(spark, sf_dir, "documents"))
    clean = docs.select("doc_id", text.normalize_text(F.col("text")).alias("body"))
    return clean.select("doc_id", F.md5("body").alias("body"), F.length("body").cast("long").alias("size"))


def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(A.table(spark, sf_dir, "documents"))
    parts = text.split_sections(text.normalize_text(F.col("text")))
    rows = docs.select("doc_id", F.posexplode(parts).alias("at", "section"))
    return rows.select(
        "doc_id", F.col("at").cast("long").alias("at"), F.md5("section").alias("section"),
        F.length("section").cast("long").alias("size"),
    )


def pack_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document as one section, cut into pieces of at most 300 characters."""
    docs = spread(A.table(spark, sf_dir, "documents")).select("doc_id", text.normalize_text(F.col("text")).alias("body"))
    rows = docs.select("doc_id", F.posexplode(text.pack_sentences(F.col("body"), 300)).alias("at", "piece"))
    return rows.filter(F.col("piece") != "").select(
        "doc_id", F.col("at").cast("long").alias("at"), F.md5("piece").alias("piece"),
        F.length("piece").cast("long").alias("size"),
    )


PACK_SQL = sql("""
, m_one AS (SELECT doc_id, 1 AS no, array_to_string(ls, chr(10)) AS content FROM m_lines)
, packed AS (SELECT doc_id, CASE WHEN length(content) <= 300 THEN {'done': []::VARCHAR[], 'open': content}
    ELSE list_reduce(list_prepend({'done': []::VARCHAR[], 'open': ''}, list_transform(
      string_split(regexp_replace(content, '([.!?])SPACE+', '\\1' || chr(1), 'g'), chr(1)),
      lambda x: {'done': []::VARCHAR[], 'open': x})),
    lambda a, b: CASE WHEN a.open = '' THEN {'done': a.done, 'open': b.open}
      WHEN length(a.open) + 1 + length(b.open) > 300 THEN {'done': list_append(a.done, a.open), 'open': b.open}
      ELSE {'done': a.done, 'open': a.open || ' ' || b.open} END) END AS r FROM m_one),
parts AS (SELECT doc_id, list_filter(list_append(r.done, r.open), lambda s: s <> '') AS l FROM packed),
pieces AS (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) - 1 AS "at" FROM parts)
SELECT doc_id, "at", md5(piece) AS piece, length(piece) AS size FROM pieces""").replace("SPACE", text.SPACE)


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = runbooks.chunk_runbooks(ws.listed_runbooks(spark, sf_dir))
    return made.select(
        "runbook_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content"),
        F.col("metadata.slug").alias("slug"), F.col("metadata.contentLength").cast("long").alias("content_length"),
    )


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding.hash_embed(A.table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.withColumn("weight", F.round("weight", 8))


def check_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.dimension_violations(A.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in stored form, one row per component."""
    rows = A.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(embedding.stored_form(F.col("embedding"))).alias("at", "value")
    )
    return rows.select("vec_id", F.col("at").cast("long").alias("at"),
                       F.round(F.col("value").cast("double"), 7).alias("value"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.vector_topk(
        A.search_queries(spark, sf_dir), A.runbooks(spark, sf_dir),
        query_key="query_id", item_key="id", query_content="text", item_content="body",
    )
    return found.withColumn("score", F.round("score", 6))


VECTOR_TOPK_SQL = f"""
WITH texts AS (SELECT 'q' || item_id AS k, text AS t FROM benchmark UNION ALL SELECT 'i' || doc_id, text FROM documents),
{BUCKETS}, {NEAREST},
ranked AS (SELECT CAST(substr(q, 2) AS BIGINT) AS query_id, CAST(substr(i, 2) AS BIGINT) AS id, score, row_number() OVER (
    PARTITION BY q ORDER BY CASE WHEN score IS NULL THEN 2 ELSE round(1 - score, 6) END, CAST(substr(i, 2) AS BIGINT)) AS rank FROM scored)
SELECT query_id, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5"""


def vector_topk_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to the centre of each label."""
    vectors = A.table(spark, sf_dir, "embeddings")
    centres = (
        vectors.select("label", F.posexplode("embedding").alias("at", "x"))
        .groupBy("label", "at").agg(F.avg("x").alias("x"))
        .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("c"))
        .select(F.col("label").cast("long").alias("label"), F.transform("c", lambda s: s["x"]).alias("centre"))
    )
    found = search.vector_topk(
        centres, vectors, query_key="label", item_key="vec_id", query_content="centre",
        item_content="embedding", to_vectors=search.dense_vectors, limit=20,
    )
    return found.withColumn("score", F.round("score", 6))


DENSE_SQL = """
WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT label, d, avg(x) AS x FROM v GROUP BY ALL),
s AS (SELECT c.label, v.vec_id, sum(c.x * v.x) / sqrt(sum(c.x * c.x) * sum(v.x * v.x)) AS score
      FROM c JOIN v USING (d) GROUP BY c.label, v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(1 - score, 6), vec_id) AS rank FROM s)
SELECT CAST(label AS BIGINT) AS label, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 20"""


def rejected_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts as search input: what an empty text leaves."""
    asked = A.messages(spark, sf_dir).select(
        "conv_id", "turn", F.when(F.col("role") == "system", "").otherwise(F.col("content")).alias("text")
    )
    return search.split_queries(asked)[1].select("conv_id", "turn")


def ingest_runbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk after an ingest over a store that holds half of them with other contents."""
    half = runbooks.chunk_runbooks(ws.listed_runbooks(spark, sf_dir).filter(F.col("id") % 2 == 0))
    old = half.withColumns({"content": F.lit("old"), "embedding": F.lit(None).cast("array<float>")})
    old = materialize(old, "old-chunks", lean=True)
    after, _ = runbooks.ingest_runbooks(A.runbooks(spark, sf_dir), A.services(spark, sf_dir), old)
    # Most of the components are zero; they and those rounded to zero are null, which the join leaves out.
    rounded = lambda v: F.round(v.cast("double") * 1e6).cast("long")
    parts = F.transform(
        "embedding", lambda v, i: F.when(v != 0, F.when(rounded(v) != 0, F.concat_ws(":", i, rounded(v))))
    )
    return after.select(
        "runbook_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.md5("content").alias("content"),
        F.size("embedding").cast("long").alias("dimension"),
        F.md5(F.array_join(parts, ",")).alias("vector"),
    )


QUERIES = {
    "service_list": (service_list, sql("SELECT * FROM m_services")),
    "service_lookup": (
        service_lookup,
        """WITH k AS (SELECT CAST(o_custkey AS VARCHAR) AS key FROM orders
             UNION SELECT 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') FROM events UNION SELECT s_name FROM supplier)
           SELECT key, c_custkey AS id, c_name AS name FROM k JOIN customer ON key = CAST(c_custkey AS VARCHAR) OR key = c_name""",
    ),
    "log_search": (
        log_search,
        sql("""SELECT l.id, s.name AS service_name, l.timestamp, l.level, l.message, l.attributes
            FROM m_logs l JOIN m_services s ON s.id = l.service_id
            WHERE l.level = 'error' AND l.timestamp >= TIMESTAMP '2024-01-05' AND l.timestamp <= TIMESTAMP '2024-01-20'
            ORDER BY l.timestamp DESC, l.id LIMIT 500"""),
    ),
    "log_search_service": (
        log_search_service,
        sql("""SELECT l.id, s.name AS service_name, l.timestamp, l.level, l.message, l.attributes
            FROM m_logs l JOIN m_services s ON s.id = l.service_id WHERE s.name = 'Customer#000000007'
            ORDER BY l.timestamp DESC, l.id LIMIT 100"""),
    ),
    "incident_list": (
        incident_list,
        sql("""SELECT i.id, s.name AS service_name, title, severity, status, detected_at, started_at,
            detection_reason, suspected_root_cause, metadata FROM m_incidents i JOIN m_services s ON s.id = i.service_id"""),
    ),
    "incident_lookup": (
        incident_lookup,
        sql("""SELECT i.id, i.service_id, s.name AS service_name, severity, started_at
            FROM m_incidents i JOIN m_services s ON s.id = i.service_id"""),
    ),
    "runbook_list": (
        runbook_list,
        """SELECT doc_id AS id, source AS title, 'doc-' || doc_id AS slug, md5(text) AS body, c_name AS service_name
           FROM documents LEFT JOIN customer ON lang = 'en' AND c_custkey = doc_id""",
    ),
    "incident_text_search": (
        incident_text_search,
        sql("""SELECT i.id, s.name AS service_name, severity FROM m_incidents i JOIN m_services s ON s.id = i.service_id
            WHERE severity = 'sev2' AND lower(s.name || ' ' || severity || ' ' || status || ' ' || title) LIKE '%sev2 detected error%'"""),
    ),
    "incident_text_search_all": (
        incident_text_search_all,
        sql("SELECT i.id, s.name AS service_name FROM m_incidents i JOIN m_services s ON s.id = i.service_id"),
    ),
    "incident_logs": (incident_logs, sql("SELECT * FROM m_incident_logs")),
    "incident_metric_summary": (incident_metric_summary, sql("SELECT * FROM m_incident_metrics")),
    "incident_deployments": (incident_deployments, sql("SELECT * FROM m_incident_deployments")),
    "last_deployment_before": (last_deployment_before, LAST_DEPLOYMENT_SQL),
    "incident_runbooks": (incident_runbooks, INCIDENT_RUNBOOKS_SQL),
    "service_signals": (
        service_signals, sql(SIGNALS + "SELECT service_id, service_name, max_latency, errors FROM sig")
    ),
    "service_signals_fanout": (
        service_signals_fanout,
        # The join of both facts, counted as it stands.
        sql("""SELECT s.id AS service_id, count(l.id) AS fanout_errors FROM m_services s
            LEFT JOIN m_metrics m ON m.service_id = s.id AND m.metric_name = 'view'
            LEFT JOIN m_logs l ON l.service_id = s.id AND l.level IN ('error', 'fatal') GROUP BY 1"""),
    ),
    "service_signals_volume": (
        service_signals_volume,
        """SELECT s_suppkey AS service_id, s_name AS service_name,
             max(l_extendedprice) FILTER (l_returnflag = 'R') AS max_latency,
             count(*) FILTER (l_linestatus = 'O') AS errors, count(*) FILTER (l_returnflag = 'R') AS n_metrics,
             count(*) FILTER (l_linestatus = 'O') * greatest(count(*) FILTER (l_returnflag = 'R'), 1) AS fanout_errors
           FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    ),
    "detect_incidents": (
        detect_incidents,
        sql(SIGNALS + "SELECT service_id, service_name, max_latency, errors FROM sig WHERE max_latency >= 100 AND errors > 0"),
    ),
    "detection_outcomes": (
        detection_outcomes,
        sql(SIGNALS + """, o AS (SELECT *, coalesce(max_latency, 0) >= 100 AND errors > 0 AS detected FROM sig)
            SELECT service_id, service_name, detected, CASE WHEN detected THEN service_name || ' reached 100 with errors logged'
              ELSE 'No incident threshold exceeded.' END AS reason FROM o"""),
    ),
    "detect_with_rules": (
        detect_with_rules,
        sql("""
            , r AS (SELECT 'half-' || metric_name AS rule_id, metric_name, max(metric_value) / 2 AS threshold FROM m_metrics GROUP BY metric_name),
            p AS (SELECT service_id, metric_name, max(metric_value) AS peak FROM m_metrics GROUP BY ALL),
            e AS (SELECT service_id, level, count(*) AS n FROM m_logs GROUP BY ALL)
            SELECT rule_id, service_id, s.name AS service_name, metric_name, threshold, peak, CAST(sum(n) AS BIGINT) AS errors
            FROM p JOIN r USING (metric_name) JOIN e USING (service_id) JOIN m_services s ON s.id = service_id
            WHERE peak >= threshold AND (CASE WHEN metric_name = 'purchase' THEN level IN ('warn', 'error')
              ELSE level IN ('error', 'fatal') END) GROUP BY ALL"""),
    ),
    "detections_to_incidents": (
        detections_to_incidents,
        sql(SIGNALS + """
            , b AS (SELECT service_id, min(timestamp) AS breach FROM m_metrics WHERE metric_name = 'view' AND metric_value >= 100 GROUP BY 1),
            f AS (SELECT service_id, min(timestamp) AS error FROM m_logs WHERE level IN ('error', 'fatal') GROUP BY 1),
            d AS (SELECT sig.*, CASE WHEN errors % 2 = 1 THEN TIMESTAMP '2024-01-30' ELSE least(breach, error) END AS started_at,
                CASE WHEN errors % 2 = 1 THEN TIMESTAMP '2024-01-30' ELSE greatest(breach, error) END AS detected_at
              FROM sig JOIN b USING (service_id) JOIN f USING (service_id) WHERE max_latency >= 100 AND errors > 0)
            SELECT sha256('incident/threshold-' || service_name) AS id, 'threshold-' || service_name AS scenario_id, service_id,
              service_name || ' view spike' AS title, 'sev2' AS severity, started_at, detected_at,
              service_name || ' view reached 100 with errors logged' AS detection_reason, 'view,error_logs' AS signals,
              least(80, (SELECT count(*) FROM m_logs l WHERE l.service_id = d.service_id
                AND l.timestamp BETWEEN started_at - INTERVAL 1 MINUTE AND detected_at + INTERVAL 1 MINUTE)) AS logs
            FROM d"""),
    ),
    "normalize_text": (
        normalize_text,
        sql("""SELECT doc_id, md5(b) AS body, length(b) AS size
               FROM (SELECT doc_id, array_to_string(ls, chr(10)) AS b FROM m_lines)"""),
    ),
    "split_sections": (
        split_sections,
        sql("""SELECT doc_id, no - 1 AS "at", md5(content) AS section, length(content) AS size FROM m_sections"""),
    ),
    "pack_sentences": (pack_sentences, PACK_SQL),
    "chunk_documents": (
        chunk_documents,
        sql("""SELECT runbook_id, chunk_index, md5(content) AS content, 'doc-' || runbook_id AS slug,
               length(content) AS content_length FROM m_chunks"""),
    ),
    "hash_embed": (
        hash_embed,
        f"""WITH texts AS (SELECT doc_id AS k, text AS t FROM documents), {BUCKETS}
            SELECT k AS doc_id, CAST(bucket AS BIGINT) AS bucket, n AS tokens, round(n / sqrt(square), 8) AS weight
            FROM counts JOIN norms USING (k)""",
    ),
    "check_dimension": (
        check_dimension,
        """SELECT vec_id, CAST(768 AS BIGINT) AS expected, CAST(len(embedding) AS BIGINT) AS received
           FROM embeddings WHERE len(embedding) <> 768""",
    ),
    "stored_vectors": (
        stored_vectors,
        """SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS "at",
             round(CAST(CAST(round(CAST(unnest(embedding) AS DOUBLE), 8) AS FLOAT) AS DOUBLE), 7) AS value FROM embeddings""",
    ),
    "vector_topk": (vector_topk, VECTOR_TOPK_SQL),
    "vector_topk_dense": (vector_topk_dense, DENSE_SQL),
    "rejected_queries": (rejected_queries, "SELECT conv_id, turn FROM conversations WHERE role = 'system' OR text = '' OR text IS NULL"),
    "search_stored_chunks": (search_stored_chunks, STORED_SQL),
    "ingest_runbooks": (
        ingest_runbooks,
        sql(f"""
            , texts AS (SELECT runbook_id || '#' || chunk_index AS k, content AS t FROM m_chunks), {BUCKETS},
            w AS (SELECT k, bucket, CAST(round(CAST(CAST(round(n / sqrt(square), 8) AS FLOAT) AS DOUBLE) * 1e6) AS BIGINT) AS v
              FROM counts JOIN norms USING (k)),
            v AS (SELECT k, md5(string_agg(bucket || ':' || v, ',' ORDER BY bucket)) AS vector FROM w WHERE v <> 0 GROUP BY k)
            SELECT runbook_id, chunk_index, md5(content) AS content, CAST(768 AS BIGINT) AS dimension,
              coalesce(vector, md5('')) AS vector
            FROM m_chunks LEFT JOIN v ON k = runbook_id || '#' || chunk_index"""),
    ),
}
