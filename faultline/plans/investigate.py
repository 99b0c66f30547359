"""Investigations over all incidents: evidence -> prompt -> report -> stored rows.

A failure is a row with status 'failed', never a failed job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions import jsontypes as J
from faultline.functions.display import bullets, two_decimals
from faultline.operators.lookup import with_service_name
from faultline.session import lookup_join, materialize, scratch_path, sorted_join

KEEP_NULLS = {"ignoreNullFields": "false"}

METRIC_FIELDS = ("metric_name", "unit", "min", "max", "avg", "samples")


# --- evidence -------------------------------------------------------------------------


def _collect(rows: DataFrame, name: str, order: list[str], fields: dict[str, str]) -> DataFrame:
    """One ordered array per incident. Callers bound the rows per incident beforehand.

    Only the order columns are compared: an item may hold a map or a VARIANT, which have
    no order.
    """
    item = F.struct(*[F.col(c).alias(a) for c, a in fields.items()]).alias("item")
    pairs = F.collect_list(F.struct(F.struct(*order).alias("at"), item))

    def compare(a: Column, b: Column) -> Column:
        return F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)

    ordered = F.transform(F.array_sort(pairs, compare), lambda p: p["item"])
    return rows.groupBy("incident_id").agg(ordered.alias(name))


def evidence_bundle(
    incidents: DataFrame,
    services: DataFrame,
    logs: DataFrame,
    metrics: DataFrame,
    deployments: DataFrame,
    runbooks: DataFrame,
) -> DataFrame:
    """(incident_id, incident, logs, metrics, deployments, runbooks); [] where none.

    The inputs are the per-incident tables: at most 80 logs, 5 deployments and 5 passages
    each, and one metric row per metric and unit.
    """
    named = with_service_name(incidents, services)
    heads = named.select(
        F.col("id").alias("incident_id"),
        F.struct(
            "id",
            F.col("service_id").alias("serviceId"),
            F.col("service_name").alias("serviceName"),
            "title",
            "severity",
            "status",
            F.col("detected_at").alias("detectedAt"),
            F.col("started_at").alias("startedAt"),
            F.col("detection_reason").alias("detectionReason"),
            F.col("suspected_root_cause").alias("suspectedRootCause"),
            "metadata",
        ).alias("incident"),
    )
    log_fields = {c: c for c in ("id", "timestamp", "level", "message", "attributes")}
    metric_fields = {"metric_name": "metricName", **{c: c for c in METRIC_FIELDS[1:]}}
    deployment_fields = {
        "id": "id",
        "version": "version",
        "commit_sha": "commitSha",
        "deployed_by": "deployedBy",
        "status": "status",
        "deployed_at": "deployedAt",
        "metadata": "metadata",
    }
    passage_fields = {
        "chunk_id": "chunkId",
        "title": "title",
        "slug": "slug",
        "content": "content",
        "score": "score",
    }
    arrays = {
        "logs": _collect(logs, "logs", ["rank"], log_fields),
        "metrics": _collect(metrics, "metrics", ["metric_name", "unit"], metric_fields),
        "deployments": _collect(deployments, "deployments", ["rank"], deployment_fields),
        "runbooks": _collect(runbooks, "runbooks", ["rank"], passage_fields),
    }
    bundle = heads
    for part in arrays.values():
        bundle = sorted_join(bundle, part, "incident_id", "left")
    return bundle.withColumns({name: F.coalesce(F.col(name), F.array()) for name in arrays})


# --- prompts --------------------------------------------------------------------------

# Texts of the investigation prompt.
SYSTEM_LINES = (
    "Use only the evidence provided in the prompt.",
    "Do not invent logs, metrics, deployments, runbooks, timestamps, causes, or remediation actions.",
    "If evidence is insufficient, say so in recommendedNextDiagnostics.",
    "Every conclusion must be supported by evidence entries or cited runbook sections.",
    "Return only valid JSON matching the requested schema.",
)
TASK = "Investigate the incident and identify the most probable root cause."
CONSTRAINTS = (
    "No remediation actions.",
    "No infrastructure changes.",
    "No speculative fixes.",
    "Cite supporting evidence for every conclusion.",
)
OUTPUT_SCHEMA = (
    '{"summary":"string","probableRootCause":"string","confidence":"number between 0 and 1",'
    '"evidence":[{"source":"log | metric | deployment | runbook",'
    '"reference":"stable id, metric name, deployment version, or runbook slug",'
    '"detail":"specific evidence supporting the conclusion"}],'
    '"citedRunbooks":[{"title":"string","slug":"string","chunkId":"string",'
    '"quote":"exact relevant excerpt"}],"recommendedNextDiagnostics":["string"]}'
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_prompts(bundle: DataFrame, product: str | None = None) -> DataFrame:
    """(incident_id, messages, prompt_text): a system and a user message per incident."""
    who = f"{product}'s incident investigation agent" if product else "an incident investigation agent"
    system = "\n".join([f"You are {who}.", *SYSTEM_LINES])
    output_shape = F.from_json(
        F.lit(OUTPUT_SCHEMA),
        "summary string, probableRootCause string, confidence string, "
        "evidence array<struct<source:string,reference:string,detail:string>>, "
        "citedRunbooks array<struct<title:string,slug:string,chunkId:string,quote:string>>, "
        "recommendedNextDiagnostics array<string>",
    )
    user = F.to_json(
        F.struct(
            F.lit(TASK).alias("task"),
            F.array(*[F.lit(t) for t in schemas.TOOLS]).alias("requiredToolSequenceAlreadyCompleted"),
            output_shape.alias("outputSchema"),
            "incident",
            F.col("deployments").alias("deploymentHistory"),
            F.col("logs").alias("relevantLogs"),
            F.col("metrics").alias("metricSummaries"),
            F.col("runbooks").alias("retrievedRunbookExcerpts"),
            F.array(*[F.lit(c) for c in CONSTRAINTS]).alias("constraints"),
        ),
        KEEP_NULLS,
    )
    prompts = bundle.select(
        "incident_id", F.array(message("system", F.lit(system)), message("user", user)).alias("messages")
    )
    return prompts.withColumn("prompt_text", prompt_text(F.col("messages")))


def prompt_text(messages: Column) -> Column:
    lines = F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return F.array_join(lines, "\n\n")


# The lines of the two prompts below are fixed values too.


def summary_prompt(
    summary: Column, evidence: Column, runbook_context: Column,
    company: str = "the company", product: str | None = None,
) -> Column:
    """The shorter prompt form: a summary and two bullet lists."""
    who = f"{product}'s incident investigation assistant" if product else "an incident investigation assistant"
    system = (
        f"You are {who}. Produce conservative, evidence-backed analysis. "
        "Do not recommend remediation unless evidence supports it."
    )
    user = F.concat_ws(
        "\n",
        F.lit(f"Investigate this incident for {company}."),
        F.lit(""),
        F.concat(F.lit("Incident summary:\n"), summary),
        F.lit(""),
        F.concat(F.lit("Evidence:\n"), bullets(evidence)),
        F.lit(""),
        F.concat(F.lit("Runbook context:\n"), bullets(runbook_context)),
        F.lit(""),
        F.lit("Return: probable root cause, confidence, supporting evidence, and missing information."),
    )
    return F.array(message("system", F.lit(system)), message("user", user))


def build_eval_prompts(
    expected: DataFrame, actual: DataFrame, product: str | None = None
) -> DataFrame:
    """Expected against actual finding per incident: (incident_id, messages)."""
    whose = f"{product} investigation answers" if product else "investigation answers"
    system = (
        f"You evaluate {whose}. Score factual alignment with the expected finding "
        "and explain gaps briefly."
    )
    user = F.concat_ws(
        "\n",
        F.lit("Evaluate the investigation output."),
        F.lit(""),
        F.concat(F.lit("Expected finding:\n"), F.col("expected_finding")),
        F.lit(""),
        F.concat(F.lit("Actual finding:\n"), F.col("actual_finding")),
        F.lit(""),
        F.lit("Return JSON with score from 0 to 1 and a short rationale."),
    )
    messages = F.array(message("system", F.lit(system)), message("user", user))
    return sorted_join(expected, actual, "incident_id").select("incident_id", messages.alias("messages"))


# --- generation -----------------------------------------------------------------------

# The request of a model call.
TEMPERATURE = 0.1
MAX_TOKENS = 1200


def _first(array: str, member: str) -> Column:
    return F.try_element_at(F.col(array), F.lit(1))[member]


def template_report(bundle: DataFrame) -> DataFrame:
    """A report per incident written from its evidence alone: (incident_id, response)."""
    service, version = F.col("incident.serviceName"), _first("deployments", "version")
    n_logs, n_metrics = F.size("logs").cast("string"), F.size("metrics").cast("string")
    has_deployment = F.size("deployments") > 0
    cause = F.when(
        has_deployment, F.concat(F.lit("Deployment "), version, F.lit(" preceded the incident."))
    ).otherwise(F.lit("No deployment preceded the incident."))
    sources = sum(
        (F.when(F.size(c) > 0, 1).otherwise(0) for c in ("logs", "metrics", "deployments", "runbooks")),
        F.lit(0),
    )

    def evidence(source: str, reference: Column, detail: Column) -> Column:
        item = F.struct(
            F.lit(source).alias("source"),
            reference.cast("string").alias("reference"),
            detail.alias("detail"),
        )
        return F.when(reference.isNotNull(), item)

    passage = F.try_element_at(F.col("runbooks"), F.lit(1))
    quote = passage["content"]
    cited = F.when(
        passage.isNotNull(),
        F.array(
            F.struct(
                passage["title"].alias("title"),
                passage["slug"].alias("slug"),
                passage["chunkId"].alias("chunkId"),
                quote.alias("quote"),
            )
        ),
    ).otherwise(F.array())
    report = F.struct(
        F.concat(
            F.col("incident.title"), F.lit(" at "), service, F.lit(": "), n_logs, F.lit(" logs and "),
            n_metrics, F.lit(" metric series in the window."),
        ).alias("summary"),
        cause.alias("probableRootCause"),
        (F.lit(0.2) * sources + 0.0875).alias("confidence"),
        F.array_compact(
            F.array(
                evidence("metric", _first("metrics", "metricName"), F.lit("Metric summary of the window.")),
                evidence("deployment", version, F.lit("Deployed before the end of the window.")),
                evidence("log", _first("logs", "id"), F.lit("Earliest log of the window.")),
                evidence("runbook", passage["slug"], F.lit("Nearest runbook passage.")),
            )
        ).alias("evidence"),
        cited.alias("citedRunbooks"),
        F.array(F.concat(F.lit("Compare the error logs of "), service, F.lit(" with the previous day."))).alias(
            "recommendedNextDiagnostics"
        ),
    )
    return bundle.select("incident_id", F.to_json(report).alias("response"))


Generate = Callable[[pd.DataFrame, float, int], pd.Series]


ANSWER = "response string, error_name string, error_message string, duration_ms long"
# Prompts of a task, which is what may be asked again when an executor is lost.
ANSWER_GROUP = 64
# Finished tasks leave their answers in the log at once, also when the job fails later.
AT_ONCE = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def answer_key(model: str) -> Column:
    """What an answer is kept under: the prompt and all that the call depends on."""
    return F.sha2(F.concat_ws("\x00", F.lit(model), F.lit(str(TEMPERATURE)), F.lit(str(MAX_TOKENS)), "prompt_text"), 256)


def kept_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, response, ...) of an answer log, one row per key: an answer before an error."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    rest = [c for c in rows.columns if c != "key"]
    order = F.struct(F.col("error_name").isNotNull(), -F.col("asked_at"), "duration_ms")
    return rows.groupBy("key").agg(F.min_by(F.struct(*rest), order).alias("_row")).select("key", "_row.*")


def batch_generate(
    prompts: DataFrame, generate: Generate, *, answers: str | None = None, model: str = "", group: int = ANSWER_GROUP
) -> DataFrame:
    """Answers of a model call per prompt: incident_id, response, error_name, error_message, duration_ms.

    ``generate(batch, temperature, max_tokens)`` gets batches of (incident_id, prompt_text)
    on the executors and returns one text per row; equal prompts are asked once, for the
    smallest of their ids. ``answers`` is the folder of a log of answers by prompt, ``model``
    and parameters, which later runs consult and extend; without it, it lasts for this call.
    A task asks about ``group`` prompts and leaves their answers in the log when it is done,
    so a lost executor or a failed job costs the groups at hand only. A call that raises is a
    row without a response and with the error: a batch that raises is halved until the error
    is that of its own prompt. Later runs ask again what got an error.
    """
    spark = prompts.sparkSession
    path = answers or scratch_path(spark, "answers")
    keyed_prompts = materialize(prompts.select("incident_id", "prompt_text", answer_key(model).alias("key")), "prompts")
    key_type = keyed_prompts.schema["incident_id"].dataType.simpleString()
    todo = keyed_prompts.groupBy("key").agg(F.min_by(F.struct("incident_id", "prompt_text"), "incident_id").alias("_p"))
    todo = todo.select("key", "_p.*")
    kept = kept_answers(spark, path)
    if kept is not None:
        todo = sorted_join(todo, kept.where("error_name IS NULL").select("key"), "key", "left_anti")
    todo = materialize(todo, "asked")

    def asked(rows: pd.DataFrame) -> list[tuple]:
        start = time.monotonic()
        try:
            found, error = list(generate(rows, TEMPERATURE, MAX_TOKENS)), (None, None)
            if len(found) != len(rows):
                raise ValueError("a model call has to give one text per prompt")
        except Exception as problem:  # whatever the injected callable raises is data
            if len(rows) > 1:
                half = len(rows) // 2
                return asked(rows.iloc[:half]) + asked(rows.iloc[half:])
            found, error = [None], (type(problem).__name__, str(problem))
        spent = round((time.monotonic() - start) * 1000 / len(rows))
        return [(answer, *error, spent) for answer in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["response", "error_name", "error_message", "duration_ms"]
        for batch in batches:
            for at in range(0, len(batch), group):
                some = batch.iloc[at : at + group]
                found = pd.DataFrame(asked(some[["incident_id", "prompt_text"]]), columns=names)
                found = found.astype({n: object for n in names[:3]})
                found.insert(0, "key", some["key"].to_numpy())
                found["asked_at"] = int(time.time() * 1000)
                yield found

    tasks = max(1, -(-todo.count() // group))
    made = todo.repartition(tasks, "key").mapInPandas(run, f"key string, {ANSWER}, asked_at long")
    made.write.mode("append").option(*AT_ONCE).parquet(path)
    found = kept_answers(spark, path).drop("asked_at")
    given = lookup_join(keyed_prompts.select("incident_id", "key"), found, ["key"], spread=["incident_id"])
    return materialize(given.select("incident_id", *[c.split(" ")[0] for c in ANSWER.split(", ")]), "answers")


def call_error(df: DataFrame) -> Column:
    """The message of a model call that failed; null where calls carry none."""
    return F.col("error_message") if "error_message" in df.columns else F.lit(None).cast("string")


# --- report check ---------------------------------------------------------------------


def _filled(v: Column) -> Column:
    return J.is_string(v, 1)


def _evidence_item(v: Column) -> Column:
    return (
        J.is_one_of(J.field(v, "source"), schemas.EVIDENCE_SOURCES)
        & _filled(J.field(v, "reference"))
        & _filled(J.field(v, "detail"))
    )


def _citation(v: Column) -> Column:
    chunk = J.field(v, "chunkId")
    return (
        _filled(J.field(v, "title"))
        & _filled(J.field(v, "slug"))
        & (J.is_missing(chunk) | _filled(chunk))
        & _filled(J.field(v, "quote"))
    )


def _confidence(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double").between(0, 1) & J.is_number(v)


REPORT_RULES: dict[str, Callable[[Column], Column]] = {
    "summary": _filled,
    "probableRootCause": _filled,
    "confidence": _confidence,
    "evidence": lambda v: J.is_array_of(v, _evidence_item, 1),
    "citedRunbooks": lambda v: J.is_array_of(v, _citation),
    "recommendedNextDiagnostics": lambda v: J.is_array_of(v, _filled),
}


def validate_reports(responses: DataFrame, text: str = "response") -> DataFrame:
    """Adds ``report`` (null unless valid), ``reasons`` and ``parser_error``.

    A call that failed has no answer to check: all three are null, its error stands alone.
    """
    parsed = responses.withColumn("_doc", F.try_parse_json(F.col(text)))
    members = {name: f"_{name}" for name in REPORT_RULES}
    opened = parsed.withColumns(
        {column: J.field(F.col("_doc"), name) for name, column in members.items()}
    )
    broken = [
        F.when(~F.coalesce(test(F.col(members[name])), F.lit(False)), F.lit(name))
        for name, test in REPORT_RULES.items()
    ]
    answered = call_error(responses).isNull()
    reasons = F.when(answered & F.col("_doc").isNull(), F.array(F.lit("json"))).when(
        answered, F.array_compact(F.array(*broken))
    )
    valid = F.size("reasons") == 0
    error = F.concat(F.lit("Invalid report: "), F.array_join("reasons", ", "))
    return (
        opened.withColumn("reasons", reasons)
        .withColumn("report", F.when(valid, F.from_json(F.col(text), schemas.REPORT)))
        .withColumn("parser_error", F.when(~valid, error))
        .drop("_doc", *members.values())
    )


# --- stored rows ----------------------------------------------------------------------


def investigation_id(incident_id: Column) -> Column:
    return F.concat(F.lit("inv-"), incident_id.cast("string"))


def after(moment: Column, milliseconds: Column) -> Column:
    return F.timestamp_add("MILLISECOND", milliseconds.cast("int"), moment)


def tool_call_ledger(
    bundle: DataFrame,
    started_at: Column,
    latency: Callable[[int], Column],
    failures: DataFrame | None = None,
) -> DataFrame:
    """One row per tool that ran, in the order 1..4.

    ``failures`` (incident_id, tool_index, error) marks tools that failed: their output
    is {"error": ..}, and the tools after them did not run.
    """
    key = investigation_id(F.col("incident_id"))
    query = F.concat_ws(
        " ", F.col("incident.title"), F.col("incident.detectionReason"), F.col("incident.serviceName")
    )
    arrays = ("logs", "metrics", "deployments", "runbooks")
    if failures is not None:
        failed = failures.select(
            "incident_id", F.col("tool_index").alias("_failed"), F.col("error").alias("_error")
        )
        bundle = sorted_join(bundle, failed, "incident_id", "left")
    else:
        bundle = bundle.withColumns({"_failed": F.lit(None).cast("int"), "_error": F.lit(None).cast("string")})

    calls = []
    waited = F.lit(0)
    for index, (tool, array) in enumerate(zip(schemas.TOOLS, arrays, strict=True), start=1):
        own = latency(index).cast("int")
        waited = waited + own
        bad = F.coalesce(F.col("_failed") == index, F.lit(False))
        ask = F.struct(query.alias("query")) if tool == "search_runbooks" else F.struct(
            F.col("incident_id").alias("incidentId")
        )
        calls.append(
            F.struct(
                F.concat_ws("/", key, F.lit(tool)).alias("id"),
                F.lit(index).alias("tool_index"),
                F.lit(tool).alias("tool_name"),
                F.to_json(ask).alias("input"),
                F.when(bad, F.to_json(F.struct(F.col("_error").alias("error"))))
                .otherwise(F.to_json(F.col(array), KEEP_NULLS))
                .alias("output"),
                F.when(bad, "error").otherwise("success").alias("status"),
                own.alias("latency_ms"),
                after(started_at, waited).alias("created_at"),
            )
        )
    rows = bundle.select(
        key.alias("investigation_id"), "incident_id", "_failed", F.inline(F.array(*calls))
    )
    return rows.filter(F.col("_failed").isNull() | (F.col("tool_index") <= F.col("_failed"))).drop("_failed")


def result_count() -> Column:
    """How many results a tool's output has; null if it is no array."""
    return F.json_array_length("output").cast("long")


def tool_output_summary(calls: DataFrame) -> DataFrame:
    """What the trace keeps of an output: the length of an array, else its type."""
    size = result_count()
    return calls.select(
        "id",
        "investigation_id",
        "tool_name",
        size.alias("result_count"),
        F.when(size.isNull(), "object").alias("result_type"),
    )


def tool_steps(calls: DataFrame) -> DataFrame:
    """Steps 1-4; a failed tool leaves none."""
    meta = F.to_json(F.struct(F.col("tool_name").alias("toolName"), F.col("latency_ms").alias("latencyMs")))
    return calls.filter(F.col("status") == "success").select(
        "investigation_id",
        F.col("tool_index").alias("step_index"),
        F.lit("tool_call").alias("step_type"),
        F.col("tool_name").alias("title"),
        F.col("output").alias("content"),
        meta.alias("metadata"),
        "created_at",
    )


def prompt_steps(prompts: DataFrame) -> DataFrame:
    """Step 5 of (investigation_id, prompt_text, created_at)."""
    meta = F.to_json(F.struct(F.lit(schemas.PROMPT_VERSION).alias("promptVersion")))
    return prompts.select(
        "investigation_id",
        F.lit(5).alias("step_index"),
        F.lit("prompt").alias("step_type"),
        F.lit("Build structured investigation prompt").alias("title"),
        F.col("prompt_text").alias("content"),
        meta.alias("metadata"),
        "created_at",
    )


def capture_invalid(checked: DataFrame) -> DataFrame:
    """Step 6 of an answer that is no valid report: the raw text and the error."""
    meta = F.to_json(
        F.struct(F.col("parser_error").alias("parserError"), F.col("created_at").alias("timestamp"))
    )
    return checked.filter(F.col("parser_error").isNotNull()).select(
        "investigation_id",
        F.lit(6).alias("step_index"),
        F.lit("observation").alias("step_type"),
        F.lit("Invalid model response").alias("title"),
        F.col("response").alias("content"),
        meta.alias("metadata"),
        "created_at",
    )


def final_steps(checked: DataFrame) -> DataFrame:
    """Step 6 of a valid report."""
    meta = F.to_json(F.struct("usage", "model", "provider"))
    return checked.filter(F.col("report").isNotNull()).select(
        "investigation_id",
        F.lit(6).alias("step_index"),
        F.lit("final").alias("step_type"),
        F.lit("Investigation report").alias("title"),
        F.to_json("report").alias("content"),
        meta.alias("metadata"),
        "created_at",
    )


def step_timeline(calls: DataFrame, prompts: DataFrame, checked: DataFrame) -> DataFrame:
    """All steps: 1-4 tools, 5 prompt, 6 report or invalid answer."""
    steps = (
        tool_steps(calls)
        .unionByName(prompt_steps(prompts))
        .unionByName(capture_invalid(checked))
        .unionByName(final_steps(checked))
    )
    step_id = F.concat_ws("/", "investigation_id", F.col("step_index").cast("string"))
    return steps.withColumn("id", step_id)


def investigation_events(started: DataFrame, calls: DataFrame, checked: DataFrame) -> DataFrame:
    """State changes: running, then completed, or failed with the error as summary.

    The error is that of a tool, of the model call, or of an answer that is no report.
    """
    nothing = F.lit(None)
    running = started.select(
        "investigation_id",
        F.col("started_at").alias("at"),
        F.lit(0).alias("seq"),
        F.lit("running").alias("status"),
        nothing.cast("string").alias("summary"),
        nothing.cast("string").alias("probable_root_cause"),
        nothing.cast("double").alias("confidence"),
    )
    tool_failure = calls.filter(F.col("status") == "error").select(
        "investigation_id",
        F.col("created_at").alias("at"),
        F.lit(1).alias("seq"),
        F.lit("failed").alias("status"),
        F.get_json_object("output", "$.error").alias("summary"),
        nothing.cast("string").alias("probable_root_cause"),
        nothing.cast("double").alias("confidence"),
    )
    ok = F.col("report").isNotNull()
    answered = checked.select(
        "investigation_id",
        F.col("created_at").alias("at"),
        F.lit(1).alias("seq"),
        F.when(ok, "completed").otherwise("failed").alias("status"),
        F.when(ok, F.col("report.summary")).otherwise(F.coalesce(call_error(checked), "parser_error")).alias("summary"),
        F.col("report.probableRootCause").alias("probable_root_cause"),
        F.col("report.confidence").alias("confidence"),
    )
    return running.unionByName(tool_failure).unionByName(answered)


def investigation_status(events: DataFrame) -> DataFrame:
    """The latest state per investigation; confidence is kept to 3 decimals."""
    last = F.struct("status", "at", "summary", "probable_root_cause", "confidence")
    folded = events.groupBy("investigation_id").agg(
        F.max_by(last, F.struct("at", "seq")).alias("_l"),
        F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"),
    )
    status, at = F.col("_l.status"), F.col("_l.at")
    elapsed = F.timestamp_diff("MILLISECOND", F.col("started_at"), at)
    return folded.select(
        "investigation_id",
        status.alias("status"),
        "started_at",
        F.when(status.isin("completed", "failed"), at).alias("completed_at"),
        F.when(status == "completed", elapsed).cast("int").alias("latency_ms"),
        F.col("_l.summary").alias("summary"),
        F.col("_l.probable_root_cause").alias("probable_root_cause"),
        F.col("_l.confidence").cast("decimal(4,3)").alias("confidence_score"),
    )


# --- reading back ---------------------------------------------------------------------


def tool_calls_list(calls: DataFrame) -> DataFrame:
    """Tool calls in the order they were made, per investigation."""
    return calls.repartition("investigation_id").sortWithinPartitions("investigation_id", "created_at", "id")


def steps_list(steps: DataFrame) -> DataFrame:
    return steps.repartition("investigation_id").sortWithinPartitions("investigation_id", "step_index")


def extract_final_report(steps: DataFrame) -> DataFrame:
    """The stored report per investigation: null when it breaks its schema.

    A text that is no JSON gives a null report with the reason, not a failed job.
    """
    final = steps.filter(
        (F.col("step_type") == "final") & (F.col("title") == "Investigation report")
    )
    first = final.groupBy("investigation_id").agg(F.min_by("content", "step_index").alias("content"))
    return validate_reports(first, "content").select("investigation_id", "report", "parser_error")


def investigation_detail(
    investigations: DataFrame,
    incidents: DataFrame,
    services: DataFrame,
    calls: DataFrame,
    steps: DataFrame,
) -> DataFrame:
    """An investigation with its incident, service, tool calls, steps and report lists.

    The collected arrays hold at most 4 tool calls and 6 steps: one call per tool, and
    (investigation_id, step_index) is unique.
    """
    titles = incidents.select(
        F.col("id").alias("incident_id"), "service_id", F.col("title").alias("incident_title")
    )
    heads = with_service_name(
        sorted_join(investigations.drop("service_id"), titles, "incident_id"), services
    ).withColumnRenamed("id", "investigation_id")
    call = F.struct("created_at", "id", "tool_name", "input", "output", "status", "latency_ms")
    step = F.struct("step_index", "id", "step_type", "title", "content", "metadata", "created_at")
    call_lists = calls.groupBy("investigation_id").agg(F.sort_array(F.collect_list(call)).alias("tool_calls"))
    step_lists = steps.groupBy("investigation_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    report = extract_final_report(steps).select("investigation_id", "report")
    joined = heads
    for part in (call_lists, step_lists, report):
        joined = sorted_join(joined, part, "investigation_id", "left")
    return joined.select(
        F.col("investigation_id").alias("id"),
        "incident_id",
        "incident_title",
        "service_name",
        "status",
        "provider",
        "model",
        "prompt_version",
        "trace_id",
        "started_at",
        "completed_at",
        "latency_ms",
        "summary",
        "probable_root_cause",
        F.col("confidence_score").cast("double").alias("confidence"),
        "created_at",
        F.coalesce("tool_calls", F.array()).alias("tool_calls"),
        F.coalesce("steps", F.array()).alias("steps"),
        F.coalesce("report.evidence", F.array()).alias("evidence"),
        F.coalesce("report.citedRunbooks", F.array()).alias("cited_runbooks"),
        F.coalesce("report.recommendedNextDiagnostics", F.array()).alias("recommended_next_diagnostics"),
    )


def investigation_report(detail: DataFrame) -> DataFrame:
    """The presentation row; tool calls keep four fields."""
    supporting = F.transform(
        "tool_calls",
        lambda c: F.struct(c["tool_name"], c["status"], c["latency_ms"], c["created_at"]),
    )
    return detail.select(
        F.col("id").alias("investigation_id"),
        "trace_id",
        "incident_id",
        "incident_title",
        "service_name",
        "status",
        F.coalesce("completed_at", "created_at").alias("generated_at"),
        "summary",
        "probable_root_cause",
        "confidence",
        "evidence",
        "cited_runbooks",
        "recommended_next_diagnostics",
        supporting.alias("supporting_tool_calls"),
    )


def report_text(report: DataFrame, heading: str = "Investigation") -> DataFrame:
    """The report as plain text: (investigation_id, text). Its labels are fixed values."""

    def or_(column: Column, default: str) -> Column:
        return F.coalesce(column, F.lit(default))

    def lines(items: Column, line: Callable[[Column], Column]) -> Column:
        return F.when(items.isNull(), "- none").otherwise(F.array_join(F.transform(items, line), "\n"))

    evidence = lines(
        F.col("evidence"),
        lambda e: F.concat(F.lit("- ["), or_(e["source"], "evidence"), F.lit("] "), or_(e["detail"], "")),
    )
    cited = lines(
        F.col("cited_runbooks"),
        lambda r: F.concat(F.lit("- "), F.coalesce(r["title"], r["slug"], F.lit("runbook"))),
    )
    diagnostics = lines(F.col("recommended_next_diagnostics"), lambda d: F.concat(F.lit("- "), d))
    confidence = or_(two_decimals(F.col("confidence")), "unknown")
    text = F.concat_ws(
        "\n",
        F.lit(heading),
        F.lit("=" * len(heading)),
        F.concat(F.lit("Investigation: "), or_(F.col("investigation_id"), "unknown")),
        F.concat(F.lit("Incident: "), or_(F.col("incident_title"), "unknown")),
        F.concat(F.lit("Service: "), or_(F.col("service_name"), "unknown")),
        F.concat(F.lit("Confidence: "), confidence),
        F.lit(""),
        F.lit("Summary"),
        or_(F.col("summary"), "No summary returned."),
        F.lit(""),
        F.lit("Probable root cause"),
        or_(F.col("probable_root_cause"), "No root cause returned."),
        F.lit(""),
        F.lit("Evidence"),
        evidence,
        F.lit(""),
        F.lit("Cited runbooks"),
        cited,
        F.lit(""),
        F.lit("Recommended next diagnostics"),
        diagnostics,
    )
    return report.select("investigation_id", text.alias("text"))
