"""Tables the registered queries share, built from the given ones once per session.

The investigation tables are stored data: they are written to the shared folder when a
query first needs them, and the read models read them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import evidence, lookup
from faultline.plans import investigate as inv
from faultline.plans import ingest, observe, runbooks
from faultline.schemas import PROMPT_VERSION
from faultline.session import materialize, scratch_path, sorted_join, spread
from faultline.sources import adapters as A
from faultline.sources import batches as B

EVENTS_PER_BATCH = 100

_built: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def forget() -> None:
    """Have every stored table built anew when it is asked for next."""
    _built.clear()


def stored(name: str):
    """Make a table builder write its result once per session and folder."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        def read(spark: SparkSession, sf_dir: str) -> DataFrame:
            return once(spark, sf_dir, name, lambda: materialize(build(spark, sf_dir), name))

        return read

    return wrap


# --- posted batches -------------------------------------------------------------------


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def batch_texts(spark: SparkSession, sf_dir: str, *, dirty: bool = False) -> DataFrame:
    """(batch_id, value): the JSON text of one telemetry batch per 100 consecutive events.

    With ``dirty`` some rows break the contract, by fixed rules on the event id.
    """
    e = A.table(spark, sf_dir, "events")
    no, value = F.col("event_id"), F.col("value")

    def spoil(every: int, good: Column, bad: Column) -> Column:
        return F.when(no % every == 0, bad).otherwise(good) if dirty else good

    service = F.concat(F.lit("svc-"), F.col("user_id").cast("string"))
    at = spoil(19, iso(F.col("ts")), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    kind = F.col("event_type")
    level = (
        F.when(kind == "error", "error")
        .when(kind == "purchase", "warn")
        .when(kind == "view", "debug")
        .otherwise("info")
    )
    attributes = F.parse_json("props")
    log = F.struct(
        F.when(no % 29 != 0, service).otherwise(F.lit(None) if dirty else service).alias("serviceName"),
        at.alias("timestamp"),
        spoil(17, level, F.lit("trace")).alias("level"),
        spoil(23, kind.cast("variant"), F.lit(5).cast("variant")).alias("message"),
        attributes.alias("attributes"),
    )
    metric = F.struct(
        service.alias("serviceName"),
        at.alias("timestamp"),
        kind.alias("metricName"),
        spoil(31, value.cast("variant"), F.lit("high").cast("variant")).alias("metricValue"),
        F.lit("u").alias("unit"),
    )
    deployment = F.struct(
        service.alias("serviceName"),
        F.concat(F.lit("v"), (no % 5).cast("string")).alias("version"),
        F.sha1(no.cast("string")).alias("commitSha"),
        F.lit("deploy-bot").alias("deployedBy"),
        spoil(13, F.lit("production"), F.lit("staging")).alias("environment"),
        F.lit("succeeded").alias("status"),
        at.alias("deployedAt"),
    )
    incident = F.struct(
        F.concat(F.lit("scenario-"), F.col("user_id").cast("string")).alias("id"),
        F.lit("error value spike").alias("title"),
        service.alias("serviceName"),
        F.lit("sev2").alias("severity"),
        at.alias("startedAt"),
        at.alias("detectedAt"),
        F.lit("the value rose over the threshold of 100").alias("detectionReason"),
        F.lit("unknown").alias("suspectedRootCause"),
        F.array(F.lit("value")).alias("affectedSignals"),
    )

    def texts(keep: Column, item: Column) -> Column:
        """JSON texts of the kept events in event order; a batch holds 100 events."""
        listed = F.collect_list(F.when(keep, F.struct(no, F.to_json(item).alias("json"))))
        return F.array_join(F.transform(F.sort_array(listed), lambda r: r["json"]), ",")

    everything = F.lit(True)
    names = F.array_sort(F.collect_set("user_id"))

    def service_item(user: Column) -> Column:
        text = user.cast("string")
        rank = F.element_at(F.array(*[F.lit(c) for c in ("low", "medium", "high", "critical")]),
                            (user % 4 + 1).cast("int"))
        if dirty:
            rank = F.when(user % 11 == 0, "severe").otherwise(rank)
        return F.to_json(
            F.struct(
                F.concat(F.lit("svc-"), text).alias("name"),
                F.concat(F.lit("Service "), text).alias("displayName"),
                F.lit("account service").alias("description"),
                F.concat(F.lit("team-"), (user % 7).cast("string")).alias("ownerTeam"),
                F.lit("jvm").alias("runtime"),
                rank.alias("criticality"),
            )
        )

    grouped = e.groupBy(F.floor(no / EVENTS_PER_BATCH).alias("batch_id")).agg(
        iso(F.max("ts")).alias("generated"),
        F.array_join(F.transform(names, service_item), ",").alias("services"),
        texts(kind == "signup", deployment).alias("deployments"),
        texts(everything, log).alias("logs"),
        texts(everything, metric).alias("metrics"),
        texts((kind == "error") & (value >= 100), incident).alias("incidents"),
    )
    parts = [F.lit('{"generatedAt":"'), F.col("generated"), F.lit('"')]
    for name in B.SECTIONS:
        parts += [F.lit(f',"{name}":['), F.col(name), F.lit("]")]
    return grouped.select("batch_id", F.concat(*parts, F.lit("}")).alias("value"))


def posted_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of posted batches, one per line."""

    def write() -> str:
        path = scratch_path(spark, "posted")
        batch_texts(spark, sf_dir).select("value").write.option("compression", "lz4").text(path)
        return path

    return once(spark, sf_dir, "posted_folder", write)


@stored("typed_batches")
def typed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.parse(batch_texts(spark, sf_dir))


@stored("posted_services")
def posted_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service table after all posted batches."""
    empty = spark.createDataFrame([], ingest.SERVICES)
    items = B.section(typed_batches(spark, sf_dir), "services")
    return ingest.keyed.upsert_services(empty, ingest.service_rows(items))


# --- runbooks -------------------------------------------------------------------------


def listed_runbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(A.runbooks(spark, sf_dir)).withColumn("service_name", F.lit(None).cast("string"))


@stored("chunks")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runbooks.chunk_runbooks(listed_runbooks(spark, sf_dir))


# --- investigations -------------------------------------------------------------------


@stored("incident_logs")
def incident_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.incident_logs(
        A.incidents(spark, sf_dir), A.log_entries(spark, sf_dir), A.LOOKBACK, A.LOOKAHEAD
    )


@stored("incident_metrics")
def incident_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.incident_metric_summary(
        A.incidents(spark, sf_dir), A.metric_points(spark, sf_dir), A.LOOKBACK, A.LOOKAHEAD
    )


@stored("incident_deployments")
def incident_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.incident_deployments(
        A.incidents(spark, sf_dir), A.deployments(spark, sf_dir), A.LOOKAHEAD
    )


@stored("incident_runbooks")
def incident_runbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runbooks.incident_runbooks(
        A.incidents(spark, sf_dir),
        A.services(spark, sf_dir),
        chunks(spark, sf_dir),
        A.runbooks(spark, sf_dir),
    )


@stored("bundle")
def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.evidence_bundle(
        A.incidents(spark, sf_dir),
        A.services(spark, sf_dir),
        incident_logs(spark, sf_dir),
        incident_metrics(spark, sf_dir),
        incident_deployments(spark, sf_dir),
        incident_runbooks(spark, sf_dir),
    )


def tool_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that failed, by fixed rules on the incident id."""
    last = F.col("id") % 25
    failed = F.when(last == 24, 4).when(last == 23, 2)
    error = F.when(last == 24, "search index offline").when(last == 23, "metric store offline")
    return (
        A.incidents(spark, sf_dir)
        .select(F.col("id").alias("incident_id"), failed.alias("tool_index"), error.alias("error"))
        .filter(F.col("tool_index").isNotNull())
    )


def tool_latency(index: int) -> Column:
    return (F.col("incident_id") * 7 + index * 13) % 400 + 5


@stored("tool_calls")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.tool_call_ledger(
        bundle(spark, sf_dir),
        F.col("incident.detectedAt"),
        tool_latency,
        tool_failures(spark, sf_dir),
    )


def tools_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(incident_id, investigation_id, tools_at) of investigations whose tools all ran."""
    return (
        tool_calls(spark, sf_dir)
        .filter((F.col("tool_index") == 4) & (F.col("status") == "success"))
        .select("incident_id", "investigation_id", F.col("created_at").alias("tools_at"))
    )


@stored("prompts")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = inv.build_prompts(bundle(spark, sf_dir))
    return sorted_join(made, tools_done(spark, sf_dir), "incident_id").withColumnRenamed("tools_at", "created_at")


CALL_ERROR = "model offline"


def call_failed(incident_id: Column) -> Column:
    """Model calls that raise, by a fixed rule on the incident id."""
    return incident_id % 25 == 22


def spoiled(response: Column) -> Column:
    """Some answers made invalid, by fixed rules on the incident id."""
    last = F.col("incident_id") % 10
    return (
        F.when(last == 0, F.lit("not-json"))
        .when(last == 1, F.regexp_replace(response, '"confidence":[0-9.]+', '"confidence":1.2'))
        .when(last == 2, F.regexp_replace(response, r'"evidence":\[.*?\],"citedRunbooks"', '"evidence":[],"citedRunbooks"'))
        .when(last == 3, F.regexp_replace(response, '"source":"metric"', '"source":"trace"'))
        .when(last == 4, F.regexp_replace(response, r'^\{"summary":"[^"]*"', '{"summary":5'))
        .otherwise(response)
    )


@stored("checked")
def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers of all prompts, checked."""
    no = F.col("incident_id")
    duration = 1000 + no % 2000
    answers = sorted_join(inv.template_report(bundle(spark, sf_dir)), tools_done(spark, sf_dir), "incident_id")
    calls = answers.select(
        "incident_id",
        "investigation_id",
        F.when(~call_failed(no), spoiled(F.col("response"))).alias("response"),
        F.when(call_failed(no), F.lit(CALL_ERROR)).alias("error_message"),
        F.when(no % 2 == 0, "ollama").otherwise("gemini").alias("provider"),
        F.concat(F.lit("model-"), (no % 3).cast("string")).alias("model"),
        duration.alias("duration_ms"),
        inv.after(F.col("tools_at"), duration).alias("created_at"),
        (42 + no % 10).alias("reported_prompt"),
        (9 + no % 5).alias("reported_completion"),
        F.lit(None).cast("long").alias("reported_total"),
        F.lit(0).cast("long").alias("prompt_tokens"),
        F.lit("").alias("completion"),
    )
    used = observe.normalize_usage(calls)
    used = used.withColumn("usage", F.when(F.col("error_message").isNull(), F.col("usage"))).drop(
        "reported_prompt", "reported_completion", "reported_total", "prompt_tokens", "completion"
    )
    return inv.validate_reports(used)


@stored("steps")
def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.step_timeline(
        tool_calls(spark, sf_dir), prompts(spark, sf_dir), checked(spark, sf_dir)
    )


@stored("investigations")
def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.col("id")
    started = A.incidents(spark, sf_dir).select(
        no.alias("incident_id"),
        inv.investigation_id(no).alias("investigation_id"),
        F.col("detected_at").alias("started_at"),
        F.when(no % 2 == 0, "ollama").otherwise("gemini").alias("provider"),
        F.concat(F.lit("model-"), (no % 3).cast("string")).alias("model"),
        F.lit(PROMPT_VERSION).alias("prompt_version"),
        F.when(no % 3 != 0, F.concat(F.lit("trace/"), no.cast("string"))).alias("trace_id"),
    )
    events = inv.investigation_events(started, tool_calls(spark, sf_dir), checked(spark, sf_dir))
    state = inv.investigation_status(events).drop("started_at")
    return (
        sorted_join(started, state, "investigation_id")
        .withColumn("created_at", F.col("started_at"))
        .withColumnRenamed("investigation_id", "id")
    )


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.investigation_detail(
        investigations(spark, sf_dir),
        A.incidents(spark, sf_dir),
        A.services(spark, sf_dir),
        tool_calls(spark, sf_dir),
        steps(spark, sf_dir),
    )


def listed_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.incident_list(A.incidents(spark, sf_dir), A.services(spark, sf_dir))
