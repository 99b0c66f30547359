"""Dashboard computations as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.display import DASH, milliseconds, percent, status_class
from faultline.session import sorted_join


def latest_investigations(investigations: DataFrame) -> DataFrame:
    """The newest investigation per incident."""
    row = F.struct("id", "status", "confidence_score")
    return (
        investigations.groupBy("incident_id")
        .agg(F.max_by(row, F.struct("created_at", "id")).alias("_i"))
        .select(
            "incident_id",
            F.col("_i.id").alias("investigation_id"),
            F.col("_i.status").alias("investigation_status"),
            F.col("_i.confidence_score").alias("confidence"),
        )
    )


def overview_cards(incidents: DataFrame, investigations: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: counts, the newest incident's title, the newest confidence."""
    newest = F.struct("detected_at", "id")
    heads = incidents.agg(
        F.count("*").alias("incidents"),
        F.coalesce(F.max_by("title", newest), F.lit("No incidents detected")).alias("hero_incident"),
    )
    loaded = investigations.agg(
        F.count("*").alias("investigations"),
        F.max_by("confidence_score", F.struct("created_at", "id")).alias("_confidence"),
    ).select("investigations", percent(F.col("_confidence")).alias("confidence"))
    # Three rows, each with its own columns, folded into one.
    cards = heads.unionByName(loaded, allowMissingColumns=True).unionByName(
        calls.agg(F.count("*").alias("tool_calls")), allowMissingColumns=True
    )
    return cards.agg(*[F.max(c).alias(c) for c in cards.columns])


def incident_board(listed: DataFrame, investigations: DataFrame) -> DataFrame:
    """Incident rows with the state of their latest investigation."""
    latest = latest_investigations(investigations)
    status = F.coalesce("investigation_status", F.lit("not started"))
    return listed.join(latest.hint("merge"), listed["id"] == latest["incident_id"], "left").select(
        listed["id"].alias("incident_id"),
        "service_name",
        "title",
        F.upper("severity").alias("severity"),
        F.col("status").alias("incident_status"),
        status_class(F.col("status")).alias("incident_class"),
        "detected_at",
        status.alias("investigation_status"),
        status_class(status).alias("investigation_class"),
        percent(F.col("confidence")).alias("confidence"),
    )


def timeline_rows(investigations: DataFrame, calls: DataFrame, steps: DataFrame) -> DataFrame:
    """Tool calls, the model call when a final step exists, then the final report.

    The running index follows from the parts, so no window is needed: tools run in the
    order of their index and nothing runs after a failed one.
    """
    inv = investigations.withColumnRenamed("id", "investigation_id")
    tools = calls.select(
        "investigation_id",
        F.col("tool_index").cast("long").alias("index"),
        F.col("tool_name").alias("title"),
        "status",
        F.col("latency_ms").cast("long").alias("latency_ms"),
        "created_at",
    )
    counts = calls.groupBy("investigation_id").agg(F.count("*").alias("_tools"))
    final = (
        steps.filter(F.col("step_type") == "final")
        .groupBy("investigation_id")
        .agg(F.min("created_at").alias("_final_at"))
    )
    whole = sorted_join(sorted_join(inv, counts, "investigation_id", "left"), final, "investigation_id", "left")
    n_tools = F.coalesce("_tools", F.lit(0))
    has_final = F.col("_final_at").isNotNull()
    latency = F.col("latency_ms").cast("long").alias("latency_ms")
    model = whole.filter(has_final).select(
        "investigation_id",
        (n_tools + 1).alias("index"),
        F.lit("LLM").alias("title"),
        "status",
        latency,
        F.col("_final_at").alias("created_at"),
    )
    report = whole.select(
        "investigation_id",
        (n_tools + has_final.cast("int") + 1).alias("index"),
        F.lit("Final report").alias("title"),
        "status",
        latency,
        F.col("completed_at").alias("created_at"),
    )
    rows = tools.unionByName(model).unionByName(report)
    return rows.withColumn("status_class", status_class(F.col("status")))


def evidence_rows(reports: DataFrame, calls: DataFrame) -> DataFrame:
    """Evidence, then citations, then tool outputs: (section, ordinal, title, summary, body)."""
    evidence = reports.select(
        "investigation_id", F.posexplode("report.evidence").alias("_at", "_e")
    ).select(
        "investigation_id",
        F.lit(1).cast("long").alias("section"),
        F.col("_at").cast("long").alias("ordinal"),
        F.concat_ws(" · ", "_e.source", "_e.reference").alias("title"),
        F.col("_e.detail").alias("summary"),
        F.to_json("_e").alias("body"),
    )
    cited = reports.select(
        "investigation_id", F.posexplode("report.citedRunbooks").alias("_at", "_r")
    ).select(
        "investigation_id",
        F.lit(2).cast("long").alias("section"),
        F.col("_at").cast("long").alias("ordinal"),
        F.concat(F.lit("runbook · "), F.col("_r.title")).alias("title"),
        F.col("_r.quote").alias("summary"),
        F.to_json("_r").alias("body"),
    )
    outputs = calls.select(
        "investigation_id",
        F.lit(3).cast("long").alias("section"),
        (F.col("tool_index") - 1).cast("long").alias("ordinal"),
        F.concat(F.lit("tool output · "), F.col("tool_name")).alias("title"),
        F.concat_ws(" · ", F.col("status"), milliseconds(F.col("latency_ms"))).alias("summary"),
        F.col("output").alias("body"),
    )
    return evidence.unionByName(cited).unionByName(outputs)


def trace_panel(
    investigations: DataFrame, calls: DataFrame, base_url: str = "", project: str = "default"
) -> DataFrame:
    """Trace id, duration, observations (tool calls and the generation) and link."""
    counts = calls.groupBy(F.col("investigation_id").alias("id")).agg(F.count("*").alias("_calls"))
    prefix = f"{base_url.rstrip('/')}/project/{project}/traces/"
    link = F.concat(F.lit(prefix), F.url_encode("trace_id"))
    return sorted_join(investigations, counts, "id", "left").select(
        F.col("id").alias("investigation_id"),
        F.coalesce("trace_id", F.lit("Disabled / unavailable")).alias("trace"),
        milliseconds(F.col("latency_ms")).alias("duration"),
        (F.coalesce("_calls", F.lit(0)) + F.col("status").isNotNull().cast("int")).alias("observations"),
        F.concat_ws(" / ", F.coalesce("provider", F.lit(DASH)), F.coalesce("model", F.lit(DASH))).alias("model"),
        F.coalesce(link, F.lit("unavailable")).alias("link"),
    )
