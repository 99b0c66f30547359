"""Posted batch -> stored tables -> evidence -> prompt -> answer -> report, end to end."""

import json
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators import detect, evidence, keyed
from faultline.plans import ingest, observe, readmodel, runbooks
from faultline.plans import investigate as inv
from faultline.session import materialize
from faultline.sources import batches as B
from faultline.sources.changes import ChangeLog
from faultline.streaming.ingest import apply_batch
from tests.conftest import rows
from tests.test_contract import REPORT
from tests.incident import posted

TITLES = [
    "query_logs", "query_metrics", "get_deployments", "search_runbooks",
    "Build structured investigation prompt", "Investigation report",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("workflow")
    (folder / "posted.json").write_text(json.dumps(posted()))
    raw = B.read_raw(spark, str(folder / "posted.json"))
    assert B.contract_violations(raw).count() == 0
    empty = {
        "services": spark.createDataFrame([], ingest.SERVICES),
        "deployments": spark.createDataFrame([], ingest.DEPLOYMENTS),
        "incidents": spark.createDataFrame([], ingest.INCIDENTS),
    }
    rewritten, appended, summary = ingest.ingest(empty, B.parse(raw))
    assert rows(summary) == [{"insertedLogs": 9, "insertedMetrics": 8, "incidents": 1}]
    log = ChangeLog(spark, str(folder / "store"))
    lines = spark.read.text(str(folder / "posted.json")).selectExpr("_metadata.file_path AS file_path", "value")
    apply_batch(log, lines, "posts", 0)
    stored = {name: log.current(name) for name in ("services", "deployments", "incidents")}
    assert {k: v.count() for k, v in stored.items()} == {k: rewritten[k].count() for k in stored}
    stored |= {name: log.facts(name) for name in ("log_entries", "metric_points")}
    books = spark.createDataFrame(
        [
            ("r1", "Latency Runbook", "cart-latency", "Symptoms: p95 latency above 1200ms.\nDiagnosis: inspect timeout."),
            ("r2", "Payments", "pay", "Check gateway response codes."),
        ],
        "id string, title string, slug string, body string",
    )
    rec = stored["services"].filter("name = 'cart'").first()["id"]
    stored["runbooks"] = books.withColumn("service_id", F.when(F.col("id") == "r1", rec))
    chunks, counts = runbooks.ingest_runbooks(stored["runbooks"], stored["services"])
    assert rows(counts) == [{"runbooks": 2, "chunks": 3}]
    stored["runbook_chunks"] = materialize(chunks, "chunks")
    return stored


@pytest.fixture(scope="module")
def bundle(tables):
    t = tables
    return materialize(
        inv.evidence_bundle(
            t["incidents"],
            t["services"],
            evidence.incident_logs(t["incidents"], t["log_entries"]),
            evidence.incident_metric_summary(t["incidents"], t["metric_points"]),
            evidence.incident_deployments(t["incidents"], t["deployments"]),
            runbooks.incident_runbooks(t["incidents"], t["services"], t["runbook_chunks"], t["runbooks"]),
        ),
        "bundle",
    )


def test_stored_tables_are_sound(tables):
    assert keyed.check_integrity({k: v for k, v in tables.items()}).count() == 0


def test_detection_on_stored_tables(tables):
    signals = detect.service_signals(tables["services"], tables["metric_points"], tables["log_entries"])
    assert [(r["service_name"], r["errors"]) for r in rows(detect.detect_incidents(signals))] == [("cart", 3)]


def test_bundle(bundle):
    got = rows(bundle.drop("logs"))[0]
    times = [r["timestamp"] for r in bundle.select(F.explode("logs").alias("l")).select("l.*").collect()]
    assert len(times) == 5 and times == sorted(times)
    assert [m["metricName"] for m in got["metrics"]] == ["http_error_rate", "p95_latency_ms"]
    assert got["metrics"][1]["max"] == 2400.0 and got["metrics"][1]["samples"] == 3
    assert [d["version"] for d in got["deployments"]] == ["v7", "v6"]
    assert sorted(r["slug"] for r in got["runbooks"]) == ["cart-latency", "cart-latency", "pay"]
    assert got["runbooks"][0]["slug"] == "cart-latency"
    assert got["incident"]["metadata"]["scenarioId"] == "cart-slow"


def test_prompt(bundle):
    prompt = rows(inv.build_prompts(bundle, product="Acme"))[0]
    system, user = prompt["messages"]
    assert system["role"] == "system" and system["content"].startswith("You are Acme's incident investigation agent.")
    body = json.loads(user["content"])
    assert list(body) == [
        "task", "requiredToolSequenceAlreadyCompleted", "outputSchema", "incident", "deploymentHistory",
        "relevantLogs", "metricSummaries", "retrievedRunbookExcerpts", "constraints",
    ]
    assert body["requiredToolSequenceAlreadyCompleted"] == TITLES[:4]
    assert list(body["outputSchema"]) == list(REPORT)
    assert body["relevantLogs"][0]["attributes"] == {"place": "l2", "n": 1}
    assert body["deploymentHistory"][0]["metadata"] == {"change": "v7"}
    assert list(body["retrievedRunbookExcerpts"][0]) == ["chunkId", "title", "slug", "content", "score"]


def investigate(bundle, answer, failures=None):
    started = F.lit("2026-06-26 10:00:00").cast("timestamp_ntz")
    calls = inv.tool_call_ledger(bundle, started, lambda i: F.lit(10 * i), failures)
    done = calls.filter("tool_index = 4 AND status = 'success'").select(
        "incident_id", "investigation_id", F.col("created_at").alias("tools_at")
    )
    prompts = inv.build_prompts(bundle).join(done, "incident_id").withColumnRenamed("tools_at", "created_at")

    def model(batch: pd.DataFrame, temperature: float, max_tokens: int) -> pd.Series:
        if answer is None:
            raise ConnectionError("model is offline")
        return pd.Series([answer] * len(batch))

    answers = inv.batch_generate(prompts, model).join(done, "incident_id")
    checked = materialize(
        inv.validate_reports(
            answers.withColumns(
                {
                    "provider": F.lit("ollama"),
                    "model": F.lit("m"),
                    "duration_ms": F.lit(500),
                    "created_at": inv.after(F.col("tools_at"), F.lit(500)),
                    "usage": F.struct(
                        F.lit(None).cast("long").alias("promptTokens"),
                        F.lit(7).cast("long").alias("completionTokens"),
                        F.lit(None).cast("long").alias("totalTokens"),
                    ),
                }
            )
        ),
        "checked",
    )
    calls = materialize(calls, "calls")
    steps = materialize(inv.step_timeline(calls, prompts, checked), "steps")
    heads = bundle.select(
        "incident_id",
        inv.investigation_id(F.col("incident_id")).alias("investigation_id"),
        started.alias("started_at"),
        F.lit("ollama").alias("provider"),
        F.lit("m").alias("model"),
        F.lit("incident-investigation-v1").alias("prompt_version"),
        F.lit(None).cast("string").alias("trace_id"),
        started.alias("created_at"),
    )
    state = inv.investigation_status(inv.investigation_events(heads, calls, checked)).drop("started_at")
    investigations = heads.join(state, "investigation_id").withColumnRenamed("investigation_id", "id")
    return calls, checked, steps, materialize(investigations, "investigations")


def test_a_good_answer_is_stored_and_read_back(tables, bundle):
    calls, checked, steps, investigations = investigate(bundle, json.dumps(REPORT))
    assert [r["tool_name"] for r in inv.tool_calls_list(calls).collect()] == TITLES[:4]
    assert [r["title"] for r in inv.steps_list(steps).collect()] == TITLES
    detail = inv.investigation_detail(investigations, tables["incidents"], tables["services"], calls, steps)
    report = rows(inv.investigation_report(detail))[0]
    assert (report["status"], report["service_name"], report["confidence"]) == ("completed", "cart", 0.88)
    assert report["evidence"] == REPORT["evidence"]
    assert report["generated_at"] == datetime(2026, 6, 26, 10, 0, 0, 600_000)
    assert [set(c) for c in report["supporting_tool_calls"]] == [{"tool_name", "status", "latency_ms", "created_at"}] * 4
    timeline = rows(readmodel.timeline_rows(investigations, calls, steps).orderBy("index"))
    assert [r["title"] for r in timeline] == [*TITLES[:4], "LLM", "Final report"]
    assert [r["index"] for r in timeline] == [1, 2, 3, 4, 5, 6]
    generation = rows(observe.generation_rows(checked))[0]
    assert generation["usage"] == {"output": 7} and generation["level"] == "DEFAULT"
    panel = rows(readmodel.trace_panel(investigations, calls))[0]
    assert panel["observations"] == 5 and panel["link"] == "unavailable" and panel["duration"] == "600 ms"


def test_the_template_answer_is_a_valid_report(bundle):
    checked = rows(inv.validate_reports(inv.template_report(bundle)))[0]
    assert checked["reasons"] == [] and len(checked["report"]["evidence"]) == 4
    assert checked["report"]["citedRunbooks"][0]["slug"] == "cart-latency"


def test_an_invalid_answer_fails_the_investigation(tables, bundle):
    calls, _, steps, investigations = investigate(bundle, "not-json")
    assert [r["title"] for r in inv.steps_list(steps).collect()] == [*TITLES[:5], "Invalid model response"]
    state = rows(investigations)[0]
    assert (state["status"], state["summary"], state["latency_ms"]) == ("failed", "Invalid report: json", None)
    detail = rows(inv.investigation_detail(investigations, tables["incidents"], tables["services"], calls, steps))[0]
    assert detail["evidence"] == [] and len(detail["tool_calls"]) == 4


def test_a_failed_tool_ends_the_investigation(spark, bundle):
    incident = bundle.first()["incident_id"]
    failures = spark.createDataFrame([(incident, 2, "store is down")], "incident_id string, tool_index int, error string")
    calls, checked, steps, investigations = investigate(bundle, json.dumps(REPORT), failures)
    assert [(r["tool_name"], r["status"]) for r in inv.tool_calls_list(calls).collect()] == [
        ("query_logs", "success"), ("query_metrics", "error"),
    ]
    assert json.loads(calls.filter("status = 'error'").first()["output"]) == {"error": "store is down"}
    assert [r["title"] for r in steps.collect()] == ["query_logs"]
    assert checked.count() == 0
    state = rows(investigations)[0]
    assert (state["status"], state["summary"]) == ("failed", "store is down")
    spans = {r["name"]: r for r in rows(observe.tool_spans(calls))}
    assert spans["query_metrics"]["level"] == "ERROR" and spans["query_metrics"]["result_count"] is None
    assert spans["query_logs"]["result_count"] == 5


def test_a_failed_model_call_is_a_row(tables, bundle):
    calls, checked, steps, investigations = investigate(bundle, None)
    assert [r["title"] for r in inv.steps_list(steps).collect()] == TITLES[:5]
    state = rows(investigations)[0]
    assert (state["status"], state["summary"], state["latency_ms"]) == ("failed", "model is offline", None)
    generation = rows(observe.generation_rows(checked))[0]
    assert (generation["output"], generation["level"]) == (None, "ERROR")
    assert generation["status_message"] == "model is offline" and not generation["structured_output_success"]
    assert checked.first()["error_name"] == "ConnectionError" and checked.first()["parser_error"] is None


def test_an_error_is_that_of_its_own_prompt(spark):
    prompts = spark.createDataFrame([(i, str(i)) for i in range(40)], "incident_id long, prompt_text string").coalesce(1)

    def model(batch: pd.DataFrame, temperature: float, max_tokens: int) -> pd.Series:
        return batch["prompt_text"].map(lambda text: f"answer {6 // (int(text) % 7)}")

    got = {r["incident_id"]: r for r in rows(inv.batch_generate(prompts, model))}
    assert {i for i, r in got.items() if r["error_name"]} == {0, 7, 14, 21, 28, 35}
    assert all((r["response"] is None) == (r["error_name"] == "ZeroDivisionError") for r in got.values())
    assert got[3]["response"] == "answer 2" and got[7]["error_message"]


def test_the_quote_of_a_template_answer_is_the_whole_passage(bundle):
    passage = bundle.first()["runbooks"][0]["content"]
    made = json.loads(rows(inv.template_report(bundle))[0]["response"])
    assert made["citedRunbooks"][0]["quote"] == passage
