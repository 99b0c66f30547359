"""The small incident through evidence, detection and look-ups, and rules of stored rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.operators import detect, evidence, keyed, lookup
from faultline.plans import ingest, observe
from faultline.plans import investigate as inv
from tests import incident as I
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    logs = [(k, s, I.at(clock), level, "m", "{}") for k, s, clock, level in I.LOGS]
    metrics = [(k, s, I.at(clock), name, unit, value) for k, s, clock, name, unit, value in I.METRICS]
    deployments = [
        (k, s, version, "c", "bot", "production", "succeeded", I.at(clock), "{}") for k, s, version, clock in I.DEPLOYMENTS
    ]
    incident = [("i1", 1, "slow", "sev2", "detected", I.at(I.DETECTED), I.at(I.STARTED), "p95 high", None, "{}")]
    return {
        "services": make(I.SERVICES, "id int, name string"),
        "logs": make(logs, "id string, service_id int, timestamp timestamp_ntz, level string, message string, attributes string"),
        "metrics": make(metrics, "id string, service_id int, timestamp timestamp_ntz, metric_name string, unit string, metric_value double"),
        "deployments": make(
            deployments,
            "id string, service_id int, version string, commit_sha string, deployed_by string, environment string, "
            "status string, deployed_at timestamp_ntz, metadata string",
        ),
        "incidents": make(
            incident,
            "id string, service_id int, title string, severity string, status string, detected_at timestamp_ntz, "
            "started_at timestamp_ntz, detection_reason string, suspected_root_cause string, metadata string",
        ),
    }


def test_window(tables):
    span = rows(evidence.incident_spans(tables["incidents"]))[0]
    assert span["opens"] == I.at("13:35:00") and span["closes"] == I.at("14:35:00")


def test_both_ends_of_the_window_count(tables):
    got = rows(evidence.incident_logs(tables["incidents"], tables["logs"]).orderBy("rank"))
    assert [(r["id"], r["rank"]) for r in got] == [("l2", 1), ("l3", 2), ("l4", 3), ("l5", 4), ("l6", 5)]


def test_metrics(tables):
    got = {r["metric_name"]: r for r in rows(evidence.incident_metric_summary(tables["incidents"], tables["metrics"]))}
    assert {n: (r["min"], r["max"], r["avg"], r["samples"]) for n, r in got.items()} == {
        "p95_latency_ms": (300.0, 2400.0, 1400.0, 3),
        "http_error_rate": (0.25, 0.5, 0.375, 2),
    }


def test_deployments(tables):
    got = rows(evidence.incident_deployments(tables["incidents"], tables["deployments"]).orderBy("rank"))
    assert [(r["version"], r["deployed_at"]) for r in got] == [("v7", I.at("13:50:00")), ("v6", I.at("10:00:00"))]
    last = rows(evidence.last_deployment_before(tables["incidents"], tables["deployments"]))[0]
    assert (last["deployment_id"], last["gap_seconds"]) == ("d1", 900.0)


def test_signals(tables):
    signals = detect.service_signals(tables["services"], tables["metrics"], tables["logs"])
    got = {r["service_name"]: (r["max_latency"], r["errors"], r["fanout_errors"]) for r in rows(signals)}
    # Three errors beside four latencies of the cart.
    assert got["cart"] == (2400.0, 3, 12) and got["mail"][:2] == (1900.0, 0) and got["feed"][:2] == (200.0, 1)
    assert [r["service_name"] for r in rows(detect.detect_incidents(signals))] == ["cart"]


def test_detection_boundary(spark):
    df = spark.createDataFrame(
        [("a", 1200.0, 1), ("b", 1199.9, 1), ("c", 9999.0, 0), ("d", None, 5)],
        "service_name string, max_latency double, errors long",
    )
    assert [r["service_name"] for r in rows(detect.detect_incidents(df))] == ["a"]


def test_scenarios_are_inserted_once(spark):
    empty = spark.createDataFrame([], ingest.INCIDENTS)
    detections = spark.createDataFrame([("s", "rec")], "service_id string, service_name string")
    at = F.lit("2026-06-26 09:58:00").cast("timestamp_ntz")
    once = detect.detections_to_incidents(detections, empty, at)
    twice = detect.detections_to_incidents(detections, once, F.lit("2026-06-27 00:00:00").cast("timestamp_ntz"))
    assert rows(once) == rows(twice)
    assert rows(once)[0]["severity"] == "sev2" and rows(once)[0]["status"] == "detected"


def test_status_keeps_three_decimals(spark):
    at = datetime(2026, 6, 26, 10)
    events = spark.createDataFrame(
        [
            ("i", at, 0, "running", None, None, None),
            ("i", at + timedelta(milliseconds=1234), 1, "completed", "s", "c", 0.8765),
            ("j", at, 0, "running", None, None, None),
            ("j", at, 1, "failed", "tool broke", None, None),
            ("k", at, 0, "running", None, None, None),
        ],
        "investigation_id string, at timestamp_ntz, seq int, status string, summary string, "
        "probable_root_cause string, confidence double",
    )
    got = {r["investigation_id"]: r for r in rows(inv.investigation_status(events))}
    assert str(got["i"]["confidence_score"]) == "0.877" and got["i"]["latency_ms"] == 1234
    assert (got["j"]["status"], got["j"]["summary"], got["j"]["latency_ms"]) == ("failed", "tool broke", None)
    assert got["k"]["status"] == "running" and got["k"]["completed_at"] is None


def test_usage(spark):
    df = spark.createDataFrame(
        [
            (1, "ollama", 42, 9, None, 0, ""),
            (2, "gemini", 12, 6, 18, 0, ""),
            (3, "gemini", None, 6, None, 0, ""),
            (4, "ollama", None, 9, None, 15, "x"),
        ],
        "id int, provider string, reported_prompt long, reported_completion long, reported_total long, "
        "prompt_tokens long, completion string",
    )
    got = {r["id"]: tuple(r["usage"].values()) for r in rows(observe.normalize_usage(df))}
    assert got == {1: (42, 9, 51, False), 2: (12, 6, 18, False), 3: (0, 6, 6, False), 4: (15, 1, 16, True)}


def test_error_codes(spark):
    df = spark.createDataFrame(
        [
            (1, "gemini", False, True, None, "", False),
            (2, "gemini", True, True, None, "", False),
            (3, "ollama", True, False, None, "", False),
            (4, "ollama", True, False, 404, "", False),
            (5, "ollama", True, False, 500, "Model x is gone", False),
            (6, "ollama", True, False, 500, "entry Not Found", False),
            (7, "ollama", True, False, 500, "overload", False),
            (8, "gemini", True, False, 404, "model", False),
            (9, "gemini", True, False, 200, "model", False),
            (10, "ollama", True, False, 200, "", True),
        ],
        "id int, provider string, has_credential boolean, aborted boolean, http_status int, body string, parsed boolean",
    )
    got = {r["id"]: r["error_code"] for r in rows(observe.classify_llm_errors(df))}
    assert got == {
        1: "provider_disabled", 2: "provider_timeout", 3: "provider_unavailable", 4: "model_missing",
        5: "model_missing", 6: "model_missing", 7: "provider_unavailable", 8: "provider_unavailable",
        9: "bad_response", 10: None,
    }


def test_log_search_filters(tables):
    def found(**filters):
        return lookup.log_search(tables["logs"], tables["services"], **filters)

    assert found().count() == found(service="", level="", start="", end="").count() == 9
    assert found(limit=0).count() == 0
    assert sorted(r["id"] for r in found(service="cart", level="error").collect()) == ["l4", "l5", "l6"]
    assert sorted(r["id"] for r in found(start="2025-03-04 14:35:00").collect()) == ["l6", "l7"]
    assert sorted(r["id"] for r in found(end="2025-03-04 13:35:00").collect()) == ["l1", "l2"]
    assert [r["id"] for r in found(limit=3).collect()] == ["l7", "l6", "l5"]


def test_log_search_is_capped_at_500(spark, tables):
    many = spark.range(700).select(
        F.concat(F.lit("m"), "id").alias("id"), F.lit(1).alias("service_id"),
        F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"),
        F.lit("info").alias("level"), F.lit("m").alias("message"), F.lit("{}").alias("attributes"),
    )
    assert lookup.log_search(many, tables["services"], limit=9999).count() == 500
    assert lookup.log_search(many, tables["services"]).count() == 100


def test_service_lookup_prefers_the_id(spark):
    services = spark.createDataFrame([(1, "2"), (2, "x")], "id int, name string")
    keys = spark.createDataFrame([("2",), ("x",), ("nobody",)], "key string")
    got = {r["key"]: r["id"] for r in rows(lookup.service_lookup(services, keys))}
    assert got == {"2": 2, "x": 2}


def test_text_search(spark):
    listed = spark.createDataFrame(
        [(1, "Rec", "sev2", "detected", "Latency Spike"), (2, "Chat", "sev1", "closed", "Errors")],
        "id int, service_name string, severity string, status string, title string",
    )
    ids = lambda *a: [r["id"] for r in rows(lookup.incident_text_search(listed, *a).orderBy("id"))]
    assert ids() == [1, 2]
    assert ids("LATENCY") == [1]
    assert ids("rec sev2 detected lat") == [1]
    assert ids("", "sev1") == [2]
    assert ids("latency", "sev1") == []


def test_cascade_delete(spark):
    make = spark.createDataFrame
    tables = {
        "runbooks": make([(1,), (2,)], "id int"),
        "runbook_chunks": make([(10, 1), (11, 2), (12, 1)], "id int, runbook_id int"),
    }
    left = keyed.cascade_delete(tables, "runbooks", make([(1,)], "id int"))
    assert [r["id"] for r in left["runbooks"].collect()] == [2]
    assert [r["id"] for r in left["runbook_chunks"].collect()] == [11]


def test_report_text(spark):
    df = spark.createDataFrame(
        [("inv", "spike", "rec", 0.885, None, "cause", [("metric", "d")], [(None, "slug")], ["look"]),
         (None, None, None, None, "sum", None, [], [], None)],
        "investigation_id string, incident_title string, service_name string, confidence double, summary string, "
        "probable_root_cause string, evidence array<struct<source:string,detail:string>>, "
        "cited_runbooks array<struct<title:string,slug:string>>, recommended_next_diagnostics array<string>",
    )
    full, bare = (r["text"].split("\n") for r in inv.report_text(df, "Demo").collect())
    assert full == [
        "Demo", "====", "Investigation: inv", "Incident: spike", "Service: rec", "Confidence: 0.89", "", "Summary",
        "No summary returned.", "", "Probable root cause", "cause", "", "Evidence", "- [metric] d", "",
        "Cited runbooks", "- slug", "", "Recommended next diagnostics", "- look",
    ]
    assert bare[2:6] == ["Investigation: unknown", "Incident: unknown", "Service: unknown", "Confidence: unknown"]
    assert bare[-1] == "- none" and bare[13] == "Evidence" and bare[14] == ""
