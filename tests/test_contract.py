"""Contract and report checks: what passes, what fails, and what a failure is called."""

import json

import pytest
from pyspark.sql import functions as F

from faultline.plans import investigate as inv
from faultline.sources import batches as B
from tests.conftest import rows

SERVICE = dict(
    name="rec", displayName="Rec", description="d", ownerTeam="t", runtime="go", criticality="high"
)
DEPLOYMENT = dict(
    serviceName="rec", version="1", commitSha="c", deployedBy="bot", environment="production",
    status="succeeded", deployedAt="2026-06-26T09:42:00Z", metadata={"risk": "low"},
)
LOG = dict(
    serviceName="rec", timestamp="2026-06-26T09:45:00.000Z", level="info", message="m",
    attributes={"a": "x", "b": 1.5, "c": True},
)
METRIC = dict(
    serviceName="rec", timestamp="2026-06-26T09:45:00.000Z", metricName="p95_latency_ms", metricValue=3, unit="ms"
)
INCIDENT = dict(
    id="s1", title="t", serviceName="rec", severity="sev2", startedAt="2026-06-26T09:47:00.000Z",
    detectedAt="2026-06-26T09:58:00.000Z", detectionReason="r", suspectedRootCause="c",
)
BATCH = dict(generatedAt="2026-06-26T10:00:00.000Z", services=[SERVICE])


def check(spark, *documents, **kwargs):
    texts = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    raw = spark.createDataFrame(texts, "batch_id int, value string")
    return {
        (r["batch_id"], r["section"], r["ordinal"], r["field"])
        for r in B.contract_violations(raw, **kwargs).collect()
    }


def test_minimal_and_full_batches_pass(spark):
    full = {**BATCH, "deployments": [DEPLOYMENT], "logs": [LOG], "metrics": [METRIC], "incidents": [INCIDENT]}
    full["unknownKey"] = 1
    assert check(spark, BATCH, full) == set()


CASES = [
    ("not json", "batch", None, "json"),
    ({"services": [SERVICE]}, "batch", None, "generatedAt"),
    ({**BATCH, "generatedAt": "2026-06-26 10:00:00"}, "batch", None, "generatedAt"),
    ({**BATCH, "generatedAt": "2026-02-30T10:00:00Z"}, "batch", None, "generatedAt"),
    ({**BATCH, "generatedAt": "2026-06-26T10:00:00+02:00"}, "batch", None, "generatedAt"),
    ({**BATCH, "generatedAt": "2026-06-26T24:00:00Z"}, "batch", None, "generatedAt"),
    ({**BATCH, "services": []}, "batch", None, "services"),
    ({**BATCH, "services": "x"}, "batch", None, "services"),
    ({**BATCH, "logs": None}, "batch", None, "logs"),
    ({**BATCH, "logs": {}}, "batch", None, "logs"),
    ({**BATCH, "services": [SERVICE, {**SERVICE, "name": ""}]}, "services", 1, "name"),
    ({**BATCH, "services": [{**SERVICE, "criticality": "severe"}]}, "services", 0, "criticality"),
    ({**BATCH, "services": [{**SERVICE, "runtime": 5}]}, "services", 0, "runtime"),
    ({**BATCH, "deployments": [{**DEPLOYMENT, "environment": "staging"}]}, "deployments", 0, "environment"),
    ({**BATCH, "deployments": [{**DEPLOYMENT, "status": "done"}]}, "deployments", 0, "status"),
    ({**BATCH, "deployments": [{**DEPLOYMENT, "metadata": {"risk": 1}}]}, "deployments", 0, "metadata"),
    ({**BATCH, "deployments": [{**DEPLOYMENT, "metadata": None}]}, "deployments", 0, "metadata"),
    ({**BATCH, "logs": [{**LOG, "message": 5}]}, "logs", 0, "message"),
    ({**BATCH, "logs": [{**LOG, "level": "trace"}]}, "logs", 0, "level"),
    ({**BATCH, "logs": [{**LOG, "deploymentVersion": ""}]}, "logs", 0, "deploymentVersion"),
    ({**BATCH, "logs": [{**LOG, "traceId": None}]}, "logs", 0, "traceId"),
    ({**BATCH, "logs": [{**LOG, "attributes": {"a": None}}]}, "logs", 0, "attributes"),
    ({**BATCH, "logs": [{**LOG, "attributes": {"a": [1]}}]}, "logs", 0, "attributes"),
    ({**BATCH, "logs": [{**LOG, "attributes": ["a"]}]}, "logs", 0, "attributes"),
    ({**BATCH, "metrics": [{**METRIC, "metricValue": "3"}]}, "metrics", 0, "metricValue"),
    ({**BATCH, "metrics": [{**METRIC, "metricValue": True}]}, "metrics", 0, "metricValue"),
    ({**BATCH, "incidents": [{**INCIDENT, "severity": "sev5"}]}, "incidents", 0, "severity"),
    ({**BATCH, "incidents": [{**INCIDENT, "affectedSignals": ["a", 1]}]}, "incidents", 0, "affectedSignals"),
]


def test_each_broken_rule_is_named(spark):
    got = check(spark, *[case[0] for case in CASES])
    assert got == {(i, *case[1:]) for i, case in enumerate(CASES)}


def test_a_row_that_is_no_object_fails_every_required_field(spark):
    got = check(spark, {**BATCH, "services": ["x"]})
    assert got == {(0, "services", 0, f) for f in SERVICE}


def test_a_log_batch_needs_a_log(spark):
    raw = spark.createDataFrame(
        [(0, '{"logs":[]}'), (1, json.dumps({"logs": [LOG]})), (2, "{}")], "batch_id int, value string"
    )
    assert {(r["batch_id"], r["field"]) for r in B.logs_violations(raw).collect()} == {(0, "logs"), (2, "logs")}


def test_one_bad_row_rejects_its_whole_batch(spark):
    bad = {**BATCH, "logs": [LOG, {**LOG, "level": "x"}]}
    raw = spark.createDataFrame([(0, json.dumps(BATCH)), (1, json.dumps(bad))], "batch_id int, value string")
    good, rejected = B.accept(raw, B.contract_violations(raw))
    assert [r["batch_id"] for r in good.collect()] == [0]
    assert [r["batch_id"] for r in rejected.collect()] == [1]


REPORT = dict(
    summary="s", probableRootCause="c", confidence=0.88,
    evidence=[dict(source="metric", reference="p95_latency_ms", detail="d")],
    citedRunbooks=[dict(title="t", slug="s", chunkId="1", quote="q")],
    recommendedNextDiagnostics=["look"],
)
EVIDENCE = REPORT["evidence"][0]
CITATION = REPORT["citedRunbooks"][0]


@pytest.mark.parametrize(
    "change, reasons",
    [
        ({}, []),
        ({"confidence": 1}, []),
        ({"confidence": 0}, []),
        ({"citedRunbooks": [], "recommendedNextDiagnostics": [], "extra": 1}, []),
        ({"citedRunbooks": [{k: v for k, v in CITATION.items() if k != "chunkId"}]}, []),
        ({"confidence": 1.2}, ["confidence"]),
        ({"confidence": "0.5"}, ["confidence"]),
        ({"evidence": []}, ["evidence"]),
        ({"evidence": [{**EVIDENCE, "source": "trace"}]}, ["evidence"]),
        ({"evidence": [EVIDENCE, {**EVIDENCE, "detail": ""}]}, ["evidence"]),
        ({"summary": 5, "probableRootCause": ""}, ["summary", "probableRootCause"]),
        ({"citedRunbooks": [{**CITATION, "chunkId": None}]}, ["citedRunbooks"]),
        ({"citedRunbooks": None}, ["citedRunbooks"]),
        ({"recommendedNextDiagnostics": [""]}, ["recommendedNextDiagnostics"]),
    ],
)
def test_reports(spark, change, reasons):
    df = spark.createDataFrame([("i", json.dumps({**REPORT, **change}))], "investigation_id string, response string")
    got = rows(inv.validate_reports(df))[0]
    assert got["reasons"] == reasons
    assert (got["report"] is not None) == (got["parser_error"] is None) == (not reasons)


def test_text_that_is_no_json(spark):
    df = spark.createDataFrame(
        [("a", "not-json"), ("b", "[1]"), ("c", None), ("d", "")], "investigation_id string, response string"
    )
    got = {r["investigation_id"]: r for r in rows(inv.validate_reports(df))}
    assert got["a"]["reasons"] == got["c"]["reasons"] == got["d"]["reasons"] == ["json"]
    assert got["b"]["reasons"] == list(inv.REPORT_RULES)


def test_invalid_answer_becomes_step_six(spark):
    df = spark.createDataFrame([("i", "not-json")], "investigation_id string, response string")
    checked = inv.validate_reports(df).withColumn("created_at", F.lit("2026-06-26 10:00:00").cast("timestamp_ntz"))
    step = rows(inv.capture_invalid(checked))[0]
    assert (step["step_index"], step["step_type"], step["title"], step["content"]) == (
        6, "observation", "Invalid model response", "not-json",
    )


def test_the_last_of_two_equal_keys_counts(spark):
    text = json.dumps(BATCH)
    good = text[:-1] + ', "generatedAt": "2026-06-26T10:00:00Z"}'
    bad = text[:-1] + ', "generatedAt": 5}'
    assert check(spark, good, bad) == {(1, "batch", None, "generatedAt")}
