"""Key-based writes: replays, update policies, unknown names, and the join for large look-ups."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline import session
from faultline.functions import display
from faultline.operators import keyed, lookup
from faultline.plans import ingest
from faultline.sources import batches as B
from faultline.sources.changes import ChangeLog
from tests.conftest import rows
from tests.test_contract import BATCH, DEPLOYMENT, INCIDENT, LOG, METRIC, SERVICE


def typed(spark, *batches):
    import json

    texts = [(f"b{i}", json.dumps(b)) for i, b in enumerate(batches)]
    return B.parse(spark.createDataFrame(texts, "batch_id string, value string"))


def empty(spark):
    return {
        "services": spark.createDataFrame([], ingest.SERVICES),
        "deployments": spark.createDataFrame([], ingest.DEPLOYMENTS),
        "incidents": spark.createDataFrame([], ingest.INCIDENTS),
    }


FULL = {**BATCH, "deployments": [DEPLOYMENT], "logs": [LOG, LOG], "metrics": [METRIC], "incidents": [INCIDENT]}


def test_a_batch_becomes_rows(spark):
    rewritten, appended, summary = ingest.ingest(empty(spark), typed(spark, FULL))
    assert rows(summary) == [{"insertedLogs": 2, "insertedMetrics": 1, "incidents": 1}]
    log = rows(appended["log_entries"])[0]
    assert log["timestamp"] == datetime(2026, 6, 26, 9, 45) and log["deployment_id"] is None
    assert rows(rewritten["incidents"])[0]["metadata"] == {
        "scenarioId": "s1", "affectedSignals": [], "synthetic": True,
    }


def test_a_batch_posted_twice_doubles_facts_only(spark):
    rewritten, appended, summary = ingest.ingest(empty(spark), typed(spark, FULL, FULL))
    assert rows(summary) == [{"insertedLogs": 4, "insertedMetrics": 2, "incidents": 2}]
    assert appended["log_entries"].count() == 4 and appended["metric_points"].count() == 2
    assert rewritten["services"].count() == rewritten["deployments"].count() == 1
    assert rewritten["incidents"].count() == 1


def test_stored_incidents_count_but_do_not_change(spark):
    first, _, _ = ingest.ingest(empty(spark), typed(spark, FULL))
    changed = {**FULL, "incidents": [{**INCIDENT, "title": "other"}], "logs": [], "metrics": []}
    again, _, summary = ingest.ingest({**empty(spark), **first}, typed(spark, changed))
    assert rows(summary) == [{"insertedLogs": 0, "insertedMetrics": 0, "incidents": 1}]
    assert [r["title"] for r in rows(again["incidents"])] == ["t"]


def test_rows_of_unknown_services_drop_out_uncounted(spark):
    batch = {**FULL, "logs": [LOG, {**LOG, "serviceName": "ghost"}], "incidents": [{**INCIDENT, "serviceName": "ghost"}]}
    rewritten, appended, summary = ingest.ingest(empty(spark), typed(spark, batch))
    assert rows(summary) == [{"insertedLogs": 1, "insertedMetrics": 1, "incidents": 0}]
    assert appended["log_entries"].count() == 1 and rewritten["incidents"].count() == 0


def test_later_rows_win_and_ids_stay(spark):
    first, _, _ = ingest.ingest(empty(spark), typed(spark, FULL))
    old = rows(first["services"])[0]["id"]
    posts = {**BATCH, "services": [{**SERVICE, "runtime": "a"}, {**SERVICE, "runtime": "b"}]}
    again, _, _ = ingest.ingest({**empty(spark), **first}, typed(spark, posts))
    assert [(r["id"], r["runtime"]) for r in rows(again["services"])] == [(old, "b")]
    assert again["deployments"].count() == 1


def test_log_finds_its_deployment(spark):
    batch = {**FULL, "logs": [{**LOG, "deploymentVersion": "1"}, {**LOG, "deploymentVersion": "9"}]}
    rewritten, appended, _ = ingest.ingest(empty(spark), typed(spark, batch))
    deployment = rows(rewritten["deployments"])[0]["id"]
    assert sorted(r["deployment_id"] or "" for r in rows(appended["log_entries"])) == ["", deployment]


def test_missing_arrays_are_empty(spark):
    batches = typed(spark, BATCH)
    assert {name: df.count() for name, df in B.split(batches).items()} == {
        "services": 1, "deployments": 0, "logs": 0, "metrics": 0, "incidents": 0,
    }


def test_files_with_one_batch_or_many(spark, tmp_path):
    import json

    (tmp_path / "lines").mkdir()
    (tmp_path / "whole").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(json.dumps(b) for b in (FULL, BATCH)))
    for i, b in enumerate((FULL, BATCH)):
        (tmp_path / "whole" / f"{i}.json").write_text(json.dumps(b, indent=2))
    lines = B.read_telemetry(spark, str(tmp_path / "lines"))
    whole = B.read_telemetry(spark, str(tmp_path / "whole"), one_per_file=True)
    for name in B.SECTIONS:
        assert B.section(lines, name).count() == B.section(whole, name).count()
    assert B.section(whole, "logs").count() == 2
    raw = B.read_raw(spark, str(tmp_path / "whole"), one_per_file=True)
    assert B.contract_violations(raw).count() == 0 and B.parse(raw).count() == 2


def test_runbook_policies(spark):
    shape = "id int, title string, slug string, body string, source_path string, version int, updated_at string"
    target = spark.createDataFrame([(1, "old", "a", "old body", "p", 1, "t0"), (2, "keep", "b", "b", "p", 1, "t0")], shape)
    source = spark.createDataFrame(
        [(9, "new", "a", "new body", "q", 2, "t1", 0), (3, "new", "c", "c", "q", 2, "t1", 0)], shape + ", batch_seq int"
    )
    full = {r["slug"]: tuple(r.values()) for r in rows(keyed.upsert_runbooks(target, source))}
    body = {r["slug"]: tuple(r.values()) for r in rows(keyed.upsert_runbooks(target, source, body_only=True))}
    assert full["a"] == (1, "new", "a", "new body", "q", 2, "t1")
    assert body["a"] == (1, "old", "a", "new body", "p", 1, "t1")
    assert full["b"] == body["b"] == (2, "keep", "b", "b", "p", 1, "t0")
    assert full["c"] == body["c"] == (3, "new", "c", "c", "q", 2, "t1")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_large_look_ups_are_salted_with_the_same_result(spark, how, monkeypatch):
    monkeypatch.setattr(session, "HOT_ROWS", 500)
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    dim = spark.range(0, 40).select(F.col("id").cast("long").alias("k"), (F.col("id") * 2).alias("v"))
    small = session.lookup_join(facts, dim, ["k"], how, spread=["id"])
    large = session.lookup_join(facts, dim, ["k"], how, spread=["id"], rows=3)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    monkeypatch.setattr(session, "HOT_ROWS", 5000)
    plain = session.lookup_join(facts, dim, ["k"], how, spread=["id"], rows=3)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, plain.collect()))
    assert "_salt" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_hot_facts_spread_over_many_salts(spark):
    facts = spark.range(3000).select("id", session.salt(["id"], session.SALTS).alias("s"))
    assert facts.select("s").distinct().count() == session.SALTS


def test_integrity_of_sound_tables(spark):
    rewritten, appended, _ = ingest.ingest(empty(spark), typed(spark, FULL))
    assert keyed.check_integrity({**rewritten, **appended}).count() == 0


def test_integrity_ignores_null_keys(spark):
    make = spark.createDataFrame
    found = rows(
        keyed.check_integrity(
            {
                "services": make([("a", "n"), ("b", "n"), (None, None)], "id string, name string"),
                "runbooks": make([("r", None, "s"), ("q", "zz", "s"), ("x", "a", None)], "id string, service_id string, slug string"),
                "evaluations": make([("e", 1.5), ("f", 1.0), ("g", None)], "id string, overall_score double"),
            }
        ).orderBy("table_name", "rule", "columns")
    )
    assert [tuple(r.values()) for r in found] == [
        ("evaluations", "range", "overall_score", 1),
        ("runbooks", "foreign_key", "service_id", 1),
        ("runbooks", "not_null", "slug", 1),
        ("runbooks", "unique", "slug", 2),
        ("services", "not_null", "id", 1),
        ("services", "not_null", "name", 1),
        ("services", "unique", "name", 2),
    ]


def test_display_rules(spark):
    values = [0.875, 0.615, 0.125, 0.995, 1.0, 0.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    assert [r["x"] for r in df.select(display.two_decimals(F.col("v")).alias("x")).collect()] == [
        "0.88", "0.61", "0.13", "0.99", "1.00", "0.00", None,
    ]
    assert [r["x"] for r in df.select(display.percent(F.col("v")).alias("x")).collect()] == [
        "88%", "62%", "13%", "100%", "100%", "0%", display.DASH,
    ]
    states = ["Failed", "completed", "ok", "unavailable", "running", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(states)], "i int, s string").orderBy("i")
    assert [r["x"] for r in df.select(display.status_class(F.col("s")).alias("x")).collect()] == [
        "error", "success", "success", "success", "muted", "muted",
    ]


def test_runbooks_without_a_service_are_listed(spark):
    runbooks = spark.createDataFrame(
        [(1, 5, "t", "b", "x"), (2, None, "t", "a", "x")], "id int, service_id int, title string, slug string, body string"
    )
    services = spark.createDataFrame([(5, "rec")], "id int, name string")
    assert [(r["slug"], r["service_name"]) for r in rows(lookup.runbook_list(runbooks, services))] == [
        ("a", None), ("b", "rec"),
    ]


def test_facts_are_stored_by_day_and_read_by_day(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "store"))
    rewritten, appended, _ = ingest.ingest(
        empty(spark),
        typed(spark, {**FULL, "logs": [LOG, {**LOG, "timestamp": "2026-06-27T01:00:00Z"}]}),
    )
    log.write("log_entries", appended["log_entries"], "posts", 1)
    logs = log.facts("log_entries")
    found = lookup.log_search(logs, rewritten["services"], start="2026-06-27 00:00:00")
    assert [r["timestamp"] for r in found.collect()] == [datetime(2026, 6, 27, 1)]
    assert "day" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_scratch_lies_in_the_shared_folder(spark):
    import os

    session.materialize(spark.range(3), "probe")
    folder = f"{session.shared_dir(spark)}/faultline/{spark.sparkContext.applicationId}"
    assert os.path.isdir(folder.removeprefix("file:"))


def test_look_ups_are_measured_in_rows_and_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abc", [1.0, 2.0]), (2, None, None)], "a int, b string, c array<double>")
    assert session.measure(df) == (2, 16 + 3 + 16)
    assert session.fits_broadcast(df) and not session.fits_broadcast(df, rows=1)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 10)
    assert not session.fits_broadcast(df)
