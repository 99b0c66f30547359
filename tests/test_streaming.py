"""Streams give what a batch over the same input gives, also when a trigger is replayed."""

import json

import pytest
from pyspark.sql import functions as F

from faultline.catalog import workspace as ws
from faultline.plans import ingest
from faultline.sources import batches as B
from faultline.sources.changes import FOLDED, FOLDINGS, ChangeLog, stream_name
from faultline.streaming import detect, ingest as stream
from tests.conftest import rows
from tests.test_contract import BATCH, LOG, METRIC, SERVICE


def run(spark, source, log, checkpoint):
    stream.stream_ingest(spark, str(source), log, checkpoint).awaitTermination()


def lines(spark, tmp_path, name, *batches):
    path = tmp_path / f"{name}.json"
    path.write_text("\n".join(map(json.dumps, batches)))
    return spark.read.text(str(path)).selectExpr("_metadata.file_path AS file_path", "value")


def posting(name, at, **service):
    """A batch generated at an hour that names a service, its deployment, a log and an incident."""
    incident = {
        "id": "sc-1", "title": f"from {name}", "serviceName": name, "severity": "sev2", "startedAt": at, "detectedAt": at,
        "detectionReason": "r", "suspectedRootCause": "c", "affectedSignals": ["x"],
    }
    deployment = {
        "serviceName": name, "version": "v1", "commitSha": f"sha-{at}", "deployedBy": "d", "environment": "production",
        "status": "succeeded", "deployedAt": at,
    }
    return {
        **BATCH, "generatedAt": at, "services": [{**SERVICE, "name": name, **service}], "deployments": [deployment],
        "logs": [{**LOG, "serviceName": name}], "incidents": [incident],
    }


EARLY, NOON, LATE = (f"2026-06-26T{h}:00:00.000Z" for h in ("01", "12", "23"))


def contents(log):
    """Everything a reader sees, in any order."""
    tables = {name: log.current(name) for name in FOLDINGS}
    facts = {name: log.facts(name) for name in ("log_entries", "metric_points")}
    tables |= {name: df for name, df in facts.items() if df is not None}
    return {
        name: sorted(str({k: v for k, v in r.items() if k != "attributes"}) for r in rows(df.select(*sorted(df.columns))))
        for name, df in tables.items()
    }


def test_stream_equals_batch(spark, sf, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "store"))
    run(spark, ws.posted_folder(spark, sf), log, str(tmp_path / "checkpoint"))
    raw = B.read_raw(spark, ws.posted_folder(spark, sf))
    tables = {name: spark.createDataFrame([], f.shape) for name, f in FOLDINGS.items()}
    rewritten, appended, _ = ingest.ingest(tables, B.parse(raw))
    for name, want in {**rewritten, **appended}.items():
        got = (log.current(name) if name in FOLDINGS else log.facts(name)).select(*want.columns)
        got, want = (
            df.withColumn("attributes", F.to_json("attributes")) if "attributes" in df.columns else df for df in (got, want)
        )
        assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))
    assert log.facts("rejected").count() == 0


def test_later_files_and_replays(spark, tmp_path):
    source = tmp_path / "posted"
    source.mkdir()
    log, checkpoint = ChangeLog(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint")
    assert log.facts("log_entries") is None and log.current("services").count() == 0
    first = {**BATCH, "logs": [LOG, LOG], "metrics": [METRIC]}
    bad = {**BATCH, "logs": [{**LOG, "level": "x"}]}
    (source / "a.json").write_text(json.dumps(first) + "\n" + json.dumps(bad) + "\n")
    run(spark, source, log, checkpoint)
    assert log.facts("log_entries").count() == 2
    assert [r["field"] for r in log.facts("rejected").collect()] == ["level"]

    later = {**BATCH, "generatedAt": LATE.replace("2026", "2036"), "services": [{**SERVICE, "runtime": "z"}], "logs": [LOG]}
    (source / "b.json").write_text(json.dumps(later))
    run(spark, source, log, checkpoint)
    assert log.facts("log_entries").count() == 3
    assert [r["runtime"] for r in rows(log.current("services"))] == ["z"]

    seen = contents(log)
    again = spark.read.text(str(source / "b.json")).selectExpr("_metadata.file_path AS file_path", "value")
    stream.apply_batch(log, again, checkpoint, 1)  # a replay of a committed trigger
    assert contents(log) == seen


@pytest.mark.parametrize("order", [("A", "B"), ("B", "A")])
def test_interleaved_streams_lose_nothing(spark, tmp_path, monkeypatch, order):
    """Both streams have read the store before either writes; then one writes all, then the other."""
    log = ChangeLog(spark, str(tmp_path / "store"))
    stream.apply_batch(log, lines(spark, tmp_path, "base", posting("base", NOON)), "base", 0)
    sent = {
        "A": lines(spark, tmp_path, "a", posting("svc-a", LATE), posting("base", LATE, runtime="from-a")),
        "B": lines(spark, tmp_path, "b", posting("svc-b", EARLY), posting("base", EARLY, runtime="from-b")),
    }
    plain, waiting = ChangeLog.put, []

    def interrupted(self, table, changes, name, epoch):
        """The second stream runs as a whole while the first is about to write."""
        if waiting:
            stream.apply_batch(log, sent[waiting[0]], waiting.pop(), 0)
        plain(self, table, changes, name, epoch)

    waiting.append(order[1])
    monkeypatch.setattr(ChangeLog, "put", lambda *a: plain(*a) if not waiting else interrupted(*a))
    stream.apply_batch(log, sent[order[0]], order[0], 0)
    monkeypatch.setattr(ChangeLog, "put", plain)
    services = {r["name"]: r["runtime"] for r in rows(log.current("services"))}
    assert set(services) == {"base", "svc-a", "svc-b"} and services["base"] == "from-a"  # posted last
    deployed = {r["commit_sha"] for r in rows(log.current("deployments"))}
    assert deployed == {f"sha-{LATE}", f"sha-{EARLY}"} and log.current("deployments").count() == 3
    assert [r["title"] for r in rows(log.current("incidents"))] in (["from svc-b"], ["from base"])  # posted first
    assert {r["detected_at"].hour for r in rows(log.current("incidents"))} == {1}
    assert log.facts("log_entries").count() == 5
    seen = contents(log)
    for name in ("A", "B", "A"):  # replays, also of what others have written after
        stream.apply_batch(log, sent[name], name, 0)
    assert contents(log) == seen


def test_tombstones_and_compaction(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "store"))
    for epoch, at in enumerate((EARLY, NOON)):
        batches = [posting(name, at, runtime=f"r{epoch}") for name in ("one", "two")]
        stream.apply_batch(log, lines(spark, tmp_path, f"p{epoch}", *batches), "posts", epoch)
    log.remove("services", spark.createDataFrame([("two",)], "name string"), "admin", 0, LATE)
    log.remove("incidents", spark.createDataFrame([("sc-1",)], "scenario_id string"), "admin", 0, EARLY)
    assert [(r["name"], r["runtime"]) for r in rows(log.current("services"))] == [("one", "r1")]
    assert [r["detected_at"].hour for r in rows(log.current("incidents"))] == [12]  # the next one after the removal
    seen = contents(log)
    for table in FOLDINGS:
        log.compact(table, {"posts": 0, "admin": 0})
    assert contents(log) == seen
    left = {(r.stream, r.epoch) for r in log.changes("services").select("stream", "epoch").distinct().collect()}
    assert left == {(FOLDED, 0), (stream_name("posts"), 1)}
    for table in FOLDINGS:  # a compaction of what was compacted, and of the rest
        log.compact(table, {"posts": 1})
    assert contents(log) == seen
    assert log.changes("services").count() == 2  # a row and a tombstone
    # What comes late but was posted before the removal stays removed; a later posting brings it back.
    stream.apply_batch(log, lines(spark, tmp_path, "late", posting("two", NOON)), "slow", 0)
    assert {r["name"] for r in rows(log.current("services"))} == {"one"}
    new = posting("two", "2026-06-27T01:00:00.000Z", runtime="new")
    stream.apply_batch(log, lines(spark, tmp_path, "new", new), "slow", 1)
    assert {r["name"]: r["runtime"] for r in rows(log.current("services"))} == {"one": "r1", "two": "new"}


def test_equal_lines_are_batches_of_their_own(spark, tmp_path):
    source = tmp_path / "posted"
    source.mkdir()
    line = json.dumps({**BATCH, "logs": [LOG]})
    (source / "a.json").write_text("\n".join([line, line, line]))
    log = ChangeLog(spark, str(tmp_path / "store"))
    run(spark, source, log, str(tmp_path / "checkpoint"))
    logs = log.facts("log_entries")
    assert logs.count() == 3 and logs.select("id").distinct().count() == 3
    run(spark, source, log, str(tmp_path / "checkpoint-new"))  # a new checkpoint posts its folder anew
    assert log.facts("log_entries").count() == 6


def test_windows_equal_a_batch_group_by(spark, sf, tmp_path):
    posts = tmp_path / "signals"
    e = spark.read.parquet(f"{sf}/events.parquet")
    shape = "service_id long, at timestamp_ntz, latency double, is_error boolean"
    signals = e.select(
        F.col("user_id").alias("service_id"), F.col("ts").alias("at"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("latency"),
        (F.col("event_type") == "error").alias("is_error"),
    )
    signals.repartition(3).write.parquet(str(posts))
    # One late row closes the windows before it.
    spark.createDataFrame([(0, None, 0.0, False)], shape).select(
        "service_id", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("at"), "latency", "is_error"
    ).write.mode("append").parquet(str(posts))
    source = spark.readStream.schema(shape).parquet(str(posts))
    target = str(tmp_path / "windows")
    detect.stream_detect(
        source, target, str(tmp_path / "checkpoint"), window="1 hour", threshold=None
    ).awaitTermination()
    got = spark.read.parquet(target)
    want = detect.window_signals(signals, "1 hour")
    assert sorted(map(str, rows(got.select(*want.columns)))) == sorted(map(str, rows(want)))
    assert got.agg(F.sum("errors")).first()[0] == signals.filter("is_error").count()
