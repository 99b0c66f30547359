"""What streams keep up to date: episodes of incidents, and signals per service and day."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import detect
from faultline.plans import signals
from faultline.sources.changes import ChangeLog, stream_name
from faultline.streaming import episodes
from tests.conftest import rows

SHAPE = "service_id string, at timestamp, latency double, is_error boolean"
HOW = {"window": "10 minutes", "quiet": "30 minutes", "threshold": 50.0}


def signal_table(spark, folder):
    """Two days of signals of five services, in order, then one row that moves the watermark on."""
    rng = random.Random(4)
    made = []
    for minute in range(0, 2 * 24 * 60, 7):
        for service in "abcde":
            if rng.random() < 0.35:
                breach = (minute // 240) % 3 == ord(service) % 3
                made.append((service, minute, rng.uniform(40, 90) if breach else 10.0, breach and rng.random() < 0.7))
    parts = [[r for r in made if k * 900 <= r[1] < (k + 1) * 900] for k in range(4)]
    for k, part in enumerate(parts):
        part = part if k < 3 else [*part, ("z", 5 * 24 * 60, 0.0, False)]
        df = spark.createDataFrame(part, "service_id string, minute int, latency double, is_error boolean")
        at = F.timestamp_seconds(F.lit(1_700_000_000 // 86400 * 86400) + F.col("minute") * 60).alias("at")
        df.select("service_id", at, "latency", "is_error").coalesce(1).write.parquet(f"{folder}/part={k}")


@pytest.mark.parametrize("per_trigger", [1, 4])
def test_episodes_equal_islands_over_all_windows(spark, tmp_path, per_trigger):
    posts, target, checkpoint = (str(tmp_path / n) for n in ("posts", "target", "checkpoint"))
    signal_table(spark, posts)
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", per_trigger).parquet(f"{posts}/*")
    episodes.stream_episodes(stream, target, checkpoint, **HOW).awaitTermination()
    written = spark.read.schema(episodes.ROWS).parquet(target)
    got = episodes.latest_episodes(written)
    want = episodes.batch_episodes(spark.read.schema(SHAPE).parquet(f"{posts}/*"), **HOW)
    shown = [c for c in want.columns]
    assert sorted(map(str, rows(got.where("state = 'closed'").select(*shown)))) == sorted(map(str, rows(want.select(*shown))))
    assert got.where("state <> 'closed'").isEmpty() and want.count() > 20
    assert want.agg(F.max("windows")).first()[0] > 3
    if per_trigger == 1:
        assert written.where("state = 'open'").count() > 0
        before = sorted(map(str, rows(written)))
        again = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", per_trigger).parquet(f"{posts}/*")
        episodes.stream_episodes(again, target, checkpoint, **HOW).awaitTermination()  # from the checkpoint: nothing new
        assert sorted(map(str, rows(spark.read.schema(episodes.ROWS).parquet(target)))) == before
        incidents = episodes.episode_incidents(written)
        assert incidents.select("id").distinct().count() == want.count()
        assert {r["status"] for r in rows(incidents)} == {"closed"} and incidents.where("ended_at IS NULL").isEmpty()


def facts(spark, day, count):
    base = spark.range(count).select(
        F.concat(F.lit(f"{day}-"), "id").alias("id"), F.concat(F.lit("s"), F.col("id") % 3).alias("service_id"),
        (F.lit(f"2024-03-{day:02d} 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id"))).alias("timestamp"), "id",
    ).toDF("key", "service_id", "timestamp", "n")
    metrics = base.select(
        F.concat(F.lit("m"), "key").alias("id"), "service_id", "timestamp", F.lit("p95_latency_ms").alias("metric_name"),
        (F.col("n") * 97 % 1500).cast("double").alias("metric_value"),
    )
    levels = F.when(F.col("n") % 4 == 0, "error").otherwise("info")
    return metrics, base.select(F.concat(F.lit("l"), "key").alias("id"), "service_id", "timestamp", levels.alias("level"))


def test_kept_signals_equal_a_scan_and_read_the_new_day_only(spark, tmp_path, monkeypatch):
    log = ChangeLog(spark, str(tmp_path / "store"))
    services = spark.createDataFrame([(f"s{i}", f"name{i}") for i in range(4)], "id string, name string")
    assert [r["errors"] for r in rows(signals.kept_signals(log, services))] == [0] * 4
    read = []
    plain = ChangeLog.epoch
    monkeypatch.setattr(ChangeLog, "epoch", lambda *a: read.append(plain(*a)) or read[-1])
    for epoch, day in enumerate((1, 2, 3)):
        metrics, logs = facts(spark, day, 50 * day)
        log.write("metric_points", metrics, "posts", epoch)
        log.write("log_entries", logs, "posts", epoch)
        read.clear()
        signals.keep(log, "posts", epoch)
        own = f"stream={stream_name('posts')}/epoch={epoch}/day=2024-03-{day:02d}/"
        files = [f for df in read for f in df.inputFiles()]
        assert files and all(own in f for f in files)
        want = detect.service_signals(services, log.facts("metric_points"), log.facts("log_entries"))
        got = signals.kept_signals(log, services)
        shown = ["service_id", "service_name", "max_latency", "errors", "n_metrics"]
        assert sorted(map(str, rows(got.select(*shown)))) == sorted(map(str, rows(want.select(*shown))))
        assert not any("metric_points" in f or "log_entries" in f for f in got.inputFiles())
    first = log.facts("metric_points").where("metric_value >= 1200").groupBy("service_id").agg(F.min("timestamp").alias("t"))
    got = {r["service_id"]: r["first_breach"] for r in rows(signals.kept_signals(log, services)) if r["first_breach"]}
    assert got == {r["service_id"]: r["t"] for r in rows(first)}
    signals.keep(log, "posts", 2)  # a replay
    assert sum(r["errors"] for r in rows(signals.kept_signals(log, services, start="2024-03-03"))) == 38
