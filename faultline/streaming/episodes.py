"""Incident episodes of a stream: a breach opens one, later ones extend it, quiet time closes it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.operators.keyed import stable_id
from faultline.schemas import LATENCY_THRESHOLD
from faultline.sources.changes import ChangeLog
from faultline.streaming.detect import detected, signal_rows, window_signals

# What a service keeps while an episode is open, and what is written when one opens or closes.
STATE = "started long, ended long, peak double, errors long, windows long"
ROWS = (
    "service_id string, state string, started_at timestamp, ended_at timestamp, peak double, errors long, windows long"
)
NAMES = [f.split(" ")[0] for f in ROWS.split(", ")]
# Timers and typed state want this store; a query keeps to the one it was started with.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def millis(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


class Follower(StatefulProcessor):
    """Follows one service: breaches that the watermark has passed, and a timer for the quiet.

    A window that is still to come ends after the watermark, so it starts after the watermark
    less its width. An episode is closed once that is more than ``quiet`` after its end; no
    later window can belong to it. State is five numbers, however long an episode lasts.
    """

    def __init__(self, window: str, quiet: str):
        self.quiet = millis(quiet)
        self.wait = millis(window) + self.quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("episode", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = now = tuple(self.kept.get()) if self.kept.exists() else None
        out = []
        windows = pd.concat(list(rows)).sort_values("window_start")
        starts, ends = (windows[c].astype("datetime64[ms]").astype("int64") for c in ("window_start", "window_end"))
        for start, end, peak, errors in zip(starts, ends, windows["max_latency"], windows["errors"]):
            if now is not None and start <= now[1] + self.quiet:
                now = (now[0], int(end), max(now[2], float(peak)), now[3] + int(errors), now[4] + 1)
                continue
            if now is not None:
                out.append(row(key, "closed", now))
            now = (int(start), int(end), float(peak), int(errors), 1)
        if before is not None:
            self.handle.deleteTimer(before[1] + self.wait)
        if now[1] + self.wait < timerValues.getCurrentWatermarkInMs():
            out.append(row(key, "closed", now))
            self.kept.clear()
        else:
            if before is None or before[0] != now[0]:
                out.append(row(key, "open", now))
            self.kept.update(now)
            self.handle.registerTimer(now[1] + self.wait)
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            now = tuple(self.kept.get())
            self.kept.clear()
            yield pd.DataFrame([row(key, "closed", now)], columns=NAMES)

    def close(self) -> None:
        pass


def row(key: tuple, name: str, now: tuple) -> tuple:
    ended = pd.Timestamp(now[1], unit="ms") if name == "closed" else pd.NaT
    return (key[0], name, pd.Timestamp(now[0], unit="ms"), ended, *now[2:])


def episodes(
    signals: DataFrame, *, window: str = "10 minutes", quiet: str = "30 minutes", late: str = "10 minutes",
    threshold: float = LATENCY_THRESHOLD,
) -> DataFrame:
    """Rows of a stream of ``signal_rows``: one when an episode opens, one when it closes.

    Breaching windows of a service whose gap is at most ``quiet`` are one episode. An episode
    that opens and closes between two triggers has its closing row only.
    """
    stamped = signals.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    found = stamped.groupBy(F.window("at", window).alias("_w"), "service_id").agg(
        F.max("latency").alias("max_latency"), F.count_if("is_error").alias("errors")
    )
    breaches = found.where(detected(threshold)).select(
        F.col("service_id").cast("string").alias("service_id"), F.window_time("_w").alias("at"),
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "max_latency", "errors",
    )
    return breaches.groupBy("service_id").transformWithStateInPandas(
        Follower(window, quiet), ROWS, "append", "EventTime"
    )


def batch_episodes(
    signals: DataFrame, *, window: str = "10 minutes", quiet: str = "30 minutes", threshold: float = LATENCY_THRESHOLD
) -> DataFrame:
    """The episodes of all windows at once, as islands between gaps; all of them count as closed."""
    breaches = window_signals(signals, window).where(detected(threshold))
    order = Window.partitionBy("service_id").orderBy("window_start")
    gap = F.unix_micros(F.col("window_start").cast("timestamp")) - F.unix_micros(
        F.lag("window_end").over(order).cast("timestamp")
    )
    first = F.when(gap <= millis(quiet) * 1000, 0).otherwise(1)
    islands = breaches.withColumn("_first", first).withColumn("_island", F.sum("_first").over(order))
    grouped = islands.groupBy("service_id", "_island").agg(
        F.min("window_start").alias("started_at"), F.max("window_end").alias("ended_at"),
        F.max("max_latency").alias("peak"), F.sum("errors").alias("errors"), F.count("*").alias("windows"),
    )
    return grouped.drop("_island")


def stored_signals(log: ChangeLog, metric: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the signals in the facts that ingest streams store; new epochs are new files."""
    spark = log.spark

    def stream(table: str) -> DataFrame:
        rows = log.facts(table)
        reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(f"{log.root}/{table}")

    return signal_rows(stream("metric_points"), stream("log_entries"), metric)


def stream_episodes(signals: DataFrame, target: str, checkpoint: str, *, available_now: bool = True, **how):
    """Start the stream of episode rows into a parquet folder; see ``latest_episodes``."""
    rows = episodes(signals, **how)
    writer = (
        rows.writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    spark = signals.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return writer.start()  # which takes the settings as they are now
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def latest_episodes(rows: DataFrame) -> DataFrame:
    """One row per episode: its closing row where there is one, else the one it opened with."""
    rest = [c for c in rows.columns if c not in ("service_id", "started_at")]
    best = F.min_by(F.struct(*rest), F.col("state"))  # closed before open
    return rows.groupBy("service_id", "started_at").agg(best.alias("_row")).select("service_id", "started_at", "_row.*")


def episode_incidents(rows: DataFrame) -> DataFrame:
    """Episodes as incidents: open ones detected, closed ones with the time they ended."""
    found = latest_episodes(rows)
    reason = F.format_string("peak of %.1f with %d errors in %d windows", "peak", "errors", "windows")
    return found.select(
        stable_id(F.lit("episode"), "service_id", "started_at").alias("id"), "service_id",
        F.lit("Latency and error spike").alias("title"), F.lit("sev2").alias("severity"),
        F.when(F.col("state") == "closed", "closed").otherwise("detected").alias("status"),
        "started_at", "ended_at", reason.alias("detection_reason"),
    )
