"""Batch ingest as a stream over a folder of posted batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.keyed import stored_incidents
from faultline.plans import ingest as I
from faultline.plans.signals import keep
from faultline.session import materialize
from faultline.sources import batches as B
from faultline.sources.changes import ChangeLog


def apply_batch(log: ChangeLog, lines: DataFrame, stream: str, epoch: int, signal: tuple = ()) -> None:
    """Check, resolve and store the batches of one trigger: rows of (file_path, value).

    Any number of streams may do so at once. Each table's rows of this (stream, epoch) are
    set, services first, then deployments, then what names them, which is resolved against
    all that is stored by then. A trigger that runs again sets the same rows again: ids and
    places follow from the batch and the row in it. Rejected batches go to their own table
    with the broken rules. What the epoch's facts say about each service and day is kept
    too; ``signal`` may name another metric and threshold for that.
    """
    raw = materialize(B.identify(lines), "posted")  # the posted text is read once, then reused below
    violations = materialize(B.contract_violations(raw), "violations")
    good, _ = B.accept(raw, violations)
    parts = B.split(materialize(B.parse(good), "batches"))
    log.put("services", I.service_rows(parts["services"]), stream, epoch)
    services = materialize(log.current("services"), "services")
    log.put("deployments", I.deployment_rows(parts["deployments"], services), stream, epoch)
    deployments = materialize(log.current("deployments"), "deployments")
    log.put("incidents", stored_incidents(I.incident_rows(parts["incidents"], services)), stream, epoch)
    log.write("log_entries", I.log_rows(parts["logs"], services, deployments), stream, epoch)
    log.write("metric_points", I.metric_rows(parts["metrics"], services), stream, epoch)
    log.write("rejected", violations, stream, epoch)
    keep(log, stream, epoch, *signal)


def stream_ingest(
    spark: SparkSession,
    source: str,
    log: ChangeLog,
    checkpoint: str,
    *,
    files_per_trigger: int = 1000,
    available_now: bool = True,
    signal: tuple = (),
):
    """Start the stream over ``source`` (one batch per line of its files).

    ``files_per_trigger`` bounds a trigger, however long the backlog is. A stream is known
    by its checkpoint: what a new checkpoint reads is posted anew.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.text(source).select(F.col("_metadata.file_path").alias("file_path"), "value")

    def run(df: DataFrame, epoch: int) -> None:
        apply_batch(log, df, checkpoint, epoch, signal)

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
