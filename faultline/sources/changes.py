"""Tables that many streams append to, folded when they are read.

    root/<table>/stream=<name>/epoch=<n>[/day=<date>]    plain parquet

A stream owns its folders: writing an epoch replaces that folder, so a trigger that is run
again leaves the rows it left before, and no writer touches what another one wrote. Facts
are read as they lie. Of services, deployments and incidents the folders hold changes (a row
as it was sent, or a tombstone), each with its place in the order of posting: the time the
batch was generated, the batch, and the row in it. That place does not depend on who wrote
first, so readers who fold the same changes see the same table, whatever streams interleave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans.ingest import DEPLOYMENTS, INCIDENTS, SERVICES

FACT_KEYS = {"service_id", "timestamp", "id"}
ORDER = "struct<generatedAt:string,batch_id:string,ordinal:int>"
# The stream that compacted changes lie under.
FOLDED = "folded"


@dataclass(frozen=True)
class Folding:
    """How a table follows from its changes: by these keys, the last or the first one counts."""

    shape: str
    keys: tuple[str, ...]
    first: bool = False


FOLDINGS = {
    "services": Folding(SERVICES, ("name",)),
    "deployments": Folding(DEPLOYMENTS, ("service_id", "version", "environment")),
    "incidents": Folding(INCIDENTS, ("scenario_id",), first=True),
}


def gone() -> Column:
    return F.coalesce("gone", F.lit(False))


def decisive(changes: DataFrame, folding: Folding) -> DataFrame:
    """The changes that later ones leave in force: one per key, or a tombstone and a row.

    Copies of a change, as a crash between the steps of ``compact`` leaves, fold away.
    """
    rest = [c for c in changes.columns if c not in folding.keys]
    whole = F.struct(*rest)
    if not folding.first:
        row = F.max_by(whole, F.col("batch_seq"))
        return changes.groupBy(*folding.keys).agg(row.alias("_row")).select(*folding.keys, "_row.*")
    # The first row since the key was last removed.
    last_gone = changes.where(gone()).groupBy(*folding.keys).agg(F.max("batch_seq").alias("_since"))
    since = changes.join(last_gone, list(folding.keys), "left")
    alive = since.where(~gone() & (F.col("_since").isNull() | (F.col("batch_seq") > F.col("_since"))))
    row = F.min_by(whole, F.col("batch_seq"))
    kept = alive.groupBy(*folding.keys).agg(row.alias("_row")).select(*folding.keys, "_row.*")
    stones = changes.where(gone()).groupBy(*folding.keys).agg(F.max_by(whole, F.col("batch_seq")).alias("_row"))
    return kept.unionByName(stones.select(*folding.keys, "_row.*"))


class ChangeLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def write(self, table: str, rows: DataFrame, stream: str, epoch: int) -> None:
        """Set what a stream's epoch says about a table; writing it again replaces it."""
        writer = clustered(rows).write.mode("overwrite")
        if FACT_KEYS <= set(rows.columns):
            writer = writer.partitionBy("day")
        writer.parquet(f"{self.root}/{table}/stream={stream_name(stream)}/epoch={epoch}")

    def remove(self, table: str, keys: DataFrame, stream: str, epoch: int, at: str) -> None:
        """Tombstones for rows of keys: what was posted up to the time ``at`` (ISO) is gone."""
        folding = FOLDINGS[table]
        order = F.struct(F.lit(at).alias("generatedAt"), F.lit("~").alias("batch_id"), F.lit(0).alias("ordinal"))
        stones = keys.select(*folding.keys).withColumn("batch_seq", order).withColumn("gone", F.lit(True))
        self.write(table, self._shaped(table, stones), stream, epoch)

    def put(self, table: str, rows: DataFrame, stream: str, epoch: int) -> None:
        """Change rows as they were sent: the table's columns and ``batch_seq``.

        Where the last one of a key counts, earlier ones of the epoch are never read and not
        stored. Where the first one does, a tombstone may fall between two, so all are.
        """
        whole, folding = self._shaped(table, rows), FOLDINGS[table]
        self.write(table, whole if folding.first else decisive(whole, folding), stream, epoch)

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{FOLDINGS[table].shape}, batch_seq {ORDER}, gone boolean")
        whole = empty.unionByName(rows.select(*[c for c in empty.columns if c in rows.columns]), allowMissingColumns=True)
        return whole.withColumn("gone", gone())

    def _rows(self, table: str) -> DataFrame | None:
        return self._read(f"{self.root}/{table}")

    def changes(self, table: str) -> DataFrame:
        """All change rows of a table, with their stream and epoch."""
        rows = self._rows(table)
        if rows is not None:
            return rows
        return self._shaped(table, self.spark.createDataFrame([], "gone boolean")).select(
            "*", F.lit("").alias("stream"), F.lit(0).alias("epoch")
        )

    def current(self, table: str) -> DataFrame:
        """A table as its changes make it; the rows of a key meet in one task, folded before."""
        folding = FOLDINGS[table]
        rows = decisive(self.changes(table).drop("stream", "epoch"), folding).where(~gone())
        return rows.drop("batch_seq", "gone")

    def facts(self, table: str) -> DataFrame | None:
        """All rows of an appended table, with ``day`` to read some days only."""
        rows = self._rows(table)
        return None if rows is None else rows.drop("stream", "epoch")

    def epoch(self, table: str, stream: str, epoch: int) -> DataFrame | None:
        """The facts of one epoch; only its own files are listed and read."""
        return self._read(f"{self.root}/{table}/stream={stream_name(stream)}/epoch={epoch}")

    def _read(self, path: str) -> DataFrame | None:
        """A folder's rows, None before anything was written or while there are only empty folders."""
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def compact(self, table: str, closed: Mapping[str, int]) -> None:
        """Fold the changes of closed epochs: per stream name, those up to a number.

        What stays in force is written first and the epochs are emptied after; a crash in
        between leaves copies that fold away. An epoch may be compacted once its trigger is
        committed; a reader that has listed files before should be done.
        """
        rows = self.changes(table)
        closing = F.col("stream") == FOLDED
        for stream, last in closed.items():
            closing |= (F.col("stream") == stream_name(stream)) & (F.col("epoch") <= last)
        chosen = rows.where(closing)
        parts = [(r.stream, r.epoch) for r in chosen.select("stream", "epoch").distinct().collect()]
        target = max([epoch for stream, epoch in parts if stream == FOLDED], default=-1) + 1
        kept = decisive(chosen.drop("stream", "epoch"), FOLDINGS[table])
        kept.write.mode("overwrite").parquet(f"{self.root}/{table}/stream={FOLDED}/epoch={target}")
        for stream, epoch in parts:
            rows.drop("stream", "epoch").limit(0).write.mode("overwrite").parquet(
                f"{self.root}/{table}/stream={stream}/epoch={epoch}"
            )


def stream_name(stream: str) -> str:
    """A short name for a folder; never one that reads as a number."""
    return "s-" + hashlib.sha256(stream.encode()).hexdigest()[:16]


def clustered(df: DataFrame) -> DataFrame:
    """The layout of facts: a folder per day, files cut by time, rows by service and time.

    Readers skip days by folder and row groups by their smallest and largest values. The
    cut is by range over (time, service, id), so a busy service or moment spreads too.
    """
    if not FACT_KEYS <= set(df.columns):
        return df
    return (
        df.withColumn("day", F.to_date("timestamp"))
        .repartitionByRange("timestamp", "service_id", "id")
        .sortWithinPartitions("day", "service_id", "timestamp")
    )
