"""Small helpers of the operators in this folder."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bytes that separate words or are skipped when texts are compared: space and \t \n \v \f \r.
BLANK = r"[\x20\x09-\x0D]"
# Texts in a batch of a session that many stages share.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str, **kinds: str) -> DataFrame:
    """Columns by exact name and as the given types, however many others there are.

    A frame may hold further columns that differ in case only, or one name twice
    (the first counts); naming them through Spark would be ambiguous.
    """
    place: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        place.setdefault(name, i)
    plain = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    wanted = []
    for name in names:
        value = F.col(f"_c{place[name]}")
        wanted.append((value.cast(kinds[name]) if name in kinds else value).alias(name))
    return plain.select(*wanted)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text), null texts as empty ones."""
    rows = pick(docs, "doc_id", "text", doc_id="long", text="string")
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def smallest(value: Column) -> Column:
    """Orders a long so that the smallest is the greatest and null the least."""
    return F.bitwise_not(value)


def worker_state(key: str, make, alone: bool = False):
    """What a Python worker keeps between tasks: loaded vocabularies and look-ups.

    Of the large states, kept ``alone``, a worker has one at a time.
    """
    home = sys.modules.setdefault("_faultline_worker", types.ModuleType("_faultline_worker")).__dict__
    if alone and home.get("large") != key:
        home.pop(home.get("large"), None)
        home["large"] = key
    if key not in home:
        home[key] = make()
    return home[key]


def small_batches(spark: SparkSession) -> None:
    """Hand fewer texts to Python at once than Spark's 10,000, as a text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def batches_up_to(spark: SparkSession, size: str) -> Iterator[None]:
    """Jobs started inside hand Python no more bytes at once; the session is left as it was."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def gapless(rows: DataFrame, group: str, draw: Column, cells: int, order: list[Column]) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2, ... inside each group, in the order of a hash.

    ``draw`` deals a group's rows to ``cells``; a slot is the rows of the cells before plus
    the place in the own cell, so a large group is numbered by many tasks. ``rows`` should
    be stored, as they are read twice. At most groups x cells counts are broadcast.
    """
    dealt = rows.withColumn("_cell", F.pmod(draw, F.lit(cells)).cast("int"))
    before = Window.partitionBy(group).orderBy("_cell")
    offsets = dealt.groupBy(group, "_cell").agg(F.count("*").alias("_rows"))
    offsets = offsets.select(group, "_cell", (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_cell").orderBy(draw, *order)))
    return (
        placed.join(F.broadcast(offsets), [group, "_cell"])
        .withColumn("slot", (F.col("_before") + F.col("_place") - 1).cast("long"))
        .drop("_cell", "_before", "_place")
    )
