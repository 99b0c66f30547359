"""Positions in time order, and what a time span holds, without emitting pairs.

Joining spans (incident windows) to facts (logs, metric points) on the service emits
every pair inside the window, which explodes for a busy service. Instead facts and
span ends are put in one total order (key, time, kind, tie) by a range shuffle. That
splits evenly however many rows one key or one moment holds. Every fact then has a
position, and a span is the interval of positions [first, last):

* its first or last n facts are the positions at one end, an equality join of exactly
  as many rows as come out;
* its aggregates are sums over aligned blocks of positions (1, 32, 32^2, ...), at most
  62 blocks per level, however many facts it holds.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import checkpoint, fits_broadcast, materialize, sorted_join

BRANCH = 32
# Facts are first dropped by slices of time: so many to the widest span, each an hour or more.
SLICES, SLICE_MICROS = 32, 3_600_000_000
_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id()
_OPEN, _FACT, _CLOSE = 0, 1, 2  # sort order of rows at the same moment: both ends included


def _near_spans(facts: DataFrame, spans: DataFrame, key: str, time: str) -> DataFrame:
    """Facts that may lie in a span, before anything is shuffled.

    The times of all spans together go to the scan. Then spans become (key, slice of time)
    pairs, a slice being a piece of the widest span but an hour at least, and facts of
    other pairs are dropped. With spans that have no lower end only the keys count.
    """
    seconds = F.unix_micros(F.col("closes").cast("timestamp")) - F.unix_micros(F.col("opens").cast("timestamp"))
    found = spans.agg(
        F.count_if(F.col("opens").isNull()).alias("endless"),
        F.min("opens").alias("low"),
        F.max("closes").alias("high"),
        F.max(seconds).alias("widest"),
    ).first()
    if found["high"] is None:
        return facts.filter(F.lit(False))
    kind = spans.schema["closes"].dataType
    facts = facts.filter(F.col(time) <= F.lit(found["high"]).cast(kind))
    if found["endless"]:
        used = spans.select(key).distinct()
        return facts.join(F.broadcast(used), key, "left_semi") if fits_broadcast(used) else facts
    facts = facts.filter(F.col(time) >= F.lit(found["low"]).cast(kind))
    width = max(SLICE_MICROS, (found["widest"] or 0) // SLICES)

    def slice_of(at: Column) -> Column:
        return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(width)).cast("long")

    first, last = slice_of(F.col("opens")), slice_of(F.col("closes"))
    pairs = spans.filter("opens <= closes").select(key, F.explode(F.sequence(first, last)).alias("_slice")).distinct()
    sliced = facts.withColumn("_slice", slice_of(F.col(time)))
    if fits_broadcast(pairs):
        return sliced.join(F.broadcast(pairs), [key, "_slice"], "left_semi").drop("_slice")
    # Spark takes the pairs for a part of the spans' files; they are many to a span.
    return sorted_join(sliced, pairs, [key, "_slice"], "left_semi").drop("_slice")


def locate_spans(
    facts: DataFrame, spans: DataFrame, *, key: str, time: str, tie: str
) -> tuple[DataFrame, DataFrame]:
    """Number the facts in (key, time, tie) order and find each span in that order.

    ``spans`` has (span_id, key, opens, closes); both ends are inclusive and a null
    ``opens`` means no lower end. Returns the facts with ``position`` and
    (span_id, first, last) with ``last`` exclusive.
    """
    facts = _near_spans(facts.filter(F.col(key).isNotNull() & F.col(time).isNotNull()), spans, key, time)

    payload = [c for c in facts.columns if c != key]
    span_type = spans.schema["span_id"].dataType

    def end(kind: int, at: str) -> DataFrame:
        return spans.select(
            F.col(key).alias("_key"),
            F.col(at).alias("_time"),
            F.lit(kind).alias("_kind"),
            F.col("span_id").alias("_span"),
        )

    rows = facts.select(
        F.col(key).alias("_key"),
        F.col(time).alias("_time"),
        F.lit(_FACT).alias("_kind"),
        F.lit(None).cast(span_type).alias("_span"),
        F.col(tie).alias("_tie"),
        F.struct(*payload).alias("_row"),
    )
    for half in (end(_OPEN, "opens"), end(_CLOSE, "closes")):
        rows = rows.unionByName(half, allowMissingColumns=True)

    order = ["_key", "_time", "_kind", "_tie", "_span"]
    # Checkpointed because the numbering below reads partitions by their place: a
    # second run of the range shuffle could cut them elsewhere.
    ordered = checkpoint(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", 33).alias("_part")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))

    # One row per partition, whatever the data is: small enough for the driver.
    sizes = ordered.groupBy(part).agg(F.count_if(F.col("_kind") == _FACT).alias("_n")).collect()
    sizes = sorted((r["_part"], r["_n"]) for r in sizes)
    totals = itertools.accumulate((n for _, n in sizes), initial=0)
    starts = F.broadcast(
        facts.sparkSession.createDataFrame(
            [(p, total) for (p, _), total in zip(sizes, totals, strict=False)],
            "_part long, _start long",
        )
    )

    numbered = (
        ordered.filter(F.col("_kind") == _FACT)
        .select("_key", "_row", part, place.alias("_place"))
        .join(starts, "_part")
        .select(
            F.col("_key").alias(key),
            "_row.*",
            (F.col("_start") + F.col("_place")).alias("position"),
        )
    )
    # Facts before a span end: rows before it less span ends before it.
    ends = (
        ordered.filter(F.col("_kind") != _FACT)
        .select("_span", "_kind", "_slot", part, place.alias("_place"))
        .join(starts, "_part")
        .select(
            "_span",
            "_kind",
            (
                F.col("_start")
                + F.col("_slot").bitwiseAND(F.lit(_IN_PARTITION))
                - F.col("_place")
            ).alias("_at"),
        )
    )
    located = ends.groupBy(F.col("_span").alias("span_id")).agg(
        F.max(F.when(F.col("_kind") == _OPEN, F.col("_at"))).alias("first"),
        F.max(F.when(F.col("_kind") == _CLOSE, F.col("_at"))).alias("last"),
    )
    return numbered, located


def first_in_span(facts: DataFrame, spans: DataFrame, n: int) -> DataFrame:
    """The first n facts of each span with ``rank`` 1..n in time order."""
    stop = F.least(F.col("last"), F.col("first") + n) - 1
    wanted = spans.filter("first < last").select(
        "span_id", "first", F.explode(F.sequence(F.col("first"), stop)).alias("position")
    )
    return sorted_join(wanted, facts, "position").withColumn(
        "rank", (F.col("position") - F.col("first") + 1).cast("long")
    ).drop("position", "first")


def last_in_span(facts: DataFrame, spans: DataFrame, n: int) -> DataFrame:
    """The last n facts of each span with ``rank`` 1..n from the newest back."""
    start = F.greatest(F.col("first"), F.col("last") - n)
    wanted = spans.filter("first < last").select(
        "span_id", "last", F.explode(F.sequence(start, F.col("last") - 1)).alias("position")
    )
    return sorted_join(wanted, facts, "position").withColumn(
        "rank", (F.col("last") - F.col("position")).cast("long")
    ).drop("position", "last")


def _aligned_blocks(level: int) -> Column:
    """Blocks of this level a span needs: inside it, outside the next level's blocks."""

    def inside(size: int) -> tuple[Column, Column]:
        low = F.floor((F.col("first") + (size - 1)) / F.lit(size))
        return low.cast("long"), F.floor(F.col("last") / F.lit(size)).cast("long")

    def block_range(low: Column, high: Column) -> Column:
        return F.when(low < high, F.sequence(low, high - 1)).otherwise(
            F.array().cast("array<bigint>")
        )

    low, high = inside(BRANCH**level)
    upper_low, upper_high = inside(BRANCH ** (level + 1))
    split = F.concat(
        block_range(low, upper_low * BRANCH), block_range(upper_high * BRANCH, high)
    )
    return F.when(upper_low < upper_high, split).otherwise(block_range(low, high))


def summarize_spans(
    facts: DataFrame, spans: DataFrame, groups: list[str], value: str
) -> DataFrame:
    """min, max, avg and samples of ``value`` per span and group."""
    measures = [
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("total").alias("total"),
        F.sum("samples").alias("samples"),
    ]
    spans = materialize(spans.filter("first < last"), "spans")
    widest = spans.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0
    levels = 1
    while BRANCH**levels <= widest:
        levels += 1

    points = facts.select(
        F.lit(0).alias("level"),
        F.col("position").alias("block"),
        *groups,
        F.col(value).alias("low"),
        F.col(value).alias("high"),
        F.col(value).alias("total"),
        F.lit(1).cast("long").alias("samples"),
    )
    blocks = points
    if levels > 1:
        # Facts arrive in position order, so the map side already folds most rows.
        small = points.groupBy(
            F.floor(F.col("block") / F.lit(BRANCH)).alias("block"), *groups
        ).agg(*measures)
        level = F.explode(F.sequence(F.lit(1), F.lit(levels - 1))).alias("level")
        size = F.pow(F.lit(float(BRANCH)), F.col("level") - 1).cast("long")
        larger = (
            small.select(level, "block", *groups, "low", "high", "total", "samples")
            .withColumn("block", F.floor(F.col("block") / size))
            .groupBy("level", "block", *groups)
            .agg(*measures)
        )
        blocks = points.unionByName(larger)

    def at_level(n: int) -> Column:
        return F.transform(
            _aligned_blocks(n), lambda b: F.struct(F.lit(n).alias("level"), b.alias("block"))
        )

    wanted = F.concat(*[at_level(n) for n in range(levels)])
    needed = spans.select("span_id", F.inline(wanted))
    return (
        sorted_join(needed, blocks, ["level", "block"])
        .groupBy("span_id", *groups)
        .agg(*measures)
        .select(
            "span_id",
            *groups,
            F.col("low").alias("min"),
            F.col("high").alias("max"),
            (F.col("total") / F.col("samples")).alias("avg"),
            "samples",
        )
    )
