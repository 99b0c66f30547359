"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import gapless, texts
from faultline.session import materialize

# Rows that are permuted together; a block's sort is the largest piece of work of a task.
BLOCK_ROWS = 20_000
# At most so many blocks and so many cells of a shard, so the matrix and the offsets are small.
BLOCKS = 8192


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good + bad`` are good, exactly distributed, for any size.

    Weights come from the ratio of neighbouring probabilities, outward from the mode and
    twelve deviations far; what lies beyond has less than 1e-30 of the mass.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * max(total - draws, 0) / max(total - 1, 1))
    reach = int(12 * spread) + 40
    k = np.arange(max(low, mode - reach), min(high, mode + reach), dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    level = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(level - level.max()))
    return max(low, mode - reach) + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard, as in a uniform permutation of all rows.

    Column sums differ by at most one. Block after block draws from what the shards still
    take, which is the multivariate hypergeometric law.
    """
    rng = np.random.default_rng(seed)
    total = sum(rows)
    room = [total // shards + (1 if j < total % shards else 0) for j in range(shards)]
    matrix = []
    for count in rows:
        free, left, line = sum(room), count, []
        for j in range(shards):
            free -= room[j]
            took = hypergeometric(rng, room[j], free, left)
            left -= took
            line.append(took)
        room = [r - t for r, t in zip(room, line)]
        matrix.append(line)
    return matrix


def _draw(seed: int, step: str) -> Column:
    """A key for each row that looks random and is the same when a task runs again."""
    return F.xxhash64(F.lit(f"{seed}:{step}"), F.md5(F.concat_ws(":", "doc_id", "text_crc32", "size")))


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = 2) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard counts differ by at most one. Sizes are the UTF-8 bytes of
    the text plus 8, a null text has none; repeated rows, null ids and empty texts are rows
    like any other. An empty table gives an empty result. The order is a uniform
    permutation that depends on ids, texts and ``seed`` only.

    Rows are hashed into blocks; the driver sees one count per block and draws how many
    rows of it go to each shard. Blocks permute their rows and cut them by these counts,
    the rows are exchanged, and cells of each shard permute them again. Slots are a cell's
    offset plus the place in the cell. No block or cell follows a column of the table, so
    no hot source or group of copies meets in one.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = texts(docs).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = materialize(rows.withColumn("_key", _draw(seed, "block")), "shard-rows")
    total = rows.count()
    blocks = max(1, min(BLOCKS, math.ceil(total / BLOCK_ROWS)))
    rows = rows.withColumn("_block", F.pmod("_key", F.lit(blocks)).cast("int")).drop("_key")
    counted = dict(rows.groupBy("_block").count().collect())
    sent = communication_matrix([counted.get(b, 0) for b in range(blocks)], shards, seed)
    cuts = [np.cumsum(line).tolist() for line in sent]
    matrix = spark.range(1).select(
        F.posexplode(F.from_json(F.lit(json.dumps(cuts)), "array<array<long>>")).alias("_block", "_cuts")
    )
    tie = [F.col(c) for c in ("doc_id", "size", "text_crc32")]
    local = Window.partitionBy("_block").orderBy(_draw(seed, "deal"), *tie)
    dealt = (
        rows.withColumn("_place", F.row_number().over(local))
        .join(F.broadcast(matrix), "_block")  # at most BLOCKS rows of `shards` longs
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c < F.col("_place"))))
        .drop("_block", "_cuts", "_place")
    )
    dealt = materialize(dealt, "shard-dealt")
    cells = max(1, min(BLOCKS, math.ceil(total / shards / BLOCK_ROWS)))
    placed = gapless(dealt, "shard", _draw(seed, "place"), cells, tie)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
