"""Batches of sequences of alike length, in buckets that pad least."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import gapless, texts, worker_state
from faultline.llm.pieces import character_classes
from faultline.llm.tokens import ByteEncoder
from faultline.session import materialize

# Longest sequence; longer documents are cut into sequences of this length and a rest.
LONGEST = 8192
BUCKETS = 16
# Tokens of a batch, padding included; at least LONGEST.
BUDGET = 65_536
# Rows of a bucket that one task numbers, and at most so many such tasks for a bucket.
CELL_ROWS, CELLS = 20_000, 8192
BATCH = 1000


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length ranges with the least padding in total.

    Dynamic programming over the lengths that occur: the best cut of the first j lengths
    into k ranges extends a best cut of fewer lengths into k - 1. Of equal cuts the one
    with the lower bounds is taken, and fewer ranges before more.
    """
    lengths = np.array(sorted(histogram), dtype=np.float64)
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.float64)
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate([[0.0], np.cumsum(counts)])
    tokens = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    best = lengths[np.arange(n)] * rows[1:] - tokens[1:]
    best = np.concatenate([[0.0], best])
    before = [np.zeros(n + 1, dtype=np.int64)]
    tops = [best[n]]
    for _ in range(1, min(buckets, n)):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        now[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = np.argmin(cost)
            now[j] = cost[cut[j]]
        best = now
        before.append(cut)
        tops.append(best[n])
    k, j, bounds = int(np.argmin(tops)), n, []
    while j > 0:
        bounds.append(int(lengths[j - 1]))
        j, k = int(before[k][j]), k - 1
    return bounds[::-1]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens): byte-level ids of the whole text and one end id."""
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, character_classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_state(f"byte-bpe-{vocabulary_path}", lambda: ByteEncoder(*sent.value), alone=True)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                counts = [len(ids) + 1 for ids in coder.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"]
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long")


def pack(
    counts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, budget: int = BUDGET, seed: int = 8
) -> DataFrame:
    """Batches of the sequences of ``counts`` (doc_id, n_tokens).

    One row per sequence: doc_id, sequence (0, 1, ... within the document), n_tokens,
    bucket, bucket_tokens (what a row of its batch is padded to), batch (0, 1, ... within
    the bucket), place (in the batch), padding. A document of up to ``longest`` tokens is one
    sequence; a longer one is cut into full sequences and a rest, so nothing is dropped.
    A batch has ``budget // bucket_tokens`` rows; the last of a bucket may have fewer.
    Null ids and repeated rows are rows like any other, equal lengths are ordered by a
    hash of their row; an empty table gives an empty result.

    The driver sees the histogram, which has ``longest`` entries at most. A bucket is
    numbered by many tasks, so neither a common length nor a large bucket meets in one.
    """
    if budget < longest:
        raise ValueError("a batch has to hold the longest sequence")
    spark = counts.sparkSession
    full = F.floor((F.col("n_tokens") - 1) / F.lit(longest))
    rows = counts.where("n_tokens > 0").select(
        "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), full.cast("long"))).alias("sequence")
    )
    size = F.least(F.col("n_tokens") - F.col("sequence") * longest, F.lit(longest))
    rows = materialize(rows.select("doc_id", "sequence", size.cast("long").alias("n_tokens")), "sequences")
    histogram = dict(rows.groupBy("n_tokens").count().collect())  # at most `longest` rows
    bounds = bucket_bounds(histogram, buckets)
    limits = F.from_json(F.lit(json.dumps(bounds)), "array<long>")
    rows = rows.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("n_tokens"))))
    rows = rows.withColumn("bucket_tokens", F.element_at(limits, F.col("bucket") + 1))
    largest = max((sum(c for n, c in histogram.items() if a < n <= b) for a, b in zip([0, *bounds], bounds)), default=0)
    cells = max(1, min(CELLS, math.ceil(largest / CELL_ROWS)))
    draw = F.xxhash64(F.lit(f"{seed}:place"), "doc_id", "sequence", "n_tokens")
    order = [F.col(c) for c in ("doc_id", "sequence", "n_tokens")]
    per_batch = F.floor(F.lit(budget) / F.col("bucket_tokens"))
    return gapless(rows, "bucket", draw, cells, order).select(
        "doc_id",
        "sequence",
        "n_tokens",
        "bucket",
        "bucket_tokens",
        F.floor(F.col("slot") / per_batch).cast("long").alias("batch"),
        (F.col("slot") % per_batch).cast("int").alias("place"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
