"""Exact cosine search: the k nearest passages of every query.

Scoring is a matrix product per Arrow batch. Each task keeps only the best k per query,
so what is shuffled is k rows per query and task and never a (query, passage) pair list.

* Queries of equal vectors are scored once, for all of them.
* Up to ``QUERY_ROWS`` vectors of at most ``SIDE_BYTES`` travel to the tasks as one
  broadcast matrix, and the passages are scored where they are read.
* Beyond that both sides are cut into blocks of bounded rows and bytes and every pair of
  blocks is one task's work; a block holds a hash share of its side, so no key can make it
  large.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.functions.embedding import count_matrix
from faultline.schemas import SEARCH_LIMIT, SEARCH_LIMIT_MAX
from faultline.session import lookup_join, materialize, measure, spread

QUERY_ROWS = 20_000
BLOCK_ROWS = 20_000
SIDE_BYTES = 256 * 1024 * 1024
_CELLS = 4_000_000  # scores held at once by a task
_QUERIES_OUT = 10_000  # queries per frame a task gives back
_HASHED = 1000  # vectors held at once where they are compared
_NOTHING = pd.DataFrame({"query": [], "item": [], "score": []}, dtype=object)

Vectorize = Callable[[pd.Series], np.ndarray]


def text_vectors(texts: pd.Series) -> np.ndarray:
    """Token counts per bucket. The cosine does not change with the length of a vector,
    and whole numbers make equal passages score equally to the last bit."""
    return count_matrix(texts)


def dense_vectors(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def check_limit(limit: int) -> int:
    if not isinstance(limit, int) or not 1 <= limit <= SEARCH_LIMIT_MAX:
        raise ValueError(f"limit must be a whole number from 1 to {SEARCH_LIMIT_MAX}")
    return limit


def split_queries(queries: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(queries that can be searched, rejected ones): the text must not be empty."""
    usable = F.coalesce(F.length(F.col(text)) > 0, F.lit(False))
    return queries.filter(usable), queries.filter(~usable)


def _score(
    left: np.ndarray, left_square: np.ndarray, right: np.ndarray
) -> np.ndarray:
    """Cosine per (query, passage); NaN where either vector is zero."""
    right_square = np.einsum("ij,ij->i", right, right)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (left @ right.T) / np.sqrt(left_square[:, None] * right_square[None, :])


def _plain(column: pd.Series) -> np.ndarray:
    return column.to_numpy() if column.dtype.kind in "iuf" else column.to_numpy(dtype=object)


def _keys(order: np.ndarray, items: np.ndarray) -> np.ndarray:
    """One sortable number per cell: distance first, then the item's place among its kind."""
    _, place = np.unique(items, return_inverse=True)
    return (order << 32) + place.reshape(items.shape)  # one row of items serves all queries


def _scan(
    batches: Iterator[pd.DataFrame], vectors: np.ndarray, to_vectors: Vectorize, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best k items per query over one task's items (columns item, content): (items, scores).

    Nearest is by distance to 6 decimals with NaN last, then by item.
    """
    square = np.einsum("ij,ij->i", vectors, vectors)
    step = max(1, _CELLS // max(len(vectors), vectors.shape[1]))
    best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.iloc[at : at + step]
            items = _plain(part["item"])
            scores = _score(vectors, square, to_vectors(part["content"]))
            order = np.rint(np.where(np.isnan(scores), 3.0, 1.0 - scores) * 1e6).astype(np.int64)
            keys = _keys(order, items)
            keep = min(k, len(items))
            top = np.argpartition(keys, keep - 1, axis=1)[:, :keep]
            found = (
                np.take_along_axis(order, top, 1),
                items[top],
                np.take_along_axis(scores, top, 1),
            )
            if best is not None:
                found = tuple(np.hstack(pair) for pair in zip(best, found, strict=True))
            top = np.argsort(_keys(found[0], found[1]), axis=1)[:, :k]
            best = tuple(np.take_along_axis(part, top, 1) for part in found)
    if best is None:
        return np.empty((len(vectors), 0), dtype=object), np.empty((len(vectors), 0))
    return best[1], best[2]


def _rows(ids: np.ndarray, items: np.ndarray, scores: np.ndarray) -> Iterator[pd.DataFrame]:
    """Long rows of the best items, a bounded number of queries at a time."""
    if items.size == 0:
        return
    for at in range(0, len(ids), _QUERIES_OUT):
        stop = at + _QUERIES_OUT
        frame = {
            "query": np.repeat(ids[at:stop], items.shape[1]),
            "item": items[at:stop].ravel(),
            "score": scores[at:stop].ravel(),
        }
        yield pd.DataFrame({c: pd.Series(v, dtype=v.dtype) for c, v in frame.items()})


def _fingerprint(to_vectors: Vectorize):
    """The digest of a content's vector, as a column function."""

    @F.pandas_udf("string")
    def digest(contents: pd.Series) -> pd.Series:
        found: list[str] = []
        for at in range(0, len(contents), _HASHED):
            vectors = np.ascontiguousarray(to_vectors(contents.iloc[at : at + _HASHED]))
            found += [hashlib.sha256(v.tobytes()).hexdigest() for v in vectors]
        return pd.Series(found, dtype=object)

    return digest


def _nearest(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The best k rows per ``by``, with their rank."""
    distance = F.round(1 - F.col("score"), 6)
    order = W.partitionBy(by).orderBy(distance.asc(), F.col("item").asc())
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def _grid(
    queries: DataFrame,
    items: DataFrame,
    query_vectors: Vectorize,
    item_vectors: Vectorize,
    k: int,
    schema: str,
    block_rows: int,
) -> DataFrame:
    def blocks(df: DataFrame) -> int:
        rows, size = measure(df)
        return max(1, math.ceil(rows / block_rows), math.ceil(size / SIDE_BYTES))

    query_blocks, item_blocks = blocks(queries), blocks(items)

    def copies(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        )

    left = copies(queries, "query", "_q", query_blocks, "_i", item_blocks)
    right = copies(items, "item", "_i", item_blocks, "_q", query_blocks)

    def cell(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        items, scores = _scan(
            iter([i] if len(i) else []), query_vectors(q["content"]), item_vectors, k
        )
        return pd.concat([*_rows(_plain(q["query"]), items, scores), _NOTHING])

    return left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInPandas(cell, schema)


def vector_topk(
    queries: DataFrame,
    items: DataFrame,
    *,
    query_key: str,
    item_key: str,
    query_content: str,
    item_content: str,
    to_vectors: Vectorize = text_vectors,
    to_query_vectors: Vectorize | None = None,
    limit: int = SEARCH_LIMIT,
    query_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """(query_key, item_key, rank, score) of the ``limit`` nearest items per query.

    Distance ascending with NaN (a zero vector) last, ties by item key. Items with a
    null content are not searched; items without a common token score 0 and fill up
    the k rows. ``to_vectors`` makes the matrix of a batch of contents; another embedder,
    or stored vectors, come in there (``to_query_vectors`` where queries differ).
    """
    k = check_limit(limit)
    query_vectors = to_query_vectors or to_vectors
    query_rows = QUERY_ROWS if query_rows is None else query_rows
    q = queries.filter(F.col(query_content).isNotNull()).select(
        F.col(query_key).alias("query"), F.col(query_content).alias("content")
    )
    i = items.filter(F.col(item_content).isNotNull()).select(
        F.col(item_key).alias("item"), F.col(item_content).alias("content")
    )
    schema = f"query string, item {i.schema['item'].dataType.simpleString()}, score double"

    # Texts that differ may well have one vector: a name hashes to one of so many buckets.
    asking = materialize(q.withColumn("same", _fingerprint(query_vectors)(F.col("content"))), "asking")
    q = materialize(
        asking.groupBy(F.col("same").alias("query")).agg(F.any_value("content").alias("content")), "query-vectors"
    )

    rows, size = measure(q)
    if rows > query_rows or size > SIDE_BYTES:
        block_rows = BLOCK_ROWS if block_rows is None else block_rows
        found = _grid(q, i, query_vectors, to_vectors, k, schema, block_rows)
    elif rows == 0:
        found = queries.sparkSession.createDataFrame([], schema)
    else:
        asked = q.toPandas()  # at most QUERY_ROWS rows and SIDE_BYTES, counted above
        shared = queries.sparkSession.sparkContext.broadcast(
            (_plain(asked["query"]), query_vectors(asked["content"]))
        )

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, vectors = shared.value
            yield from _rows(ids, *_scan(batches, vectors, to_vectors, k))

        found = spread(i).mapInPandas(scan, schema)

    # Arrow frames carry NaN as null.
    found = found.withColumn("score", F.coalesce("score", F.lit(float("nan"))))
    best = materialize(_nearest(found, "query", k).select(F.col("query").alias("same"), "item", "score"), "nearest")
    # Rows that share a key are ranked together.
    hits = lookup_join(asking.select("query", "same"), best, ["same"], spread=["query"])
    return _nearest(hits, "query", k).select(
        F.col("query").alias(query_key), F.col("item").alias(item_key), "rank", "score"
    )
