"""Hashed bag-of-words vectors.

A token (``[a-z0-9]+`` of the lower-cased text) goes to bucket
``fold(h -> (h * 33 + code) mod 768)``. Unrolled, the fold is a sum of
``code * 33^(characters to its right)`` and needs no loop over characters, so a whole
Arrow batch is hashed with array arithmetic and no shuffle: each text is embedded
where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.schemas import EMBEDDING_DIMENSION
from faultline.session import spread

# Fixed value: multiplier of the token hash.
HASH_FACTOR = 33
# Characters, and texts, that are hashed at once; several numbers are held for each.
SLICE, TEXTS = 1 << 20, 1000


def _powers(dimension: int) -> tuple[np.ndarray, int, int]:
    """33^k mod dimension up to the point where it repeats: (table, start, period)."""
    seen: dict[int, int] = {}
    table: list[int] = []
    power = 1 % dimension
    while power not in seen:
        seen[power] = len(table)
        table.append(power)
        power = power * HASH_FACTOR % dimension
    start = seen[power]
    return np.array(table, dtype=np.int64), start, len(table) - start


def text_slices(texts: pd.Series) -> Iterator[slice]:
    """Runs of at most ``TEXTS`` texts and ``SLICE`` characters, or of one text that is longer."""
    at = size = 0
    for i, text in enumerate(texts):
        own = len(text) if isinstance(text, str) else 0
        if i > at and (size + own > SLICE or i - at == TEXTS):
            yield slice(at, i)
            at, size = i, 0
        size += own
    if at < len(texts):
        yield slice(at, len(texts))


def _pieces(token: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``SLICE`` bytes that cut no token; the last byte is of none."""
    at = 0
    while at < len(token):
        stop = min(at + SLICE, len(token))
        while token[stop - 1]:
            stop += 1
        yield at, stop
        at = stop


def count_buckets(
    texts: pd.Series, dimension: int = EMBEDDING_DIMENSION
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket, tokens in it) of a batch, ordered by text and bucket.

    The arrays of numbers per byte are those of one piece of the texts at a time.
    """
    encoded = [("" if t is None else t).lower().encode("utf-8") + b"\n" for t in texts]
    codes = np.frombuffer(b"".join(encoded), dtype=np.uint8)
    ends = np.cumsum([len(e) for e in encoded], dtype=np.int64)
    token = ((codes >= ord("a")) & (codes <= ord("z"))) | ((codes >= ord("0")) & (codes <= ord("9")))
    parts = [_count_cells(codes[a:b], np.flatnonzero(token[a:b]), a, ends, dimension) for a, b in _pieces(token)]
    if len(parts) == 1:
        cell, count = parts[0]
    else:  # a text may lie in several pieces
        cells = np.concatenate([np.empty(0, dtype=np.int64), *[c for c, _ in parts]])
        cell, place = np.unique(cells, return_inverse=True)
        count = np.zeros(len(cell), dtype=np.int64)
        np.add.at(count, place, np.concatenate([np.empty(0, dtype=np.int64), *[n for _, n in parts]]))
    return cell // dimension, cell % dimension, count


def _count_cells(
    codes: np.ndarray, kept: np.ndarray, start_at: int, ends: np.ndarray, dimension: int
) -> tuple[np.ndarray, np.ndarray]:
    """(text index * dimension + bucket, tokens in it) of bytes of which ``kept`` are in tokens."""
    if len(kept) == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    opens = np.ones(len(kept), dtype=bool)
    opens[1:] = np.diff(kept) != 1
    token = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    last = kept[np.append(first[1:] - 1, len(kept) - 1)]
    table, start, period = _powers(dimension)
    right = last[token] - kept
    right = np.where(right < len(table), right, start + (right - start) % period)
    terms = codes[kept].astype(np.int64) * table[right]
    bucket = np.add.reduceat(terms, first) % dimension
    owner = np.searchsorted(ends, kept[first] + start_at, side="right")
    return np.unique(owner * dimension + bucket, return_counts=True)


def count_matrix(texts: pd.Series, dimension: int = EMBEDDING_DIMENSION) -> np.ndarray:
    """Token counts per bucket, one row per text."""
    matrix = np.zeros((len(texts), dimension))
    for some in text_slices(texts):
        row, bucket, count = count_buckets(texts.iloc[some], dimension)
        matrix[some.start + row, bucket] = count
    return matrix


def hash_embed(
    df: DataFrame, key: str, text: str, dimension: int = EMBEDDING_DIMENSION
) -> DataFrame:
    """Non-zero components: (key, bucket, tokens, weight); none for a text without tokens."""
    key_type = df.schema[key].dataType.simpleString()

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in text_slices(batch[text]):
                row, bucket, count = count_buckets(batch[text].iloc[some], dimension)
                norm = np.sqrt(np.bincount(row, weights=count * count, minlength=some.stop - some.start))
                yield pd.DataFrame(
                    {
                        key: batch[key].to_numpy()[some][row],
                        "bucket": bucket,
                        "tokens": count,
                        "weight": count / norm[row],
                    }
                )

    return spread(df.select(key, text)).mapInPandas(
        embed, f"{key} {key_type}, bucket long, tokens long, weight double"
    )


def embedding_column(text: Column, dimension: int = EMBEDDING_DIMENSION) -> Column:
    """The whole vector as stored: components fixed to 8 decimals, then single precision."""

    # Arrow takes the numbers as they lie; a list of arrays would be made number by number.
    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        series = texts.to_pandas()
        vectors = np.zeros((len(series), dimension), dtype=np.float32)
        for some in text_slices(series):
            row, bucket, count = count_buckets(series.iloc[some], dimension)
            norm = np.sqrt(np.bincount(row, weights=count * count, minlength=some.stop - some.start))
            vectors[some.start + row, bucket] = np.round(count / norm[row], 8)
        ends = np.arange(len(series) + 1, dtype=np.int32) * dimension
        return pa.ListArray.from_arrays(ends, vectors.ravel())

    return embed(text)


def stored_form(vector: Column) -> Column:
    """A vector as the store keeps it: 8 decimals, then single precision."""
    return F.transform(vector, lambda x: F.round(x.cast("double"), 8).cast("float"))


def dimension_violations(
    df: DataFrame, key: str, vector: str, dimension: int = EMBEDDING_DIMENSION
) -> DataFrame:
    """Rows whose vector has the wrong length; they must not be written."""
    found = F.size(vector).cast("long")
    return df.filter(F.col(vector).isNotNull() & (found != dimension)).select(
        key, F.lit(dimension).cast("long").alias("expected"), found.alias("received")
    )
