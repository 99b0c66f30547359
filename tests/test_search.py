"""Vector search against brute force, in both forms."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from faultline.functions.embedding import count_matrix, embedding_column
from faultline.operators import search as S
from faultline.sources import adapters as A

KEYS = dict(query_key="query_id", item_key="id", query_content="text", item_content="body")


def brute(queries, items, k):
    q = count_matrix(pd.Series([t for _, t in queries]))
    d = count_matrix(pd.Series([t for _, t in items]))
    out = {}
    with np.errstate(invalid="ignore"):
        scores = q @ d.T / np.sqrt((q * q).sum(1)[:, None] * (d * d).sum(1)[None, :])
    for i, (query, _) in enumerate(queries):
        ranked = sorted(
            (3.0 if np.isnan(s) else round(1 - s, 6), item) for s, (item, _) in zip(scores[i], items, strict=True)
        )
        out[query] = [item for _, item in ranked[:k]]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_whole_tables_in_both_forms(spark, sf):
    queries, items = A.search_queries(spark, sf), A.runbooks(spark, sf)
    want = brute(
        [tuple(r) for r in queries.collect()], [(r["id"], r["body"]) for r in items.collect()], 20
    )
    assert listed(S.vector_topk(queries, items, limit=20, **KEYS)) == want
    blocks = S.vector_topk(queries, items, limit=20, query_rows=7, block_rows=33, **KEYS)
    assert listed(blocks) == want


def test_many_copies_of_one_passage_with_text_ids(spark):
    items = [(f"c{i:03d}", "store timeout" if i % 3 else "other words") for i in range(300)]
    queries = [("q1", "timeout"), ("q2", "nothing shared zzz"), ("q3", "--")]
    q = spark.createDataFrame(queries, "query_id string, text string")
    d = spark.createDataFrame(items, "id string, body string").repartition(7)
    got = listed(S.vector_topk(q, d, **KEYS))
    assert got["q1"] == ["c001", "c002", "c004", "c005", "c007"]
    assert got == brute(queries, items, 5)


def test_few_passages_with_text_ids_in_both_forms(spark):
    items = [("a", "store timeout"), ("b", "other words")]
    q = spark.createDataFrame([("q1", "timeout"), ("q2", "words other")], "query_id string, text string")
    d = spark.createDataFrame(items, "id string, body string").repartition(8)
    want = {"q1": ["a", "b"], "q2": ["b", "a"]}
    assert listed(S.vector_topk(q, d, **KEYS)) == want
    assert listed(S.vector_topk(q, d, query_rows=1, block_rows=1, **KEYS)) == want
    assert S.vector_topk(q, d.filter("false"), **KEYS).count() == 0


def test_zero_vectors_sort_last_and_rows_fill_up_to_k(spark):
    items = [(1, "..."), (2, "alpha"), (3, "beta"), (4, None)]
    d = spark.createDataFrame(items, "id int, body string")
    q = spark.createDataFrame([(1, "alpha"), (2, "!!")], "query_id int, text string")
    got = S.vector_topk(q, d, **KEYS).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, 2), (1, 3), (1, 1), (2, 1), (2, 2), (2, 3)]
    assert got[0]["score"] == 1.0 and got[1]["score"] == 0.0
    assert all(np.isnan(r["score"]) for r in got[2:])


@pytest.mark.parametrize("limit", [0, 21, -1, 2.5, "5"])
def test_limit_is_checked(limit):
    with pytest.raises(ValueError):
        S.check_limit(limit)


def test_empty_queries_are_set_apart(spark):
    q = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "query_id int, text string")
    usable, rejected = S.split_queries(q)
    assert [r[0] for r in usable.collect()] == [1]
    assert sorted(r[0] for r in rejected.collect()) == [2, 3]


def test_no_queries(spark):
    q = spark.createDataFrame([], "query_id int, text string")
    d = spark.createDataFrame([(1, "alpha")], "id int, body string")
    assert S.vector_topk(q, d, **KEYS).count() == 0


def test_stored_vectors_give_the_same_neighbours(spark, sf):
    """The stored form keeps 8 decimals in single precision: scores agree to 6 places."""
    queries, items = A.search_queries(spark, sf), A.runbooks(spark, sf)
    stored = items.withColumn("vector", embedding_column(F.col("body")))
    exact = S.vector_topk(queries, items, **KEYS).alias("a")
    other = S.vector_topk(
        queries, stored, **{**KEYS, "item_content": "vector"},
        to_vectors=S.dense_vectors, to_query_vectors=S.text_vectors,
    ).alias("b")
    both = exact.join(other, ["query_id", "rank"])
    worst = both.agg(F.max(F.abs(F.col("a.score") - F.col("b.score")))).first()[0]
    assert both.count() == 200 and worst < 1e-6


def test_a_large_query_side_goes_by_blocks(spark, monkeypatch):
    q = spark.createDataFrame([(1, "alpha " * 50), (2, "beta")], "query_id int, text string")
    d = spark.createDataFrame([(1, "alpha"), (2, "beta gamma")], "id int, body string")
    want = listed(S.vector_topk(q, d, **KEYS))
    monkeypatch.setattr(S, "SIDE_BYTES", 100)
    assert listed(S.vector_topk(q, d, **KEYS)) == want == {1: [1, 2], 2: [2, 1]}
