"""Questions of equal vectors share one search."""

import itertools

from faultline.operators import search
from tests.conftest import rows


def test_texts_of_one_vector_are_scored_once(spark, monkeypatch):
    asked = [(i, " ".join(words)) for i, words in enumerate(itertools.permutations(["pay", "slow", "cart", "mail"]))]
    asked += [(0, "pay slow"), (None, "mail cart"), (None, "cart, mail")]
    queries = spark.createDataFrame(asked, "key long, text string")
    items = spark.createDataFrame([(f"i{n}", t) for n, t in enumerate(("pay", "slow cart", "mail", "pay slow", "x"))], "id string, body string")
    sizes = []
    monkeypatch.setattr(search, "measure", lambda df, count=search.measure: sizes.append(count(df)) or sizes[-1])
    names = {"query_key": "key", "item_key": "id", "query_content": "text", "item_content": "body"}
    got = rows(search.vector_topk(queries, items, limit=2, **names))
    assert sizes[0][0] == 3  # four words, two of them, two others
    by_key = {}
    for row in sorted(got, key=lambda r: r["rank"]):
        by_key.setdefault(row["key"], []).append((row["id"], round(row["score"], 6)))
    half = round(0.5**0.5, 6)
    assert by_key[7] == [("i1", half), ("i3", half)]
    assert by_key[0] == [("i3", 1.0), ("i0", half)]  # rows of one key are ranked together
    assert by_key[None] == [("i2", half), ("i2", half)]
    sizes.clear()
    assert sorted(map(str, rows(search.vector_topk(queries, items, limit=2, query_rows=1, block_rows=2, **names)))) == sorted(map(str, got))
