"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from faultline.catalog import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = registry()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, duck):
    query, sql = QUERIES[name]
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, row)) for row in df.select(*columns).collect())
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = sorted(tuple(plain(row[i]) for i in place) for row in result.fetchall())
    assert got == want


def test_a_second_run_gives_the_same(spark, sf):
    for name in ("incident_logs", "incident_metric_summary", "vector_topk"):
        first, second = (sorted(map(str, QUERIES[name][0](spark, sf).collect())) for _ in range(2))
        assert first == second
