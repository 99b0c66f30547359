"""Plans: no cross product, no row-at-a-time Python, pruned and filtered scans."""

import pytest

from faultline.catalog import registry
from faultline.operators import lookup
from faultline.sources import adapters as A

QUERIES = registry()
PYTHON = {  # whole-batch array arithmetic, or the injected model call
    "hash_embed", "vector_topk", "vector_topk_dense", "batch_generate", "ingest_runbooks",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_product_and_no_python_in_the_way(name, spark, sf):
    text = plan(QUERIES[name][0](spark, sf))
    assert "BatchEvalPython" not in text
    if name not in PYTHON:
        assert "InPandas" not in text and "ArrowEvalPython" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_log_search_pushes_filters_and_keeps_a_top_n(spark, sf):
    df = lookup.log_search(
        A.log_entries(spark, sf), A.services(spark, sf), service="Customer#000000007", start="2024-01-05"
    )
    text = plan(df)
    assert "TakeOrderedAndProject" in text
    assert "GreaterThanOrEqual(ts" in text
    assert "EqualTo(c_name" in text
    scan = next(line for line in text.split("\n") if "event_id" in line and "ReadSchema" in line)
    assert "value" not in scan.split("ReadSchema")[1]


def test_detection_reads_only_what_it_needs(spark, sf):
    text = plan(QUERIES["service_signals_volume"][0](spark, sf))
    schemas = [line.split("ReadSchema")[1] for line in text.split("\n") if "l_suppkey" in line and "ReadSchema" in line]
    assert len(schemas) == 2
    assert all("l_comment" not in s and "l_orderkey" not in s and "l_quantity" not in s for s in schemas)


def test_ranks_are_limited_before_the_shuffle(spark, sf):
    text = plan(QUERIES["vector_topk"][0](spark, sf))
    assert "WindowGroupLimit" in text


def test_integrity_reads_each_table_once_and_shuffles_keys_once(spark, tmp_path):
    from faultline.operators import keyed

    services = spark.range(50).selectExpr("concat('s', id) AS id", "concat('n', id) AS name")
    # One service has most logs; one log names none that is known, and one id stands twice.
    logs = spark.range(4000).selectExpr(
        "concat('l', if(id = 7, 8, id)) AS id", "CASE WHEN id = 3 THEN 'gone' WHEN id % 3 = 0 THEN concat('s', id % 50) ELSE 's1' END AS service_id"
    )
    tables = {"services": services, "log_entries": logs, "incidents": logs.limit(9)}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    found = keyed.check_integrity({name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables})
    text = plan(found)
    assert text.count("FileScan parquet") == 3 and text.count("Exchange") == 2
    assert text.count("hashpartitioning(rule") == 2 and "Join" not in text
    broken = {tuple(r[c] for c in ("table_name", "rule", "columns", "rows")) for r in found.collect()}
    assert {("log_entries", "foreign_key", "service_id", 1), ("log_entries", "unique", "id", 2)} <= broken
