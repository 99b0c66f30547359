"""What a trigger of the ingest stream moves: one change per key, facts that name no version stay put."""

from pyspark.sql import functions as F

from faultline.catalog import workspace as ws
from faultline.operators import keyed
from faultline.sources.changes import ChangeLog
from tests.conftest import rows

PLACE = "struct<generatedAt:string,batch_id:string,ordinal:int>"


def test_an_epoch_stores_the_last_row_of_a_service(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    sent = [(f"id-{n}", n, f"r{i}", (f"2024-01-0{i}", "b", 0)) for n in ("one", "two") for i in (2, 3, 1)]
    log.put("services", spark.createDataFrame(sent, f"id string, name string, runtime string, batch_seq {PLACE}"), "s", 0)
    assert log.changes("services").count() == 2
    assert {r["name"]: r["runtime"] for r in rows(log.current("services"))} == {"one": "r3", "two": "r3"}
    raised = [("a", "sc", f"t{i}", (f"2024-01-0{i}", "b", 0)) for i in (1, 2, 3)]
    shape = f"id string, scenario_id string, title string, batch_seq {PLACE}"
    log.put("incidents", spark.createDataFrame(raised, shape), "s", 0)
    assert log.changes("incidents").count() == 3  # a tombstone may fall between them


def test_rows_without_a_version_are_not_joined(spark):
    facts = spark.createDataFrame([(1, "s", "v1"), (2, "s", "v2"), (3, "s", None), (4, None, None)], "id long, service_id string, deployment_version string")
    known = spark.createDataFrame([("s", "v1", "d1"), ("s", None, "d2")], "service_id string, version string, id string")
    found = keyed.resolve_deployment(facts, known, ["id"])
    assert sorted((r["id"], r["deployment_id"]) for r in rows(found)) == [(1, "d1"), (2, None), (3, None), (4, None)]


def test_the_posted_folder_is_compressed(spark, sf):
    folder = ws.posted_folder(spark, sf)
    files = spark.read.format("binaryFile").load(folder).agg(F.sum("length")).first()[0]
    text = spark.read.text(folder)
    assert text.count() == ws.batch_texts(spark, sf).count()
    assert files < text.agg(F.sum(F.octet_length("value"))).first()[0] / 2
