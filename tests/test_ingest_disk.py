"""What an ingest of runbooks keeps on disk: every text and vector once."""

import os
import time

from pyspark.sql import functions as F

from faultline import session
from faultline.functions.embedding import embedding_column
from faultline.operators import keyed
from faultline.plans import runbooks
from tests.conftest import rows
from tests.test_plans import plan

CHUNK = "id string, runbook_id long, chunk_index int, content string, embedding array<float>, note string, metadata string"


def scratch(spark):
    top = f"{session.shared_dir(spark)}/faultline/{spark.sparkContext.applicationId}"
    return {f"{top}/{f}" for f in os.listdir(top)} if os.path.isdir(top) else set()


def shuffled(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    names = (blocks.apply(i).name() for i in range(blocks.length()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def books(spark, count=40):
    made = [(i, None, f"slug-{i}", f"Symptoms: number {i % 7}.\nLicense: the same line everywhere.") for i in range(count)]
    return spark.createDataFrame(made, "id long, service_id long, slug string, body string")


def test_an_ingest_keeps_every_text_once(spark):
    services = spark.createDataFrame([], "id long, name string")
    first = session.materialize(runbooks.ingest_runbooks(books(spark), services)[0], "stored")
    changed = books(spark).withColumn("body", F.concat("body", F.lit("\nOwner: team "), F.col("id") % 3))
    for stored, distinct in ((None, 11), (first, 11)):
        before = scratch(spark)
        after, counts = runbooks.ingest_runbooks(changed, services, stored)
        texts = [df for df in map(spark.read.parquet, scratch(spark) - before) if "content" in df.columns]
        kept = [r["content"] for df in texts for r in df.select("content").collect()]
        assert len(kept) == len(set(kept)) == distinct  # was twice that, and every chunk's besides
        got = {(r["runbook_id"], r["chunk_index"]): (r["content"], list(r["embedding"])) for r in after.collect()}
        assert after.count() == len(got) == 120 and rows(counts) == [{"runbooks": 40, "chunks": 120}]
        vectors = spark.createDataFrame([(t,) for t in set(kept)], "t string").select("t", embedding_column(F.col("t")).alias("v"))
        want = {r["t"]: list(r["v"]) for r in vectors.collect()}
        assert all(vector == want[text] for text, vector in got.values())


def test_contents_are_folded_before_they_are_shuffled(spark, monkeypatch):
    """A line that most chunks share leaves a task once, whether vectors are stored already or not."""
    made = {}
    monkeypatch.setattr(
        runbooks, "materialize", lambda df, label, **k: made.setdefault(label, plan(df)) and session.materialize(df, label, **k)
    )
    services = spark.createDataFrame([], "id long, name string")
    first = session.materialize(runbooks.ingest_runbooks(books(spark), services)[0], "stored")
    for stored in (None, first):
        made.clear()
        runbooks.ingest_runbooks(books(spark), services, stored)
        steps = made["vectors"].split("\n")
        at = next(i for i, step in enumerate(steps) if "partial_first(content" in step)
        assert "Exchange" in steps[at - 1] and steps[at - 1].count("content_hash") == 1
        assert not any("Exchange" in step for step in steps[at + 1 : at + 3]) and "FileScan" in steps[at + 2]


def test_a_lean_write_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    setting = spark.conf.get(session.FREE_SHUFFLES, None)
    counted = spark.range(1000).groupBy(F.col("id") % 10).count()
    assert session.materialize(counted, "counted", lean=True).count() == 10
    until = time.time() + 10
    while (left := {n for n in shuffled(spark) - before if not n.startswith("shuffle_0_")}) and time.time() < until:
        time.sleep(0.2)
    # The count that was just made has a shuffle of its own, of one file for each of its tasks.
    assert len(left) <= spark.sparkContext.defaultParallelism
    assert spark.conf.get(session.FREE_SHUFFLES, None) == setting


def test_a_passing_table_goes(spark):
    before = scratch(spark)
    with session.passing(spark.range(5), "passing") as table:
        assert table.count() == 5 and len(scratch(spark) - before) == 1
    assert scratch(spark) == before


def test_contents_by_hash_upsert_as_contents_in_rows(spark, monkeypatch):
    old = [
        ("a", 1, 0, "one", [1.0], "x", "m"), ("b", 1, 1, "two", None, "y", None), ("c", 2, 0, None, [2.0], None, "m"),
        ("d", None, 0, "three", [3.0], "z", "m"), ("e", 3, None, "four", None, "w", "m"), ("f", 1, 0, "one again", [4.0], "v", "m"),
    ]
    new = [("n1", 1, 0, "two", [5.0], "s"), ("n2", None, 0, "two", [5.0], "t"), ("n3", 9, 9, "six", [6.0], None), ("n4", 3, None, "six", [6.0], "u")]
    target = spark.createDataFrame(old, CHUNK)
    source = spark.createDataFrame(new, "id string, runbook_id long, chunk_index int, content string, embedding array<float>, metadata string")
    source = source.withColumns({"note": F.lit(None).cast("string"), "batch_seq": F.lit(0)})
    hashed = source.withColumn("content_hash", runbooks.content_hash())
    contents = hashed.select("content_hash", "content", "embedding").dropDuplicates(["content_hash"])
    for small in (200_000, 0):
        monkeypatch.setattr(keyed, "BROADCAST_ROWS", small)
        for prune in (False, True):
            whole = keyed.upsert_chunks(target, source, prune_stale=prune)
            apart = keyed.upsert_chunks(target, hashed.drop("content", "embedding"), prune_stale=prune, contents=contents)
            assert apart.columns == whole.columns
            assert sorted(map(str, apart.collect())) == sorted(map(str, whole.collect()))
