"""What is costly in Python is done once: answers by prompt, vectors by content."""

import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.functions.embedding import embedding_column
from faultline.plans import investigate as inv
from faultline.plans import runbooks
from tests.conftest import rows


def model(folder, bad=(), crash=None):
    """Answers in capitals and notes what it was asked; some prompts raise, one ends its worker once."""

    def call(batch, temperature, tokens):
        texts = list(batch["prompt_text"])
        if crash in texts and not os.path.exists(f"{folder}/crashed"):
            open(f"{folder}/crashed", "w").close()
            os._exit(3)
        if set(texts) & set(bad):
            raise ValueError(f"no {sorted(set(texts) & set(bad))[0]}")
        with open(f"{folder}/{uuid.uuid4().hex}.asked", "w") as out:
            out.write("\n".join(texts))
        return [t.upper() for t in texts]

    return call


def asked(folder):
    found = [open(os.path.join(folder, f)).read().split("\n") for f in os.listdir(folder) if f.endswith(".asked")]
    return sorted(t for part in found for t in part)


def prompts(spark, count, same=0):
    made = [(i, f"prompt {i if i >= same else 0}") for i in range(count)]
    return spark.createDataFrame(made, "incident_id long, prompt_text string")


def test_a_lost_worker_costs_its_group_only(spark, tmp_path):
    log, notes = str(tmp_path / "log"), str(tmp_path)
    table, crash = prompts(spark, 200), "prompt 77"
    call = model(notes, bad=("prompt 5", "prompt 6"), crash=crash)
    with pytest.raises(Exception):  # one attempt per task here, so the job fails
        inv.batch_generate(table, call, answers=log, group=8)
    got = {r["incident_id"]: r for r in rows(inv.batch_generate(table, call, answers=log, group=8))}
    assert len(got) == 200
    assert all(got[i]["response"] == f"PROMPT {i}" for i in range(200) if i not in (5, 6))
    assert [(got[i]["response"], got[i]["error_name"], got[i]["error_message"]) for i in (5, 6)] == [
        (None, "ValueError", "no prompt 5"), (None, "ValueError", "no prompt 6"),
    ]
    done = asked(notes)
    twice = {t for t in done if done.count(t) > 1}
    # Tasks that were running when the job failed had a group of about eight each in hand.
    assert set(done) == {f"prompt {i}" for i in range(200) if i not in (5, 6)}
    assert max(map(done.count, done)) <= 2 and len(twice) <= 8 * 16


def test_answers_are_asked_once(spark, tmp_path):
    log, notes = str(tmp_path / "log"), str(tmp_path)
    first = rows(inv.batch_generate(prompts(spark, 60, same=20), model(notes), answers=log, group=16))
    assert len(first) == 60 and len(asked(notes)) == 41  # equal prompts are asked once
    again = rows(inv.batch_generate(prompts(spark, 70, same=20), model(notes), answers=log, group=16))
    assert len(asked(notes)) == 51 and {r["response"] for r in first} < {r["response"] for r in again}
    # Another model is another question; what got an error is asked again.
    rows(inv.batch_generate(prompts(spark, 3), model(notes), answers=log, model="other"))
    assert len(asked(notes)) == 54
    failed = rows(inv.batch_generate(prompts(spark, 4), model(notes, bad=("prompt 3",)), answers=log, model="other"))
    assert sum(r["error_name"] is not None for r in failed) == 1
    mended = rows(inv.batch_generate(prompts(spark, 4), model(notes), answers=log, model="other"))
    assert {r["response"] for r in mended} == {f"PROMPT {i}" for i in range(4)} and len(asked(notes)) == 55
    assert rows(inv.batch_generate(prompts(spark, 4).limit(0), model(notes))) == []


def test_only_unseen_contents_are_embedded(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(text):
        plain = embedding_column(text)

        @F.pandas_udf("string")
        def noted(texts: pd.Series) -> pd.Series:
            seen.add(len(texts))
            return texts

        return F.when(noted(text).isNotNull(), plain)

    books = spark.createDataFrame(
        [(i, None, f"slug-{i}", f"Symptoms: number {i % 7}.\nLicense: the same line everywhere.") for i in range(40)],
        "id long, service_id long, slug string, body string",
    )
    services = spark.createDataFrame([], "id long, name string")
    chunks, counts = runbooks.ingest_runbooks(books, services, embed=embed)
    chunks = chunks.cache()
    assert rows(counts) == [{"runbooks": 40, "chunks": 80}] and chunks.count() == 80
    assert seen.value == 8  # seven texts and the line that all share
    plain = runbooks.chunk_runbooks(books.withColumn("service_name", F.lit(None).cast("string")))
    want = {r.id: list(r.e) for r in plain.select("id", embedding_column(F.col("content")).alias("e")).collect()}
    assert {r.id: list(r.embedding) for r in chunks.collect()} == want
    after, _ = runbooks.ingest_runbooks(books, services, chunks, embed=embed)
    assert {r.id: list(r.embedding) for r in after.collect()} == want and seen.value == 8
    body = F.when(F.col("id") == 3, "Symptoms: something new.\nLicense: the same line everywhere.").otherwise(F.col("body"))
    after, _ = runbooks.ingest_runbooks(books.withColumn("body", body), services, chunks, embed=embed)
    assert after.count() == 80 and seen.value == 9
    changed = {r.id for r in after.collect() if list(r.embedding) != want[r.id]}
    assert changed == {"3#0"}
