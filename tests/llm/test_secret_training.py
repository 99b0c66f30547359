"""The secret network is fitted on every finding, by tasks."""

import random

import numpy as np
from pyspark.sql import functions as F

from faultline.llm import secret_scan as S
from llm_tables import listed


def texts():
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        secret = "".join(rng.choices("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=30)) + "7"
        number = "".join(rng.choices("0123456789", k=18))
        rows.append((i, f"the token = {secret} was used, order {number} is paid"))
    return rows + [(5000, "token = " + "aB3dE6" * 900 + " end"), (5001, "count " + "ghi12345" * 80 + " end")]


def test_every_finding_is_fitted(spark, monkeypatch):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    found = S.extracted(docs)
    all_of_them = S.training_findings(found)
    counts = {r["known"]: r["count"] for r in all_of_them.groupBy("known").count().collect()}
    assert counts == {True: 1201, False: 1201}  # more than 800, and those longer than 512 too
    monkeypatch.setattr(S, "SHARE", 500)
    network = S.fit(all_of_them)
    some = [("it is ", "9f3KqLx7Zt0PbVw2RmNc8YdGh4Sj6Ta1Ue5Xo", " in"), ("order ", "484516811441073298", " is")]
    secret, number = network.scores([S.coded(*c) for c in some])
    assert secret >= network.threshold > number
    again = S.fit(all_of_them)
    assert np.allclose(network.filters, again.filters) and np.isclose(network.threshold, again.threshold)
    spans = {r["doc_id"]: r["spans"] for r in listed(S.scan(docs))}
    assert len(spans) == 1202 and [s["kind"] for s in spans[5000]] == ["assign"]


def test_long_findings_are_fitted_whole():
    value = "".join(chr(97 + i % 26) for i in range(3 * S.PIECE + 5))
    cut = S.pieces("before ", value, " after")
    assert "".join(v for _, v, _ in cut) == value and max(len(v) for _, v, _ in cut) == S.PIECE
    assert cut[0][0] == "before " and cut[1][0] == value[S.PIECE - S.BEFORE : S.PIECE] and cut[-1][2] == " after"


def test_ranks_are_exact(spark):
    values = [random.Random(i).gauss(0, 1) for i in range(3000)] + [2.0] * 50 + [1e9, -1e9]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for place in (0, 1, 60, 1500, 3051):
        assert S.ranked(rows, "v", place, few=20, bins=7) == sorted(values)[place]
    assert S.ranked(rows.where(F.col("v") == 2.0), "v", 3) == 2.0
