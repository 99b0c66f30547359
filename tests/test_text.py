"""Chunking, hashing and token estimates against plain Python on the given documents."""

import math
import re

import pandas as pd
import regex
from pyspark.sql import functions as F

from faultline.functions import embedding as E
from faultline.functions import text as T
from faultline.plans.runbooks import chunk_runbooks
from faultline.sources import adapters as A
from tests.conftest import rows

# The ECMAScript white space, written out independently of the library.
WS = "\t\n\x0b\x0c\r " + "".join(
    chr(int(p, 16))
    for p in (
        "A0 1680 2000 2001 2002 2003 2004 2005 2006 2007 2008 2009 200A 2028 2029 202F 205F 3000 FEFF"
    ).split()
)


def units(s):
    return len(s.encode("utf-16-be")) // 2


def bucket_of(token):
    """A token's bucket as the closed sum of its characters' shares."""
    return sum(ord(c) * pow(33, len(token) - 1 - i, 768) for i, c in enumerate(token)) % 768


SENTENCE_END = re.compile(rf"(?<=[.!?])[{WS}]+")


def check_chunks(pieces, body, limit):
    """What holds for the pieces of any text, whatever way they are made."""
    words = [w for w in re.split(f"[{WS}]+", body) if w]
    assert [w for p in pieces for w in re.split(f"[{WS}]+", p)] == words  # nothing lost, nothing twice
    for piece in pieces:
        assert piece and piece == piece.strip(WS)
        # A piece over the limit is a single sentence.
        assert units(piece) <= limit or not SENTENCE_END.search(piece)
    for piece, following in zip(pieces, pieces[1:]):
        first = SENTENCE_END.split(following)[0]
        opens = re.match(rf"#{{1,3}}([{WS}]|$)|[A-Z][A-Za-z0-9 /-]{{2,}}:", following)
        # A piece ends before a heading, or where the next sentence would be too much.
        assert opens or units(piece) + 1 + units(first) > limit


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


ODD = [
    "Signs: The queue grows past ten thousand.\nFirst step: Drain the slow shard and watch it.",
    "",
    "  \n \n\t ",
    "# One\n#\n## Two\ntext\n###Three\n#### Four\nAb: x\nAbc: y\nabc: z",
    " Lead: a. b! c?  d　\n﻿Next/Part-2: e",
    "x" * 2000,
    " ".join(f"Sentence {i} is here." for i in range(200)),
    ("\U0001f600" * 300 + ". ") * 4,
    "Trailing spaces. " * 120 + "\n\nEnd: done.",
    "a.  b. c. " * 400,
]


def test_chunks_of_odd_texts(spark):
    for body in ODD:
        check_chunks(one(spark, body, T.chunk_text), body, 900)
    assert one(spark, ODD[3], T.chunk_text) == ["# One", "#", "## Two\ntext\n###Three\n#### Four\nAb: x", "Abc: y\nabc: z"]
    assert [len(p) for p in one(spark, "a. " * 500, T.chunk_text)] == [899, 599]


def test_chunks_of_all_documents(spark, sf):
    docs = A.table(spark, sf, "documents")
    for limit in (900, 200):
        for row in docs.select("text", T.chunk_text(F.col("text"), limit).alias("c")).collect():
            check_chunks(row["c"], row["text"], limit)


def test_chunk_rows(spark):
    runbooks = spark.createDataFrame(
        [("r1", "latency", ODD[0], "rec"), ("r2", "blank", "  \n ", None)],
        "id string, slug string, body string, service_name string",
    )
    got = rows(chunk_runbooks(runbooks).orderBy("chunk_index"))
    assert [(r["runbook_id"], r["chunk_index"], r["content"]) for r in got] == [
        ("r1", 0, "Signs: The queue grows past ten thousand."),
        ("r1", 1, "First step: Drain the slow shard and watch it."),
    ]
    assert got[0]["metadata"] == {"slug": "latency", "serviceName": "rec", "contentLength": 41}


def test_utf16_length(spark):
    assert one(spark, "a\U0001f600", T.utf16_length) == 3


def test_buckets():
    known = {"feature": 524, "store": 557, "timeout2": 377, "a": 97}
    for token, bucket in known.items():
        assert bucket_of(token) == bucket
    long_token = "z9" * 5000
    texts = pd.Series([*known, long_token, "", None, "Été A-b a_b A"])
    row, bucket, count = E.count_buckets(texts)
    got = list(zip(row.tolist(), bucket.tolist(), count.tolist(), strict=True))
    assert got[:4] == [(i, b, 1) for i, b in enumerate(known.values())]
    assert got[4] == (4, bucket_of(long_token), 1)
    tail = {}
    for token in ("t", "a", "b", "a", "b", "a"):
        tail[bucket_of(token)] = tail.get(bucket_of(token), 0) + 1
    assert {(b, c) for r, b, c in got[5:] if r == 7} == set(tail.items())
    assert all(r == 7 for r, _, _ in got[5:])


def test_embedding_of_all_documents(spark, sf):
    docs = A.table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in E.hash_embed(docs, "doc_id", "text").collect():
        got.setdefault(r["doc_id"], {})[r["bucket"]] = (r["tokens"], r["weight"])
    for doc, body in texts.items():
        counts = {}
        for token in re.findall("[a-z0-9]+", body.lower()):
            counts[bucket_of(token)] = counts.get(bucket_of(token), 0) + 1
        norm = math.sqrt(sum(c * c for c in counts.values()))
        assert {b: t for b, (t, _) in got.get(doc, {}).items()} == counts
        assert all(abs(w - counts[b] / norm) < 1e-12 for b, (_, w) in got.get(doc, {}).items())


def test_whole_vector_in_stored_form(spark):
    df = spark.createDataFrame([("feature store feature",), ("",)], "t string")
    filled, empty = (r["v"] for r in df.select(E.embedding_column(F.col("t")).alias("v")).collect())
    assert len(filled) == len(empty) == 768
    assert set(empty) == {0.0}
    assert abs(filled[524] - 2 / math.sqrt(5)) < 1e-6 and abs(filled[557] - 1 / math.sqrt(5)) < 1e-6


def test_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0] * 768), (3, None)], "id int, v array<double>")
    assert rows(E.dimension_violations(df, "id", "v")) == [{"id": 1, "expected": 768, "received": 3}]


def test_token_estimates(spark, sf):
    assert one(spark, "  \n", T.estimate_tokens) == 0
    assert one(spark, "x", T.estimate_tokens) == 1
    assert one(spark, "feature store timeout recommendation latency", T.estimate_tokens) == 11
    assert one(spark, "a b c d", T.estimate_tokens) == 4
    messages = A.messages(spark, sf).select("content", T.estimate_tokens(F.col("content")).alias("n"))
    for r in messages.collect():
        clean = r["content"].strip(WS)
        words = len(regex.findall(r"[\p{L}\p{N}_'-]+", clean))
        assert r["n"] == (max(1, words, math.ceil(units(clean) / 4)) if clean else 0)
