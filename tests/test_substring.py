"""Substring search by trigrams against looking into every text."""

from pyspark.sql import functions as F

from faultline.operators import substring as S
from faultline.session import materialize


def found(df):
    return sorted((r["needle"], r["key"]) for r in df.collect())


def brute(texts, needles):
    asked = {n for n in needles if n is not None}
    return sorted((n, k) for n in asked for k, t in texts if t is not None and n in t)


def test_all_words_over_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.explode(F.split("text", r"\s+")).alias("needle"))
    phrases = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("text").alias("needle"))
    needles = words.union(phrases)
    index = S.TrigramIndex.build(docs, "doc_id", "text")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    asked = [r[0] for r in needles.collect()]
    assert any(len(n) < 3 for n in asked)
    assert found(S.find(index, needles)) == brute(texts, asked)


def test_long_needles_look_into_few_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    phrases = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.substring("text", 1, 60).alias("needle"))
    index = S.TrigramIndex.build(docs, "doc_id", "text")
    sizes = index.contents.groupBy("block").agg(F.count("*").alias("rows"))
    verified = S.candidates(index, phrases).join(sizes, "block").agg(F.sum("rows")).first()[0] or 0
    pairs = index.contents.count() * phrases.distinct().count()
    assert verified < pairs / 20


def test_short_needles_ends_and_awkward_rows(spark):
    texts = [
        (1, "timeout of store"), (2, ""), (3, None), (4, "a"), (5, "ab"), (6, "Ab\nba"), (None, "ab"), (5, "ab"),
        (7, "x" * 70_000 + "needle" + "y" * 70_000), (8, "x" * 65_535 + "seam" + "y" * 10), (9, "naïve 😀 smile 😀😀"),
        (10, "50% off [a-z]+ \\d $1"),
    ]
    needles = [
        "", None, "a", "b", "ab", "bb", "ba", "e", "store", "stores", "re", "\nb", "needle", "xneedley", "seam", "xsea",
        "😀", "😀😀", " 😀 ", "ïv", "naïve", "[a-z]+", "\\d", "$1", "%", "ab", "y", "\0", "store\0",
    ]
    df = spark.createDataFrame(texts, "key int, text string").repartition(3)
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    key = lambda p: (p[0], -1 if p[1] is None else p[1])
    want = sorted(((n, k) for n in {n for n in needles if n is not None} for k, t in texts if t is not None and n in t), key=key)
    for rows in (1, 100):
        index = S.TrigramIndex.build(df, "key", "text", block_rows=rows)
        got = sorted(((r["needle"], r["key"]) for r in S.find(index, asked).collect()), key=key)
        assert got == want


def test_empty_tables_and_a_stored_index(spark, tmp_path):
    none = spark.createDataFrame([], "key int, text string")
    some = spark.createDataFrame([(1, "abc"), (2, "abcd")], "key int, text string")
    asked = spark.createDataFrame([("abc",), ("bcd",), ("",)], "needle string")
    assert found(S.find(S.TrigramIndex.build(none, "key", "text"), asked)) == []
    S.TrigramIndex.build(some, "key", "text", f"{tmp_path}/index")
    index = S.TrigramIndex.open(spark, f"{tmp_path}/index")
    assert found(S.find(index, asked)) == brute([(1, "abc"), (2, "abcd")], ["abc", "bcd", ""])
    assert found(S.find(index, asked.limit(0))) == []


def test_a_text_of_very_many_rows_is_looked_into_once(spark):
    copies = spark.range(5000).select(F.col("id").alias("key"), F.lit("the same line").alias("text"))
    index = S.TrigramIndex.build(materialize(copies, "copies"), "key", "text")
    assert index.contents.count() == 1
    asked = spark.createDataFrame([("same",)], "needle string")
    assert S.find(index, asked).count() == 5000
