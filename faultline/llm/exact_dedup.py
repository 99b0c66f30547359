"""Exact duplicates by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import BLANK, smallest, texts
from faultline.session import lookup_join, materialize


def content(text: Column) -> Column:
    """The part of a text that counts: everything but blanks."""
    return F.regexp_replace(text, BLANK + "+", "")


def content_hash(value: Column) -> Column:
    return F.unhex(F.md5(value))


def duplicate_groups(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree in every byte once blanks are deleted; a null text
    counts as empty, so null, empty and blank texts form one group. The row with the most
    code points in its original text stays, then the smallest doc_id (null is the last).
    Rows that repeat both text and doc_id are ranked, and one of them stays. An empty
    table gives an empty result. Other columns are not looked at.

    A group is keyed by the hash and by the bytes, so texts that only share ``hashed``
    part. Copies are folded on the map side: of a text that fills a third of the table
    each task sends one row. Documents meet their group through the hash and the digest,
    in a join whose large side adaptive execution may split.
    """
    rows = texts(docs).select("doc_id", "text", content(F.col("text")).alias("body"))
    rows = rows.select(
        "doc_id", "body", F.char_length("text").alias("points"), hashed(F.col("body")).alias("hash")
    )
    groups = rows.groupBy("hash", "body").agg(
        F.count("*").alias("group_size"),
        F.max(F.struct("points", smallest(F.col("doc_id")).alias("rank"))).alias("best"),
    )
    groups = groups.select(
        "hash",
        F.sha2("body", 256).alias("text_sha256"),
        smallest(F.col("best.rank")).alias("keep_id"),
        "group_size",
    )
    members = rows.groupBy("doc_id", "hash", F.sha2("body", 256).alias("text_sha256")).agg(
        F.count("*").alias("repeats")
    )
    found = members.join(groups, ["hash", "text_sha256"])
    first = F.col("repeat") == 1
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        "text_sha256",
        F.explode(F.sequence(F.lit(1).cast("long"), "repeats")).alias("repeat"),
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (first & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are.

    Of rows that repeat text and doc_id the one with the most code points stays, then the
    first by its other columns. Texts move once, to be compared; rows meet the keys of what
    goes in a join that broadcasts these only if they are counted few.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    id_at, text_at = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text_sha256").alias("_sha")]
    found = duplicate_groups(docs).groupBy(*key).agg(F.max("kept").alias("_stays"), F.count("*").alias("_n"))
    found = materialize(found.where(~F.col("_stays") | (F.col("_n") > 1)).drop("_n"), "duplicate-keys")
    whole = F.coalesce(F.col(text_at).cast("string"), F.lit(""))
    rows = docs.toDF(*names).withColumns(
        {"_id": F.coalesce(F.col(id_at).cast("long").cast("string"), F.lit("")), "_sha": F.sha2(content(whole), 256)}
    )
    rows = lookup_join(rows, found, ["_id", "_sha"], "left", spread=[text_at])
    others = [F.to_json(F.struct(n)) for n in names if n not in (id_at, text_at)]
    order = Window.partitionBy("_id", "_sha").orderBy(F.char_length(whole).desc(), F.col(text_at), *others)
    repeated = rows.where("_stays").withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return rows.where("_stays IS NULL").select(*names).union(repeated.select(*names)).toDF(*docs.columns)


SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
    FROM documents
), r AS (
    SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
           first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS keep_id
    FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM r
"""
