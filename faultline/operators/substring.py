"""Which texts contain which needles, for many needles at once, by an index of trigrams.

Texts are folded to distinct contents and dealt to blocks of a few; the index says which
blocks have a trigram. A needle's candidates are the blocks of its rarest trigram that have
its next rarest ones too, and only their contents are looked into. So what is found is
exact, whatever the index lets through.

* Two closing characters are added to a text before it is cut, so that every place of it
  begins a trigram: needles of one or two characters are the heads of trigrams.
* Copies of a text are one content, so a text that a third of all rows have is one row of
  one block, and is looked into once.
* A giant text is cut to trigrams piece by piece.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.session import materialize, scratch_path

# Contents in a block, about, and trigrams of a needle that are intersected at most. Results
# don't depend on either.
BLOCK_ROWS, RAREST = 4, 8
# Blocks that may be named in the filter of a scan.
NAMED_BLOCKS = 2000
_PIECE = 1 << 16
_CLOSE = "\0\0"


def trigrams(text: Column) -> Column:
    """Every three characters that stand in a row, overlapping; linear in the text."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1))


def _pieces(text: Column) -> Column:
    """A text in pieces that overlap by two characters, so that no trigram is cut."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{_PIECE + 2}}})).{{1,{_PIECE}}}"), F.lit(1))


@dataclass(frozen=True)
class TrigramIndex:
    """Tables of an index: what ``build`` writes and ``open`` finds again."""

    #: key, content: a row for each row that was indexed and has a text.
    members: DataFrame
    #: block, content, text: the distinct texts, by block.
    contents: DataFrame
    #: gram, block: the blocks in which a trigram occurs.
    grams: DataFrame
    #: gram, blocks: in how many.
    dictionary: DataFrame

    @staticmethod
    def open(spark: SparkSession, folder: str) -> TrigramIndex:
        return TrigramIndex(
            *(spark.read.parquet(f"{folder}/{name}") for name in ("members", "contents", "grams", "dictionary"))
        )

    @staticmethod
    def build(
        df: DataFrame, key: str, text: str, folder: str | None = None, block_rows: int = BLOCK_ROWS
    ) -> TrigramIndex:
        """Index the column ``text`` of ``df``; rows are named by ``key``. Null texts are left out.

        For a search that ignores case, give lower-cased texts here and needles there.
        """
        spark = df.sparkSession
        folder = folder or scratch_path(spark, "trigrams")
        rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        rows = rows.withColumn("content", F.sha2("text", 256))
        rows.select("key", "content").write.parquet(f"{folder}/members")
        known = spark.read.parquet(f"{folder}/members").select("content").distinct().count()
        block = F.pmod(F.xxhash64("content"), F.lit(max(1, -(-known // block_rows))))
        contents = rows.groupBy("content").agg(F.any_value("text").alias("text"))
        contents = contents.select(block.alias("block"), "content", "text")
        contents.repartition("block").sortWithinPartitions("block").write.parquet(f"{folder}/contents")
        # A block lies in one file, so nearly all repeats of its trigrams go before the shuffle.
        pieces = spark.read.parquet(f"{folder}/contents").select(
            "block", F.explode(_pieces(F.concat("text", F.lit(_CLOSE)))).alias("piece")
        )
        grams = pieces.select(F.explode(F.array_distinct(trigrams(F.col("piece")))).alias("gram"), "block").distinct()
        grams.sortWithinPartitions("gram", "block").write.parquet(f"{folder}/grams")
        counted = spark.read.parquet(f"{folder}/grams").groupBy("gram").agg(F.count("*").alias("blocks"))
        counted.write.parquet(f"{folder}/dictionary")
        return TrigramIndex.open(spark, folder)


def _asked(needles: DataFrame, needle: str) -> DataFrame:
    asked = needles.select(F.col(needle).cast("string").alias("needle")).where("needle IS NOT NULL").distinct()
    return asked.withColumn("size", F.char_length("needle"))


def candidates(index: TrigramIndex, needles: DataFrame, needle: str = "needle") -> DataFrame:
    """(needle, block): where each needle of one character or more may be, and nowhere else."""
    asked = materialize(_asked(needles, needle), "needles")
    terms = asked.where("size >= 3").select("needle", F.explode(F.array_distinct(trigrams(F.col("needle")))).alias("gram"))
    terms = terms.join(index.dictionary, "gram", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    rarest = W.partitionBy("needle").orderBy("blocks", "gram")
    terms = terms.withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= RAREST)
    # A needle with a trigram that no text has drops out here: its rarest has no blocks.
    terms = materialize(terms, "needle-grams")
    first = materialize(terms.where("rank = 1").join(index.grams, "gram").select("needle", "block"), "rarest-blocks")
    others = first.join(terms.where("rank > 1").select("needle", "gram"), "needle")
    has = others.join(index.grams, ["gram", "block"], "left_semi").groupBy("needle", "block").agg(F.count("*").alias("has"))
    wanted = terms.groupBy("needle").agg((F.count("*") - 1).alias("wanted"))
    long = first.join(has, ["needle", "block"], "left").join(wanted, "needle")
    long = long.where(F.coalesce("has", F.lit(0)) == F.col("wanted")).select("needle", "block")

    heads = index.dictionary.select(
        "gram", F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2))).alias("needle")
    )
    short = asked.where("size BETWEEN 1 AND 2").select("needle").join(heads, "needle").join(index.grams, "gram")
    return long.unionByName(short.select("needle", "block").distinct())


def find(index: TrigramIndex, needles: DataFrame, needle: str = "needle") -> DataFrame:
    """(needle, key) of every row whose text contains the needle; a row for each row indexed.

    Equal needles are asked once, null ones find nothing and the empty one finds every row
    with a text. Without needles or texts nothing is found.
    """
    where = materialize(candidates(index, needles, needle), "candidates")
    contents = index.contents
    named = [r[0] for r in where.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
    if len(named) <= NAMED_BLOCKS:  # contents are sorted by block, so other row groups aren't read
        contents = contents.where(F.col("block").isin(named))
    hits = where.join(contents, "block").where(F.contains("text", "needle")).select("needle", "content")
    found = hits.join(index.members, "content").select("needle", "key")
    every = index.members.select(F.lit("").alias("needle"), "key")
    return found.unionByName(every.join(_asked(needles, needle), "needle", "left_semi"))
