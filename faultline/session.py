"""Session settings, the shared scratch folder, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup side is broadcast only when it has at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Tasks over which the rows of one hot key are spread, and copies of that key's look-up.
SALTS = 32
# Rows that make a key hot, and hot keys that are treated on their own at most.
HOT_ROWS, HOT_KEYS = 1_000_000, 4096
# Has an execution remove its shuffle files when it ends; else they stay until the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_fallback_dirs: dict[str, str] = {}


def build_session(app: str = "faultline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.checkpoint.compress": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # The last of two equal keys counts, as in the JSON parser of the contract.
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or _fallback_dirs.get(sc.applicationId)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = _fallback_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="faultline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/faultline/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, *, lean: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting the lineage.

    ``lean``: smaller files for more work, and what was shuffled for them goes when they are written.
    """
    path = scratch_path(df.sparkSession, label)
    if lean:
        with _freed_shuffles(df.sparkSession):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


@contextmanager
def passing(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` as ``materialize`` gives it, for a block after which nothing reads it: its files go at the end."""
    spark, written = df.sparkSession, materialize(df, label, lean=True)
    try:
        yield written
    finally:
        for path in {file.rsplit("/", 1)[0] for file in written.inputFiles()}:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has materialized."""
    _remove(spark, f"{shared_dir(spark)}/faultline/{spark.sparkContext.applicationId}")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps partitions and row order, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give every core work before a costly map: few input splits are shuffled apart.

    A large table arrives in more splits than there are cores and is left alone. For
    tables read from storage; asking a shuffled one for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def _width(field: T.StructField) -> Column:
    """About how many bytes a value takes."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        size = F.size(value) * 8
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        size = F.octet_length(F.to_json(F.struct(value)))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(0))


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a table; folded where it lies, no rows are moved."""
    total = sum((_width(f) for f in df.schema.fields), F.lit(0))
    rows, size = df.agg(F.count("*"), F.sum(total)).first()
    return rows, size or 0


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    count, size = measure(df)
    return count <= (BROADCAST_ROWS if rows is None else rows) and size <= BROADCAST_BYTES


def salt(spread: list[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")


def sorted_join(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the input, shuffled and sorted whatever their files' size.

    Spark takes a table's size from that of its files and a text for 20 bytes, so tables whose
    texts repeat (evidence, prompts, steps) look small enough to go through the driver.
    """
    return left.join(right.hint("merge"), keys, how)


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "inner",
    *,
    spread: list[str],
    rows: int | None = None,
    large: bool = False,
) -> DataFrame:
    """Join many facts to a lookup of their keys, where one key may have most of the facts.

    A lookup of proven size is broadcast. For a larger one the facts are counted per key:
    facts of the few keys with ``HOT_ROWS`` or more are spread over ``SALTS`` tasks, by
    ``spread`` (columns that identify a fact), and only these keys of the lookup are copied
    as often; all others are joined by sorting. ``how``: inner, left, left_semi or left_anti.
    A lookup that is known to be ``large`` isn't read to be measured.
    """
    if not large and fits_broadcast(lookup, rows):
        return facts.join(F.broadcast(lookup), keys, how)
    counts = facts.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= HOT_ROWS)
    hot = counts.orderBy(F.desc("_rows"), *keys).limit(HOT_KEYS).select(*keys).dropna()
    with _freed_shuffles(facts.sparkSession):
        hot = materialize(hot.withColumn("_hot", F.lit(True)), "hot-keys")
    if hot.isEmpty():
        return sorted_join(facts, lookup, keys, how)
    facts = facts.join(F.broadcast(hot), keys, "left")  # at most HOT_KEYS rows
    salted = facts.where("_hot").drop("_hot").withColumn("_salt", salt(spread, SALTS))
    copies = lookup.join(F.broadcast(hot.drop("_hot")), keys, "left_semi")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cold = facts.where("_hot IS NULL").drop("_hot")
    cold = sorted_join(cold, lookup, keys, how)
    return cold.unionByName(sorted_join(salted, copies, [*keys, "_salt"], how).drop("_salt"))
