"""Telemetry and log batches: reading, the contract check, splitting into row sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions import jsontypes as J
from faultline.session import lookup_join, materialize

SECTIONS = ("services", "deployments", "logs", "metrics", "incidents")


def _checked(spark: SparkSession, path: str, schema: str, one_per_file: bool) -> DataFrame:
    """Batches of a declared shape, with ``_broken``: the text of what is no such batch."""
    reader = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken")
    return reader.json(path, multiLine=one_per_file)


def read_telemetry(spark: SparkSession, path: str, *, one_per_file: bool = False) -> DataFrame:
    """Telemetry batches with their declared shape; one per line, or one per file.

    What is no JSON of this shape is left to ``rejected_telemetry``.
    """
    return _checked(spark, path, schemas.TELEMETRY_BATCH, one_per_file).where("_broken IS NULL").drop("_broken")


def rejected_telemetry(spark: SparkSession, path: str, *, one_per_file: bool = False) -> DataFrame:
    """(value, reason) of what ``read_telemetry`` leaves out."""
    batches = _checked(spark, path, schemas.TELEMETRY_BATCH, one_per_file).where("_broken IS NOT NULL")
    return batches.select(F.col("_broken").alias("value"), F.lit("json").alias("reason"))


def read_logs(spark: SparkSession, path: str, *, one_per_file: bool = False) -> DataFrame:
    """Log batches; one without a log is not a batch (see ``rejected_logs``)."""
    batches = _checked(spark, path, schemas.LOGS_BATCH, one_per_file)
    return batches.where(F.col("_broken").isNull() & (F.size("logs") >= 1)).drop("_broken")


def rejected_logs(spark: SparkSession, path: str, *, one_per_file: bool = False) -> DataFrame:
    """(value, reason) of what ``read_logs`` leaves out: broken JSON, or no log in it."""
    batches = _checked(spark, path, schemas.LOGS_BATCH, one_per_file)
    none = F.coalesce(F.size("logs") < 1, F.lit(True))
    reason = F.when(F.col("_broken").isNotNull(), F.lit("json")).when(none, F.lit("logs"))
    value = F.coalesce("_broken", F.to_json(F.struct(*[c for c in batches.columns if c != "_broken"])))
    return batches.select(value.alias("value"), reason.alias("reason")).where("reason IS NOT NULL")


def read_raw(spark: SparkSession, path: str, *, one_per_file: bool = False) -> DataFrame:
    """Batches as text for the contract check: (batch_id, value)."""
    lines = spark.read.text(path, wholetext=one_per_file)
    return identify(lines.select(F.col("_metadata.file_path").alias("file_path"), "value"))


def identify(lines: DataFrame) -> DataFrame:
    """Name each line of (file_path, value) by its file and content: (batch_id, value).

    Reading a line again names it the same. Equal lines of a file are batches of their own:
    the second and later ones are named by their number too. Only digests are counted and
    moved; lines are moved where they repeat.
    """
    named = lines.select(F.sha2(F.concat_ws("/", "file_path", "value"), 256).alias("name"), "value")
    repeats = materialize(named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    if repeats.isEmpty():
        return named.withColumnRenamed("name", "batch_id")
    once = lookup_join(named, repeats.select("name"), ["name"], "left_anti", spread=["value"])
    more = lookup_join(named, repeats, ["name"], spread=["value"]).dropDuplicates(["name"])
    more = more.select("name", "value", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("place"))
    own = F.when(F.col("place") == 1, F.col("name")).otherwise(F.sha2(F.concat_ws("/", "name", "place"), 256))
    return once.withColumnRenamed("name", "batch_id").unionByName(more.select(own.alias("batch_id"), "value"))


def parse(raw: DataFrame) -> DataFrame:
    """Typed batches of (batch_id, value) rows that passed the check."""
    batch = F.from_json("value", schemas.TELEMETRY_BATCH)
    return raw.select("batch_id", batch.alias("_b")).select("batch_id", "_b.*")


def section(batches: DataFrame, name: str) -> DataFrame:
    """The rows of one array, a missing array giving none.

    With a batch id the rows also carry ``batch_seq``, their place in arrival order.
    """
    columns = [c for c in ("batch_id", "generatedAt") if c in batches.columns]
    rows = batches.select(*columns, F.posexplode(F.coalesce(F.col(name), F.array())).alias("ordinal", "_item"))
    if "batch_id" not in columns:
        return rows.select(*columns, "_item.*")
    seq = F.struct(*columns[::-1], "ordinal").alias("batch_seq")
    return rows.select("batch_id", "ordinal", seq, "_item.*")


def split(batches: DataFrame) -> dict[str, DataFrame]:
    return {name: section(batches, name) for name in SECTIONS}


Test = Callable[[Column], Column]


def _text(minimum: int = 1) -> Test:
    return lambda v: J.is_string(v, minimum)


def _optional(test: Test) -> Test:
    return lambda v: J.is_missing(v) | test(v)


def _one_of(allowed: tuple[str, ...]) -> Test:
    return lambda v: J.is_one_of(v, allowed)


def _attributes(v: Column) -> Column:
    return J.is_map_of(v, J.is_scalar)


def _string_map(v: Column) -> Column:
    return J.is_map_of(v, lambda m: J.is_string(m))


def _strings(v: Column) -> Column:
    return J.is_array_of(v, lambda m: J.is_string(m))


# The contract: section -> field -> test of the field's JSON value.
# Fields, types and limits of the posted batches.
CONTRACT: dict[str, dict[str, Test]] = {
    "services": {
        "name": _text(),
        "displayName": _text(),
        "description": _text(),
        "ownerTeam": _text(),
        "runtime": _text(),
        "criticality": _one_of(schemas.CRITICALITIES),
    },
    "deployments": {
        "serviceName": _text(),
        "version": _text(),
        "commitSha": _text(),
        "deployedBy": _text(),
        "environment": _one_of(("production",)),
        "status": _one_of(schemas.DEPLOYMENT_STATUSES),
        "deployedAt": J.is_datetime,
        "metadata": _optional(_string_map),
    },
    "logs": {
        "serviceName": _text(),
        "deploymentVersion": _optional(_text()),
        "timestamp": J.is_datetime,
        "level": _one_of(schemas.LOG_LEVELS),
        "message": _text(),
        "traceId": _optional(_text(0)),
        "spanId": _optional(_text(0)),
        "attributes": _optional(_attributes),
    },
    "metrics": {
        "serviceName": _text(),
        "timestamp": J.is_datetime,
        "metricName": _text(),
        "metricValue": J.is_number,
        "unit": _text(),
        "attributes": _optional(_attributes),
    },
    "incidents": {
        "id": _text(),
        "title": _text(),
        "serviceName": _text(),
        "severity": _one_of(schemas.SEVERITIES),
        "startedAt": J.is_datetime,
        "detectedAt": J.is_datetime,
        "detectionReason": _text(),
        "suspectedRootCause": _text(),
        "affectedSignals": _optional(_strings),
    },
}


def failed_rules(tests: dict[str, Column]) -> Column:
    """Names of the tests that are not true."""
    reasons = [F.when(~F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]
    return F.array_compact(F.array(*reasons))


def contract_violations(
    raw: DataFrame,
    sections: tuple[str, ...] = SECTIONS,
    required: tuple[str, ...] = ("generatedAt", "services"),
) -> DataFrame:
    """(batch_id, section, ordinal, field), one row per broken rule of a batch's text.

    The JSON type of each value is looked at, as a typed read would turn 5 into '5'.
    """
    doc = F.col("_doc")
    parsed = raw.select("batch_id", F.try_parse_json("value").alias("_doc"))
    opened = parsed.select(
        "batch_id",
        doc.isNotNull().alias("_is_json"),
        J.field(doc, "generatedAt").alias("_generated"),
        *[J.elements(doc, f"$.{name}").alias(name) for name in sections],
        *[J.field(doc, name).isNull().alias(f"_no_{name}") for name in sections],
    )
    tests = {"json": F.col("_is_json")}
    if "generatedAt" in required:
        tests["generatedAt"] = ~F.col("_is_json") | J.is_datetime(F.col("_generated"))
    for name in sections:
        if name in required:
            good = F.col(name).isNotNull() & (F.size(name) >= 1)
        else:
            good = F.col(name).isNotNull() | F.col(f"_no_{name}")
        tests[name] = ~F.col("_is_json") | good

    def broken(name: str, ordinal: Column, fields: Column) -> Column:
        return F.struct(
            F.lit(name).alias("section"), ordinal.cast("long").alias("ordinal"), fields.alias("fields")
        )

    def broken_rows(name: str) -> Column:
        rules = CONTRACT[name]

        def check(item: Column, at: Column) -> Column:
            return broken(name, at, failed_rules({f: t(J.field(item, f)) for f, t in rules.items()}))

        return F.transform(F.coalesce(F.col(name), F.array()), check)

    # One parse of a batch serves all its sections.
    rows = F.concat(
        F.array(broken("batch", F.lit(None), failed_rules(tests))),
        *[broken_rows(name) for name in sections],
    )
    found = opened.select("batch_id", F.filter(rows, lambda r: F.size(r["fields"]) > 0).alias("_rows"))
    # The outer form: the plain one would repeat the whole check in a filter before it.
    return (
        found.select("batch_id", F.inline_outer("_rows"))
        .select("batch_id", "section", "ordinal", F.explode_outer("fields").alias("field"))
        .filter(F.col("field").isNotNull())
    )


def logs_violations(raw: DataFrame) -> DataFrame:
    """The contract of a batch that holds logs only."""
    return contract_violations(raw, ("logs",), ("logs",))


def accept(raw: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted batches, rejected ones): one bad row rejects its whole batch."""
    bad = materialize(violations.select("batch_id").distinct(), "rejected_batches")
    return raw.join(bad, "batch_id", "left_anti"), raw.join(bad, "batch_id", "left_semi")
