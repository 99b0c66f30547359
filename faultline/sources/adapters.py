"""The given star-schema tables read as the telemetry model.

Every mapping is a projection over a whole table; the services are the customers, the
facts are the events, the runbooks are the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The window parameters that suit the spacing of the given events.
LOOKBACK = "1 day"
LOOKAHEAD = "6 hours"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("Service "), F.col("c_custkey").cast("string")).alias("display_name"),
        F.concat(segment, F.lit(" account service")).alias("description"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("owner_team"),
        F.lower(segment).alias("runtime"),
        F.when(segment == "BUILDING", "critical")
        .when(segment == "AUTOMOBILE", "high")
        .when(segment == "MACHINERY", "medium")
        .otherwise("low")
        .alias("criticality"),
    )


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("service_id"),
        F.col("ts").alias("timestamp"),
        F.when(kind == "error", "error")
        .when(kind == "purchase", "warn")
        .when(kind == "view", "debug")
        .otherwise("info")
        .alias("level"),
        kind.alias("message"),
        F.col("props").alias("attributes"),
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("service_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("metric_name"),
        F.col("value").alias("metric_value"),
        F.lit("u").alias("unit"),
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    last_digit = F.col("event_id") % 10
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "signup")
        .select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("service_id"),
            F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("version"),
            F.sha1(F.col("event_id").cast("string")).alias("commit_sha"),
            F.lit("deploy-bot").alias("deployed_by"),
            F.lit("production").alias("environment"),
            F.when(last_digit == 0, "failed")
            .when(last_digit == 1, "rolled_back")
            .otherwise("succeeded")
            .alias("status"),
            F.col("ts").alias("deployed_at"),
            F.col("props").alias("metadata"),
        )
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return (
        table(spark, sf_dir, "events")
        .filter((F.col("event_type") == "error") & (value >= 100))
        .select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("service_id"),
            F.concat(F.lit("error value spike in "), F.col("event_type")).alias("title"),
            F.when(value >= 200, "sev1")
            .when(value >= 150, "sev2")
            .when(value >= 120, "sev3")
            .otherwise("sev4")
            .alias("severity"),
            F.lit("detected").alias("status"),
            F.col("ts").alias("detected_at"),
            F.col("ts").alias("started_at"),
            F.lit("the value rose over the threshold of 100").alias("detection_reason"),
            F.lit(None).cast("string").alias("suspected_root_cause"),
            F.col("props").alias("metadata"),
        )
    )


def runbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.lit(None).cast("long").alias("service_id"),
        F.col("source").alias("title"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"),
        F.col("text").alias("body"),
        F.lit(1).alias("version"),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content")
    )
