"""Threshold detection over all services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.keyed import insert_absent_incidents
from faultline.schemas import ERROR_LEVELS, LATENCY_METRIC, LATENCY_THRESHOLD
from faultline.session import lookup_join


def service_signals(
    services: DataFrame,
    metrics: DataFrame,
    logs: DataFrame,
    metric: str = LATENCY_METRIC,
    levels: tuple[str, ...] = ERROR_LEVELS,
) -> DataFrame:
    """Peak of the metric and number of error logs; a service with neither stays.

    Each fact table is reduced per service before the join, so the join meets at most
    one row per service and side. ``fanout_errors`` is the count a join of both fact tables
    would give: errors x metric rows (errors when there are none).
    """
    peaks = (
        metrics.filter(F.col("metric_name") == metric)
        .groupBy(F.col("service_id").alias("id"))
        .agg(F.max("metric_value").alias("max_latency"), F.count("*").alias("n_metrics"))
    )
    errors = (
        logs.filter(F.col("level").isin(*levels))
        .groupBy(F.col("service_id").alias("id"))
        .agg(F.count("*").alias("errors"))
    )
    count = F.coalesce(F.col("errors"), F.lit(0))
    rows = F.coalesce(F.col("n_metrics"), F.lit(0))
    return (
        services.select("id", "name")
        .join(peaks, "id", "left")
        .join(errors, "id", "left")
        .select(
            F.col("id").alias("service_id"),
            F.col("name").alias("service_name"),
            "max_latency",
            count.alias("errors"),
            rows.alias("n_metrics"),
            (count * F.greatest(rows, F.lit(1))).alias("fanout_errors"),
        )
    )


def _exceeded(threshold: float) -> Column:
    return (F.coalesce("max_latency", F.lit(0.0)) >= threshold) & (F.col("errors") > 0)


def detect_incidents(signals: DataFrame, threshold: float = LATENCY_THRESHOLD) -> DataFrame:
    """Services whose peak reaches the threshold and that logged errors."""
    return signals.filter(_exceeded(threshold))


def detection_outcomes(signals: DataFrame, threshold: float = LATENCY_THRESHOLD) -> DataFrame:
    """Every service with the verdict and its reason."""
    found = _exceeded(threshold)
    reached = F.concat("service_name", F.lit(f" reached {threshold:g} with errors logged"))
    reason = F.when(found, reached).otherwise("No incident threshold exceeded.")
    return signals.select("service_id", "service_name", found.alias("detected"), reason.alias("reason"))


def with_times(
    detections: DataFrame,
    metrics: DataFrame,
    logs: DataFrame,
    *,
    metric: str = LATENCY_METRIC,
    threshold: float = LATENCY_THRESHOLD,
    levels: tuple[str, ...] = ERROR_LEVELS,
) -> DataFrame:
    """Detections with ``started_at`` and ``detected_at``, as their telemetry has them.

    An incident starts with the first breach or the first error, whichever is earlier, and
    can be detected when both have been seen. Facts are folded per service before the join.
    """
    breach = (F.col("metric_name") == metric) & (F.col("metric_value") >= threshold)
    breaches = metrics.filter(breach).groupBy("service_id").agg(F.min("timestamp").alias("_breach"))
    errors = logs.filter(F.col("level").isin(*levels)).groupBy("service_id").agg(F.min("timestamp").alias("_error"))
    return (
        detections.join(breaches, "service_id", "left")
        .join(errors, "service_id", "left")
        .withColumns({"started_at": F.least("_breach", "_error"), "detected_at": F.greatest("_breach", "_error")})
        .drop("_breach", "_error")
    )


def detections_to_incidents(
    detections: DataFrame,
    incidents: DataFrame,
    detected_at: Column | None = None,
    *,
    metric: str = LATENCY_METRIC,
    threshold: float = LATENCY_THRESHOLD,
    scenario: str = "threshold",
) -> DataFrame:
    """The incident table with one sev2 incident added per newly detected service.

    Times are those of ``with_times``; ``detected_at`` puts one time in their place.
    """
    name = F.col("service_name")
    started_at = F.col("started_at") if detected_at is None else detected_at
    detected_at = F.col("detected_at") if detected_at is None else detected_at
    scenario_rows = detections.select(
        F.concat_ws("-", F.lit(scenario), name).alias("scenario_id"),
        "service_id",
        F.concat(name, F.lit(f" {metric} spike")).alias("title"),
        F.lit("sev2").alias("severity"),
        detected_at.alias("detected_at"),
        started_at.alias("started_at"),
        F.concat(name, F.lit(f" {metric} reached {threshold:g} with errors logged")).alias("detection_reason"),
        F.lit(None).cast("string").alias("suspected_root_cause"),
        F.array(F.lit(metric), F.lit("error_logs")).alias("affected_signals"),
        F.lit(0).cast("long").alias("batch_seq"),
    )
    return insert_absent_incidents(incidents, scenario_rows)


def detect_with_rules(
    services: DataFrame, metrics: DataFrame, logs: DataFrame, rules: DataFrame
) -> DataFrame:
    """Detection for many rules in one pass of each table.

    A rule is (rule_id, metric_name, threshold, levels): the services whose peak reaches the
    threshold and that logged at one of the levels; without ``levels`` those of errors
    count. Both fact tables are folded before they meet a rule. The rule table is a
    hand-written, stored configuration: it is measured, and broadcast while it is small.
    """
    if "levels" not in rules.columns:
        rules = rules.withColumn("levels", F.array(*[F.lit(level) for level in ERROR_LEVELS]))
    peaks = (
        lookup_join(
            metrics.select("id", "service_id", "metric_name", "metric_value"),
            rules.select("metric_name").distinct(),
            ["metric_name"],
            "left_semi",
            spread=["id"],
        )
        .groupBy("service_id", "metric_name")
        .agg(F.max("metric_value").alias("peak"))
    )
    # At most a row per service and level.
    errors = logs.groupBy("service_id", "level").agg(F.count("*").alias("errors"))
    names = services.select(F.col("id").alias("service_id"), F.col("name").alias("service_name"))
    breached = lookup_join(peaks, rules, ["metric_name"], spread=["service_id"]).filter(
        F.col("peak") >= F.col("threshold")
    )
    keys = ["rule_id", "service_id", "metric_name", "threshold", "peak"]
    return (
        breached.join(errors, "service_id")
        .filter(F.array_contains("levels", F.col("level")))
        .groupBy(*keys)
        .agg(F.sum("errors").alias("errors"))
        .join(names, "service_id")
        .select("rule_id", "service_id", "service_name", "metric_name", "threshold", "peak", "errors")
    )
