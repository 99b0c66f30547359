"""Every registered query with its comparison SQL (None where SQL cannot express it)."""

from __future__ import annotations


def registry() -> dict:
    from faultline.catalog import analytics, reports, telemetry

    return {**telemetry.QUERIES, **analytics.QUERIES, **reports.QUERIES}
