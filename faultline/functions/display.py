"""Small presentation rules of the read models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def status_class(value: Column) -> Column:
    """Badge class of a status; note that 'unavailable' contains 'available'."""
    text = F.lower(F.coalesce(value, F.lit("unknown")))
    good = text.contains("complete") | text.contains("ok") | text.contains("available")
    return F.when(text.contains("fail"), "error").when(good, "success").otherwise("muted")


def percent(value: Column) -> Column:
    """Whole percent, halves rounded up; a dash when there is no number."""
    whole = F.floor(value.cast("double") * 100 + 0.5).cast("string")
    return F.coalesce(F.concat(whole, F.lit("%")), F.lit(DASH))


def milliseconds(value: Column) -> Column:
    return F.coalesce(F.concat(value.cast("string"), F.lit(" ms")), F.lit(DASH))


def bullets(items: Column, none: str = "- None provided") -> Column:
    lines = F.array_join(F.transform(items, lambda item: F.concat(F.lit("- "), item)), "\n")
    return F.when(F.size(items) > 0, lines).otherwise(F.lit(none))


def two_decimals(value: Column) -> Column:
    """Fixed notation rounded from the exact binary value, exact halves up.

    The formatter rounds exact halves to even; they are the odd multiples of 1/8.
    """
    eighths = value * 8
    is_half = (eighths == F.floor(eighths)) & (eighths % 2 == 1)
    return F.format_number(F.when(is_half, value + 0.001).otherwise(value), 2)
