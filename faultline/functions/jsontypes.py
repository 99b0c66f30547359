"""Strict type tests on VARIANT values.

``from_json`` and ``try_variant_get(.., 'string')`` turn 5 into '5'; a contract
check has to see the JSON type itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a UTC date-time as the contract takes it (the date is checked apart).
DATETIME = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?Z$"


def field(value: Column, name: str) -> Column:
    """A member as VARIANT: SQL null when missing, a VARIANT null when JSON null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def scalar_type(value: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, DOUBLE, DECIMAL or VOID (a JSON null) of a scalar.

    Not for arrays and objects: their type is that of every member merged.
    """
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_missing(value: Column) -> Column:
    return value.isNull()


def is_string(value: Column, minimum: int = 0) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return (F.length(text) >= minimum) & (F.schema_of_variant(value) == "STRING")


def is_number(value: Column) -> Column:
    # A string of digits also reads as a double, so the type has to be seen.
    number = F.try_variant_get(value, "$", "double")
    return number.isNotNull() & scalar_type(value).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def is_scalar(value: Column) -> Column:
    """A string, number or boolean."""
    text = F.try_variant_get(value, "$", "string")
    return text.isNotNull() & scalar_type(value).isin(
        "STRING", "BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "BOOLEAN"
    )


def is_one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    # No allowed word is the text of another JSON type.
    return F.try_variant_get(value, "$", "string").isin(*allowed)


def is_datetime(value: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return text.rlike(DATETIME) & F.substring(text, 1, 10).try_cast("date").isNotNull()


def elements(value: Column, path: str = "$") -> Column:
    """Members of a JSON array as array<variant>; null when it is no array."""
    return F.try_variant_get(value, path, "array<variant>")


def is_array_of(value: Column, test, minimum: int = 0) -> Column:
    items = elements(value)
    return items.isNotNull() & (F.size(items) >= minimum) & F.forall(items, test)


def is_map_of(value: Column, test) -> Column:
    members = F.try_variant_get(value, "$", "map<string,variant>")
    return members.isNotNull() & F.forall(F.map_values(members), test)
