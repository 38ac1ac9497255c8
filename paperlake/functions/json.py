"""JSON texts of small values, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keywords_to_json(keywords: Column) -> Column:
    """An array of words as JSON; an empty array for null."""
    return F.to_json(F.coalesce(keywords, F.array().cast("array<string>")))


def keywords_from_json(json: Column) -> Column:
    """The words of a JSON array; an empty array for null and broken texts."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def dimensions(values: dict[str, Column]) -> Column:
    """A metric's dimensions as a JSON object of texts; null values are left out."""
    pairs = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]), lambda p: p["value"].isNotNull()))
    return F.to_json(pairs)


def log_line(ts: Column, level: Column, message: Column, extras: dict[str, Column] | None = None) -> Column:
    """A log entry as one JSON object; extras that are null do not appear."""
    return F.to_json(F.struct(ts.cast("string").alias("ts"), level.alias("level"), message.alias("message"), *[v.alias(k) for k, v in (extras or {}).items()]))
