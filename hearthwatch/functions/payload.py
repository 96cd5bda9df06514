"""Tolerant conversions for values read out of JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(raw: Column, *path: str) -> Column:
    """Text at a JSON path; every step is quoted, so keys may contain dots. JSON null gives NULL."""
    steps = "".join(f"['{step}']" for step in path)
    return F.get_json_object(raw, f"${steps}")


def to_long(text: Column) -> Column:
    """Text to BIGINT: integers exactly, decimals rounded half to even, anything else NULL."""
    return F.coalesce(text.try_cast("bigint"), F.bround(text.try_cast("double")).try_cast("bigint"))


def to_int(text: Column) -> Column:
    return to_long(text).try_cast("int")


def to_double(text: Column) -> Column:
    return text.try_cast("double")


def or_zero(number: Column) -> Column:
    return F.coalesce(number, F.lit(0).cast("bigint"))


def event_time(text: Column, fallback: Column) -> Column:
    """Event time from its text form, else the ingest time."""
    return F.coalesce(text.try_cast("timestamp"), fallback)


def epoch_seconds(text: Column) -> Column:
    """Epoch seconds with a fraction to a timestamp truncated to whole seconds."""
    return F.timestamp_seconds(F.floor(to_double(text)).try_cast("bigint"))
