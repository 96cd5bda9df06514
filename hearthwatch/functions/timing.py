"""Explicit clock: every look-back takes an `as_of` instant."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "event_date"  # partition column of stored tables


def instant(as_of: Column | datetime | str) -> Column:
    """Literal for a point in time.

    A zone-aware datetime becomes TIMESTAMP, a naive one TIMESTAMP_NTZ; matching the column's own type keeps
    the comparison free of casts on the column, so it reaches the Parquet scan as a pushed filter.
    """
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        return F.lit(as_of).cast("timestamp")
    if as_of.tzinfo is None:
        return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(as_of)


def back(as_of, length: str) -> Column:
    return instant(as_of) - F.expr(f"INTERVAL '{length}'")


def within(column: Column, as_of, length: str) -> Column:
    """Strictly after the look-back start and not after `as_of` (so that a replay cannot see the future)."""
    return (column > back(as_of, length)) & (column <= instant(as_of))


def between(column: Column, start, end) -> Column:
    return column.between(instant(start), instant(end))


def _in_days(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Of a table stored by day, the days that a range touches; the bounds are constants, so they reach the partitions."""
    if DAY not in rows.columns:
        return rows
    return rows.filter(F.col(DAY).between(F.to_date(start), F.to_date(end)))


def recent_rows(rows: DataFrame, as_of, length: str) -> DataFrame:
    """Rows of the look-back, from the days that it touches only if the table is stored by day."""
    return _in_days(rows, back(as_of, length), instant(as_of)).filter(within(F.col("timestamp"), as_of, length))


def rows_between(rows: DataFrame, start, end) -> DataFrame:
    """Rows of a time range, likewise."""
    return _in_days(rows, instant(start), instant(end)).filter(between(F.col("timestamp"), start, end))


def bucket(column: Column, width: str) -> Column:
    """Start of the epoch-aligned bucket."""
    return F.window(column, width)["start"]
