"""Parquet tables: export/import and the silver layout."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Dynamic overwrite (the session's default) leaves the partitions that new data does not have; "replace all" must not.
REPLACE_ALL = {"partitionOverwriteMode": "static"}


def bloom_filters(*columns: str, distinct: int = 1_000_000) -> dict[str, str]:
    """Write options that give each row group a Bloom filter on the columns, so that a look-up of a few values passes over
    row groups that hold none of them. `distinct` values of a row group are expected at most."""
    return {f"parquet.bloom.filter.{k}#{c}": v for c in columns for k, v in (("enabled", "true"), ("expected.ndv", str(distinct)))} | {
        f"parquet.bloom.filter.adaptive.enabled#{c}": "true" for c in columns}


FLOW_ID = bloom_filters("community_id")  # look-ups of the flows of an alert


def export_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace whatever the path holds."""
    writer = df.write.mode("overwrite").options(**REPLACE_ALL)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def import_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_by_day(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Date-partitioned table; mode `overwrite` replaces all days, `replace_days` those of `df`, `append` none. Sorted by time inside files so row-group statistics prune look-backs.

    Days are rebalanced, not just repartitioned: adaptive execution splits a day too big for one writer.
    """
    dated = df.withColumn("event_date", F.to_date("timestamp")).hint("rebalance", "event_date")
    writer = dated.sortWithinPartitions("event_date", "timestamp").write.partitionBy("event_date")
    if "community_id" in df.columns:
        writer = writer.options(**FLOW_ID)
    if mode == "replace_days":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode(mode).options(**REPLACE_ALL).parquet(path)


def days_between(start: datetime | date, end: datetime | date) -> Column:
    """Filter on the partition column: only the days that a time range touches are listed and opened."""
    return F.col("event_date").between(F.lit(_day(start)), F.lit(_day(end)))


def _day(at: datetime | date) -> date:
    if isinstance(at, datetime):
        return (at.astimezone(timezone.utc) if at.tzinfo else at).date()
    return at
