"""Lookup inputs: MAC vendors, IP country ranges, detection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import ip_to_long


def read_vendor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Registry CSV with a header; rows the parser cannot read are dropped."""
    rows = (
        spark.read.option("header", "true").option("mode", "DROPMALFORMED").option("multiLine", "false")
        .option("escape", '"').csv(path)
    )
    return rows.select(F.col("Assignment").alias("assignment"), F.col("Organization Name").alias("organization"))


def vendor_table(rows: DataFrame) -> DataFrame:
    """(assignment, organization) rows to one vendor per six-digit prefix; the smallest name wins a tie."""
    return (
        rows.filter((F.length("assignment") == 6) & (F.col("organization") != ""))
        .groupBy(F.upper("assignment").alias("oui_prefix"))
        .agg(F.min("organization").alias("manufacturer"))
    )


def read_range_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless `start,end,country` CSV, plain or gzip."""
    return spark.read.schema("ip_start STRING, ip_end STRING, country STRING").csv(path)


def range_table(rows: DataFrame) -> DataFrame:
    """Text ranges to numeric ones; IPv6, short and unreadable rows are skipped."""
    return (
        rows.filter(~F.col("ip_start").contains(":") & F.col("country").isNotNull())
        .select(
            ip_to_long(F.col("ip_start")).alias("ip_start"),
            ip_to_long(F.col("ip_end")).alias("ip_end"),
            F.substring(F.upper("country"), 1, 2).alias("country"),
        )
        .filter("ip_start IS NOT NULL AND ip_end IS NOT NULL")
    )


def read_rule_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rule file lines with their file's modification time and a stable order inside the file.

    `position` orders duplicate rule ids: it is the offset Spark assigns while reading, so later lines of a
    file get larger values.
    """
    return spark.read.text(path).select(
        "value",
        F.monotonically_increasing_id().alias("position"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )
