"""Small text helpers shared by inventories and panels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mac_prefix(mac: Column) -> Column:
    """First three bytes of a MAC as six upper-case hex digits."""
    return F.upper(F.replace(F.substring(mac, 1, 8), F.lit(":"), F.lit("")))


def sorted_list(values: Column) -> Column:
    """Array of strings to one ordered, comma-separated text; an empty array gives NULL."""
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), ", "))


def masked_mac(mac: Column, show: bool) -> Column:
    return mac if show else F.regexp_replace(F.coalesce(mac, F.lit("N/A")), "[0-9a-fA-F]", "*")


def shown(value: Column, show: bool, missing: str) -> Column:
    return F.coalesce(value, F.lit(missing)) if show else F.lit("***")


def severity_label(severity: Column) -> Column:
    # fixed values
    return (
        F.when(severity == 1, "High").when(severity == 2, "Medium").when(severity == 3, "Low").otherwise("Unknown")
    )


def one_decimal(value: Column) -> Column:
    """`%.1f` text."""
    return F.format_string("%.1f", value)
