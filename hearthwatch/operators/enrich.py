"""Lookup joins: MAC vendor and IP country.

No join here carries a broadcast hint. Spark broadcasts a lookup only while its measured size stays below
`spark.sql.autoBroadcastJoinThreshold` (planning statistics, re-checked by adaptive execution) and shuffles
it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import ip_to_long
from ..functions.text import mac_prefix

_SLASH_16 = 65536
_SPREAD = 1024


def spread_nulls(missing: Column, *by: str) -> Column:
    """Second equality key for an outer join whose first key is often missing; the other side holds 0 throughout.

    Rows without a key match nothing, but would all be shuffled to one partition; this scatters them.
    """
    return F.when(missing, F.pmod(F.xxhash64(*by), F.lit(_SPREAD)).cast("int") + 1).otherwise(0)


def with_vendor(df: DataFrame, vendors: DataFrame, mac: str = "mac") -> DataFrame:
    """Left join on the MAC's vendor prefix; adds `manufacturer`. Rows without a MAC match nothing and are scattered."""
    lookup = vendors.filter("oui_prefix <> ''").select(F.col("oui_prefix").alias("_prefix"), "manufacturer", F.lit(0).alias("_spread"))
    prefix = F.nullif(mac_prefix(F.col(mac)), F.lit(""))
    keyed = df.withColumn("_prefix", prefix)
    keyed = keyed.withColumn("_spread", spread_nulls(F.col("_prefix").isNull(), *df.columns))
    return keyed.join(lookup, ["_prefix", "_spread"], "left").drop("_prefix", "_spread")


def range_buckets(ranges: DataFrame) -> DataFrame:
    """One row per range and /16 block it touches.

    Disjoint ranges give at most `ranges + 65,536` rows, so the table stays near its own size.
    """
    first = F.floor(F.col("ip_start") / _SLASH_16)
    last = F.floor(F.col("ip_end") / _SLASH_16)
    return ranges.filter("ip_start <= ip_end").select(
        "ip_start", "ip_end", "country", F.explode(F.sequence(first, last)).alias("_block")
    )


def with_country(df: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Range join as an equality on the /16 block plus the exact bounds; adds `country`.

    `df` should hold each address once (as the inventories do): a block then has at most 65,536 rows on
    the left whatever the traffic looks like.
    """
    # -1 lies in no range; a key that is never NULL also keeps NULL tests out of the plan below
    located = (
        df.withColumn("_ip", F.coalesce(ip_to_long(F.col(ip)), F.lit(-1).cast("bigint")))
        .withColumn("_block", F.floor(F.col("_ip") / _SLASH_16))
        .withColumn("_spread", spread_nulls(F.col("_ip") < 0, ip))
    )
    lookup = range_buckets(ranges).withColumn("_range_spread", F.lit(0)).withColumnRenamed("_block", "_range_block")
    hit = (
        (F.col("_block") == F.col("_range_block"))
        & (F.col("_spread") == F.col("_range_spread"))
        & F.col("_ip").between(F.col("ip_start"), F.col("ip_end"))
    )
    return located.join(lookup, hit, "left").select(*df.columns, "country")


def with_event_country(df: DataFrame, ranges: DataFrame, ip: str) -> DataFrame:
    """Country for event-level rows: each distinct address is located once, then joined back."""
    places = with_country(df.select(F.col(ip).alias("ip")).filter("ip IS NOT NULL").distinct(), ranges)
    return df.join(places.withColumnRenamed("ip", ip), ip, "left")
