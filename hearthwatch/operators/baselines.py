"""Behaviour baselines: an exponential moving average per device over its active windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.ip import is_home_lan
from ..functions.timing import bucket, instant, recent_rows, within
from .inventory import byte_total

METRICS = (
    ("bytes_5min", "avg_bytes_5min"),
    ("conns_5min", "avg_conns_5min"),
    ("dest_ips", "avg_dest_ips"),
)


def _with_stats(grouped):
    return grouped.agg(
        F.sum(byte_total()).cast("double").alias("bytes_5min"),
        F.count("*").cast("double").alias("conns_5min"),
        F.count_distinct("resp_h").cast("double").alias("dest_ips"),
    )


def source_totals(conn: DataFrame, as_of, settings: Settings = Settings()) -> DataFrame:
    """What every detector of a tick needs about each source (NULL included), in one pass over the trend period:
    connections, bytes and distinct destinations of the last window, and connections of the whole period.

    The first grouping keys on the destination too, so that the distinct count needs no set per source.
    """
    recent = within(F.col("timestamp"), as_of, settings.recent)
    met = recent_rows(conn, as_of, settings.trend).groupBy(
        F.col("orig_h").alias("ip"), F.when(recent, F.col("resp_h")).alias("resp_h")
    ).agg(
        F.count_if(recent).alias("conns"), F.sum(F.when(recent, byte_total())).alias("total_bytes"), F.count("*").alias("trend_conns"),
    )
    return met.groupBy("ip").agg(
        F.sum("conns").alias("conns"), F.sum("total_bytes").alias("total_bytes"), F.count("resp_h").alias("dest_ips"),
        F.sum("trend_conns").alias("trend_conns"),
    )


def stats_of(totals: DataFrame, lan_only: bool = True) -> DataFrame:
    """`recent_stats` from `source_totals`."""
    active = totals.filter("conns > 0")
    active = active.filter(is_home_lan(F.col("ip"))) if lan_only else active.filter("ip IS NOT NULL")
    return active.select(
        "ip", F.col("total_bytes").cast("double").alias("bytes_5min"), F.col("conns").cast("double").alias("conns_5min"),
        F.col("dest_ips").cast("double").alias("dest_ips"),
    )


def recent_stats(conn: DataFrame, as_of, settings: Settings = Settings(), lan_only: bool = True) -> DataFrame:
    """Bytes, connections and distinct destinations per device in the last window."""
    recent = recent_rows(conn, as_of, settings.recent)
    recent = recent.filter(is_home_lan(F.col("orig_h"))) if lan_only else recent.filter("orig_h IS NOT NULL")
    return _with_stats(recent.groupBy(F.col("orig_h").alias("ip")))


def window_stats(conn: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The same statistics for every past window a device was active in (idle windows have no row)."""
    lan = conn.filter(is_home_lan(F.col("orig_h")))
    keyed = lan.withColumn("window_start", bucket(F.col("timestamp"), settings.recent))
    return _with_stats(keyed.groupBy(F.col("orig_h").alias("ip"), "window_start"))


SKETCH_BITS = 12  # log2 of a sketch's buckets: its standard error is 1.04 / sqrt(2 ** SKETCH_BITS), 1.6 percent
SKETCH_ERROR = 0.05  # three standard errors


def minute_sketches(conn: DataFrame, width: str = "1 minute") -> DataFrame:
    """Mergeable statistics of each source and minute: sums, and a sketch of its destinations.

    A sliding window merges the minutes it covers instead of counting its connections again, and a sketch has the same
    size however many destinations it has seen. The exact way is `window_stats`.
    """
    keyed = conn.filter("orig_h IS NOT NULL").withColumn("minute", bucket(F.col("timestamp"), width))
    return keyed.groupBy(F.col("orig_h").alias("ip"), "minute").agg(
        F.sum(byte_total()).alias("bytes"), F.count("*").alias("conns"), F.hll_sketch_agg("resp_h", F.lit(SKETCH_BITS)).alias("met"))


def merged_windows(minutes: DataFrame, length: str, slide: str) -> DataFrame:
    """Statistics of sliding windows from `minute_sketches`; `dest_ips` is an estimate within SKETCH_ERROR."""
    windows = minutes.groupBy("ip", F.window("minute", length, slide)["start"].alias("window_start"))
    return windows.agg(
        F.sum("bytes").cast("double").alias("bytes_5min"), F.sum("conns").cast("double").alias("conns_5min"),
        F.hll_sketch_estimate(F.hll_union_agg("met")).cast("double").alias("dest_ips"))


def updated_baselines(state: DataFrame, current: DataFrame, devices: DataFrame, as_of,
                      alpha: float = Settings.ema_alpha) -> DataFrame:
    """Next state of the baseline table after one tick.

    Devices seen for the first time are seeded, active ones are blended, idle ones keep their row untouched.
    """
    vendors = devices.select("ip", F.col("manufacturer").alias("vendor"))
    old = state.select("ip", F.col("manufacturer").alias("old_vendor"), *[avg for _, avg in METRICS],
                       "samples", "updated_at")
    merged = old.join(current.join(vendors, "ip", "left"), "ip", "full")
    active = F.col("conns_5min").isNotNull()
    blended = [
        F.when(~active, F.col(avg))
        .when(F.col("samples").isNull(), F.col(now))
        .otherwise(F.lit(alpha) * F.col(now) + F.lit(1 - alpha) * F.col(avg))
        .alias(avg)
        for now, avg in METRICS
    ]
    return merged.select(
        "ip",
        F.when(active, F.col("vendor")).otherwise(F.col("old_vendor")).alias("manufacturer"),
        *blended,
        (F.coalesce("samples", F.lit(0)) + F.when(active, 1).otherwise(0)).cast("int").alias("samples"),
        F.when(active, instant(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def replayed_baselines(windows: DataFrame, devices: DataFrame | None = None,
                       alpha: float = Settings.ema_alpha) -> DataFrame:
    """Baselines after all given windows, as if each had been one tick.

    An EMA over n windows is a weighted sum: the k-th newest value weighs alpha*(1-alpha)^k and the oldest
    (1-alpha)^(n-1). So a rank from the newest window and one partial sum replace the fold, and nothing is
    collected per device.
    """
    newest_first = F.row_number().over(W.partitionBy("ip").orderBy(F.desc("window_start"))) - 1
    ranked = windows.withColumn("age", newest_first)
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("age"))
    # weights too small to matter (and below the smallest double) add nothing, exactly as in the fold
    sums = [F.sum(weight * F.col(now)).alias(avg) for now, avg in METRICS]
    oldest = [F.max_by(now, "age").alias(f"first_{now}") for now, _ in METRICS]
    folded = ranked.groupBy("ip").agg(
        *sums, *oldest, F.count("*").cast("int").alias("samples"), F.max("window_start").alias("updated_at")
    )
    seed = F.pow(F.lit(1 - alpha), F.col("samples"))
    averages = [(F.col(avg) + seed * F.col(f"first_{now}")).alias(avg) for now, avg in METRICS]
    if devices is None:
        folded = folded.withColumn("manufacturer", F.lit(None).cast("string"))
    else:
        folded = folded.join(devices.select("ip", "manufacturer"), "ip", "left")
    return folded.select("ip", "manufacturer", *averages, "samples", "updated_at")
