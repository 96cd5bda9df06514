"""Structured Streaming versions of the windowed and stateful operators.

All of them are append-mode transformations of a silver stream whose `timestamp` is a TIMESTAMP.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.ip import is_home_lan, is_private_host
from ..functions.payload import json_text
from ..operators.inventory import byte_total

# fixed values: event types of the EVE log whose source counts as a sighting
SIGHTING_TYPES = ("flow", "conn", "alert", "dns", "tls", "http", "fileinfo")

LATENESS = "10 minutes"


def sightings(lines: DataFrame) -> DataFrame:
    """Source address of each live log line; lines that are not JSON give none."""
    raw, path = F.col("value"), F.col("source_file")
    zeek = F.when(path.rlike(r"/zeek[^/]*/conn[^/]*\.log$"), json_text(raw, "id.orig_h"))
    eve = F.when(
        path.rlike(r"/suricata[^/]*/eve\.json$") & json_text(raw, "event_type").isin(*SIGHTING_TYPES),
        json_text(raw, "src_ip"),
    )
    return lines.select(F.coalesce(zeek, eve).alias("ip"), F.col("modified_at").alias("seen_at")).filter("ip IS NOT NULL")


def new_addresses(seen: DataFrame, known: DataFrame) -> DataFrame:
    """First sighting of every private address that is not registered; each address is reported once.

    The state is the set of addresses reported so far, which is what the known-device table holds anyway: at most the
    private IPv4 addresses, 18 million in all.
    """
    private = seen.filter(is_private_host(F.col("ip")))
    return private.join(known.select("ip"), "ip", "left_anti").dropDuplicates(["ip"])


def trailing_stats(conn: DataFrame, length: str = "5 minutes", slide: str = "1 minute",
                   lateness: str = LATENESS) -> DataFrame:
    """Bytes, connections and exact distinct destinations per device and sliding window.

    Two chained aggregations: the first keys on the destination as well, so the distinct count needs no
    per-device set and a busy device is spread over the state partitions. Filter the result in the sink, not
    on the group key here: a filter pushed below the aggregation would narrow what the watermark sees.
    """
    timed = conn.withWatermark("timestamp", lateness)
    per_destination = timed.groupBy(
        F.window("timestamp", length, slide), F.col("orig_h").alias("ip"), "resp_h"
    ).agg(F.sum(byte_total()).alias("b"), F.count("*").alias("n"))
    return per_destination.groupBy("window", "ip").agg(
        F.sum("b").cast("double").alias("bytes_5min"),
        F.sum("n").cast("double").alias("conns_5min"),
        F.count("resp_h").cast("double").alias("dest_ips"),
    ).select("ip", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
             "bytes_5min", "conns_5min", "dest_ips")


def lan_only(stats: DataFrame) -> DataFrame:
    return stats.filter(is_home_lan(F.col("ip")))


def timeline(events: DataFrame, *dimensions: str | Column, width: str = "5 minutes",
             lateness: str = LATENESS) -> DataFrame:
    """Continuous form of the dashboards' time series."""
    counts = events.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", width), *dimensions)
    return counts.agg(F.count("*").alias("count")).withColumn("time", F.col("window.start")).drop("window")


BASELINE_ROW = (
    "ip STRING, window_start TIMESTAMP, avg_bytes_5min DOUBLE, avg_conns_5min DOUBLE, avg_dest_ips DOUBLE, samples INT, late INT"
)
_METRICS = ["bytes_5min", "conns_5min", "dest_ips"]
_AVERAGES = ["avg_bytes_5min", "avg_conns_5min", "avg_dest_ips"]


def running_baselines(stats: DataFrame, alpha: float = 0.3, idle: str = "30 days", lateness: str = LATENESS) -> DataFrame:
    """Baseline after every window of a stream of per-window statistics (one row per device and window).

    The state per device is three averages and a counter; it goes when the device has been silent for `idle`. A
    window that is not newer than the last one folded in has been folded in before (or came too late to have a
    place in the order): it is not folded in, so a replayed batch changes no average. `late` counts such windows of the
    device so far.
    """
    silence = pd.Timedelta(idle)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows, samples, late = pd.concat(list(frames)).sort_values("window_start"), 0, 0
        before = rows[_METRICS].iloc[:0]
        if state.exists:
            *averages, samples, late, last = state.get
            new = rows["window_start"] > pd.Timestamp(last)
            late += int((~new).sum())
            rows = rows[new]
            before = pd.DataFrame([averages], columns=_METRICS)
        if len(rows):
            # the state is the row before the first: the weighted mean of all up to each row, in one go
            means = pd.concat([before, rows[_METRICS]]).ewm(alpha=alpha, adjust=False).mean().iloc[len(before):]
            counts = range(samples + 1, samples + 1 + len(rows))
            out = pd.DataFrame({"ip": key[0], "window_start": rows["window_start"].to_numpy(), **dict(zip(_AVERAGES, means.to_numpy().T)), "samples": counts, "late": late})
            last = rows["window_start"].iloc[-1]
            state.update((*map(float, means.iloc[-1]), counts[-1], late, last.to_pydatetime()))
            state.setTimeoutTimestamp(max(int((last + silence).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
            yield out
        elif state.exists:
            state.update((*averages, samples, late, last))
            state.setTimeoutTimestamp(max(int((pd.Timestamp(last) + silence).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    return stats.withWatermark("window_start", lateness).groupBy("ip").applyInPandasWithState(
        fold, BASELINE_ROW, "b DOUBLE, c DOUBLE, d DOUBLE, samples INT, late INT, last TIMESTAMP", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def candidate_ticks(candidates: DataFrame, tick: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Candidates (`anomaly_type`, `dedup_key`, `detected_at`) counted per key and tick."""
    return (
        candidates.withWatermark("detected_at", lateness)
        .groupBy(F.window("detected_at", tick), "anomaly_type", "dedup_key").agg(F.count("*").alias("hits"))
        .select("anomaly_type", "dedup_key", F.col("window.start").alias("detected_at"), "hits")
    )


def throttled(ticks: DataFrame, minutes: int, lateness: str = LATENESS) -> DataFrame:
    """Ticks that fire, one per key and cooldown.

    Reads the table `candidate_ticks` writes (Spark allows no stateful function after an aggregation in one
    query), so it sees a key at most once per tick however many alerts arrive. The state per key is the time
    it last fired and expires with the cooldown.
    """
    wait = pd.Timedelta(minutes=minutes)

    def fire(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0]) if state.exists else None
        ticks = pd.concat(list(frames)).sort_values("detected_at", ignore_index=True)
        times, fired = ticks["detected_at"], []
        at = 0 if last is None else int(times.searchsorted(last + wait))
        while at < len(ticks):  # from one that fires straight to the next that may
            fired.append(at)
            last = times[at]
            at = int(times.searchsorted(last + wait))
        if last is not None:
            state.update((last.to_pydatetime(),))
            expires = int((last + wait).timestamp() * 1000)
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield ticks.iloc[fired][["anomaly_type", "dedup_key", "detected_at", "hits"]]

    return ticks.withWatermark("detected_at", lateness).groupBy("anomaly_type", "dedup_key").applyInPandasWithState(
        fire, "anomaly_type STRING, dedup_key STRING, detected_at TIMESTAMP, hits BIGINT", "last TIMESTAMP", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def alerts_with_flows(alerts: DataFrame, conn: DataFrame, spread: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Alerts with the flows of the same id seen within `spread` of them.

    An alert without a flow comes out, with empty flow columns, once the watermark has passed its time range. Alerts
    without a flow id meet no flow: a second key scatters them, so that they don't wait in one state partition.
    """
    scatter = F.when(F.col("community_id").isNull(), F.pmod(F.xxhash64("src_ip", "dest_ip", "timestamp"), F.lit(1 << 16))).otherwise(0)
    a = alerts.withWatermark("timestamp", lateness).select(
        F.col("timestamp").alias("alert_time"), "signature", "severity", "src_ip", "dest_ip", "community_id", scatter.alias("spot"))
    c = conn.filter("community_id IS NOT NULL").withWatermark("timestamp", lateness).select(
        F.col("timestamp").alias("flow_time"), F.col("community_id").alias("flow_id"), F.lit(0).cast("bigint").alias("flow_spot"), "duration", "conn_state")
    near = F.expr(f"flow_time BETWEEN alert_time - INTERVAL '{spread}' AND alert_time + INTERVAL '{spread}'")
    same = (F.col("community_id") == F.col("flow_id")) & (F.col("spot") == F.col("flow_spot"))
    return a.join(c, same & near, "leftOuter").drop("flow_id", "spot", "flow_spot")
