"""Anomaly detectors.

Each returns (anomaly_type, dedup_key, severity, summary, details STRUCT, detected_at) for one tick at
`as_of`, with the cooldown already applied against the `anomalies` history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MIB, Settings
from ..functions.ip import is_private_host
from ..functions.text import one_decimal
from ..functions.timing import instant, recent_rows, within
from .baselines import recent_stats, source_totals, stats_of, updated_baselines
from .cooldown import throttled_by_key, throttled_by_type
from .inventory import byte_total, with_client_lists
from .silver import SensorTables

ANOMALY_COLUMNS = ["anomaly_type", "dedup_key", "severity", "summary", "details", "detected_at"]


def _text(value: Column | str, missing: str = "None") -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(missing)).cast("string")


def _rounded(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def _anomaly(df: DataFrame, kind: str, key: Column, severity: Column | str, summary: Column, details: Column,
             as_of) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        F.lit(kind).alias("anomaly_type"), key.alias("dedup_key"), level.alias("severity"),
        summary.alias("summary"), details.alias("details"), instant(as_of).alias("detected_at"),
    )


def new_devices(devices: DataFrame, known: DataFrame, as_of) -> DataFrame:
    """Inventory addresses that were never registered."""
    fresh = devices.join(known.select("ip"), "ip", "left_anti")
    vendor = F.coalesce(F.nullif("manufacturer", F.lit("")), F.lit("Unknown manufacturer"))
    summary = F.concat(F.lit("New device "), "ip", F.lit(" ("), vendor, F.lit(") appeared on the network"))
    details = F.struct("ip", "mac", "manufacturer", "hostname", "first_seen", "total_conns")
    return _anomaly(fresh, "new_device", F.col("ip"), "medium", summary, details, as_of)


def traffic_spike(conn: DataFrame, anomalies: DataFrame, as_of, settings: Settings = Settings()) -> DataFrame:
    """Connections of the last window against the average window of the trend period.

    Both periods are counted per source; the network totals and the top talkers come from those counts.
    """
    recent = within(F.col("timestamp"), as_of, settings.recent)
    counts = recent_rows(conn, as_of, settings.trend).groupBy(F.col("orig_h").alias("ip")).agg(
        F.count_if(recent).alias("conns"), F.count("*").alias("trend_conns"))
    return spikes_of(counts, anomalies, as_of, settings)


def spikes_of(per_source: DataFrame, anomalies: DataFrame, as_of, settings: Settings = Settings()) -> DataFrame:
    """`traffic_spike` from counts (ip, conns, trend_conns)."""
    totals = per_source.agg(F.sum("conns").alias("current"), F.sum("trend_conns").alias("trend"))
    talkers = (
        per_source.filter("conns > 0").orderBy(F.desc("conns"), "ip").limit(settings.spike_top_talkers)
        .agg(F.collect_list(F.struct((-F.col("conns")).alias("rank"), "ip", "conns")).alias("talkers"))
    )
    both = totals.unionByName(talkers, allowMissingColumns=True).agg(
        F.max("current").alias("current"), F.max("trend").alias("trend"),
        F.any_value("talkers", F.lit(True)).alias("talkers"),
    )
    average = F.col("trend") / F.lit(settings.trend_slices)
    spikes = (
        both.withColumn("average", average)
        .filter(
            (F.col("current") >= settings.spike_min_conns)
            & (F.col("average") > settings.spike_min_average)
            & (F.col("current") > F.lit(settings.spike_ratio) * F.col("average"))
        )
        .withColumn("ratio", F.col("current") / F.col("average"))
    )
    spikes = throttled_by_type(spikes, anomalies, "traffic_spike", settings.spike_cooldown_min, as_of)
    summary = F.concat(
        F.lit("Traffic spike: "), F.col("current").cast("string"), F.lit(" connections in 5 min ("),
        one_decimal(_rounded(F.col("ratio"), 1)), F.lit("x above average)"),
    )
    top = F.transform(F.array_sort("talkers"), lambda t: F.struct(t["ip"].alias("ip"), t["conns"].alias("conns")))
    details = F.struct(
        F.col("current").alias("current_5min_conns"),
        _rounded(F.col("average"), 1).alias("hourly_avg_5min"),
        _rounded(F.col("ratio"), 1).alias("ratio"),
        top.alias("top_talkers"),
    )
    return _anomaly(spikes, "traffic_spike", F.lit("network"), "high", summary, details, as_of)


def alert_groups(alerts: DataFrame, as_of, settings: Settings = Settings()) -> DataFrame:
    """Recent severe alerts per signature, category, source and destination."""
    return (
        recent_rows(alerts, as_of, settings.recent).filter(F.col("log_type") == "eve")
        .filter(F.col("severity") <= settings.alert_max_severity)
        .groupBy("signature", "category", "src_ip", "dest_ip")
        .agg(
            F.min("severity").alias("severity"), F.count("*").alias("count"),
            F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        )
    )


def severe_alerts(alerts: DataFrame, anomalies: DataFrame, as_of, settings: Settings = Settings()) -> DataFrame:
    """One anomaly per signature that is not cooling down.

    Of a signature's groups the most frequent one is reported (then the smallest source and destination);
    alerts without a signature have no key to throttle on, so each of their groups is reported.
    """
    groups = alert_groups(alerts, as_of, settings).withColumn("dedup_key", F.col("signature"))
    groups = throttled_by_key(groups, anomalies, "suricata_alert", settings.alert_cooldown_min, as_of)
    unkeyed = F.when(F.col("signature").isNull(), F.struct("category", "src_ip", "dest_ip"))
    order = F.struct(
        (-F.col("count")).alias("rank"), "src_ip", "dest_ip", "category", "severity", "count", "first_seen",
        "last_seen",
    )
    best = (
        groups.groupBy("signature", unkeyed.alias("unkeyed")).agg(F.min(order).alias("g"))
        .select("signature", "g.*")
    )
    level = F.when(F.col("severity") == 1, "critical").otherwise("high")
    summary = F.concat(
        F.lit("Suricata alert: "), _text("signature"), F.lit(" ("), _text("src_ip"), F.lit(" → "),
        _text("dest_ip"), F.lit(", "), F.col("count").cast("string"), F.lit(" hits)"),
    )
    details = F.struct("signature", "category", "src_ip", "dest_ip", "count", "first_seen", "last_seen")
    return _anomaly(best, "suricata_alert", F.col("signature"), level, summary, details, as_of)


def watched_countries(external_ips: DataFrame, anomalies: DataFrame, as_of,
                      settings: Settings = Settings(), clients: DataFrame | None = None) -> DataFrame:
    """Busiest external hosts in watch-list countries; an empty list switches the detector off.

    With the edges `clients` (`inventory.external_clients`), lists of clients are made for the hosts found only.
    """
    countries = [c for c in settings.watch_countries if c]
    watched = external_ips.filter(F.col("country").isin(countries) & (F.col("total_conns") > 0))
    watched = watched.withColumn("dedup_key", F.col("ip"))
    # a limit counts hosts that are not cooling down
    top = throttled_by_key(watched, anomalies, "suspicious_country", settings.country_cooldown_min, as_of)
    if settings.country_top is not None:
        top = top.orderBy(F.desc("total_conns"), "ip").limit(settings.country_top)
    if clients is not None:
        top = with_client_lists(top, clients)
    summary = F.concat(
        F.lit("Traffic to suspicious country: "), "ip", F.lit(" ("), "country", F.lit(") — "),
        F.col("total_conns").cast("string"), F.lit(" connections"),
    )
    details = F.struct("ip", "country", "total_conns", "total_bytes", "contacted_by", "top_service")
    return _anomaly(top, "suspicious_country", F.col("ip"), "high", summary, details, as_of)


def massive_volume(conn: DataFrame, anomalies: DataFrame, as_of, settings: Settings = Settings()) -> DataFrame:
    """Sources that moved more than the threshold in the last window."""
    totals = recent_rows(conn, as_of, settings.recent).groupBy(F.col("orig_h").alias("ip")).agg(
        F.sum(byte_total()).alias("total_bytes"), F.count("*").alias("conns"))
    return volumes_of(totals, anomalies, as_of, settings)


def volumes_of(totals: DataFrame, anomalies: DataFrame, as_of, settings: Settings = Settings()) -> DataFrame:
    """`massive_volume` from totals (ip, total_bytes, conns)."""
    heavy = totals.filter(F.col("total_bytes") > settings.volume_threshold_mb * MIB).select(
        "ip", "total_bytes", F.col("conns").alias("connections"))
    if settings.volume_top is not None:
        heavy = heavy.orderBy(F.desc("total_bytes"), "ip").limit(settings.volume_top)
    heavy = throttled_by_type(heavy, anomalies, "massive_volume", settings.volume_cooldown_min, as_of)
    mb = _rounded(F.col("total_bytes") / F.lit(float(MIB)), 1)
    summary = F.concat(
        F.lit("Massive data transfer: "), _text("ip"), F.lit(" moved "), one_decimal(mb),
        F.lit(" MB in 5 minutes ("), F.col("connections").cast("string"), F.lit(" connections)"),
    )
    details = F.struct("ip", "total_bytes", mb.alias("total_mb"), "connections")
    return _anomaly(heavy, "massive_volume", F.col("ip"), "high", summary, details, as_of)


def _ratio(now: str, average: str) -> Column:
    return F.col(now) / F.greatest(F.col(average), F.lit(1.0))


def device_behavior(conn: DataFrame, baselines: DataFrame, anomalies: DataFrame, as_of,
                    settings: Settings = Settings()) -> DataFrame:
    """Devices far above their own baseline in bytes or connections."""
    return behaviors_of(recent_stats(conn, as_of, settings, lan_only=False), baselines, anomalies, as_of, settings)


def behaviors_of(stats: DataFrame, baselines: DataFrame, anomalies: DataFrame, as_of,
                 settings: Settings = Settings()) -> DataFrame:
    """`device_behavior` from the last window's statistics."""
    mature = baselines.filter((F.col("samples") >= settings.min_samples) & (F.col("avg_bytes_5min") > 0))
    scored = (
        mature.join(stats, "ip")
        .filter("bytes_5min <> 0")
        .withColumn("bytes_ratio", _ratio("bytes_5min", "avg_bytes_5min"))
        .withColumn("conns_ratio", _ratio("conns_5min", "avg_conns_5min"))
        .withColumn("ratio", F.greatest("bytes_ratio", "conns_ratio"))
        .filter(F.col("ratio") >= settings.behavior_ratio)
        .withColumn("dedup_key", F.col("ip"))
    )
    scored = throttled_by_key(scored, anomalies, "device_behavior", settings.behavior_cooldown_min, as_of)
    trigger = F.when(F.col("bytes_ratio") >= F.col("conns_ratio"), "bytes").otherwise("connections")
    summary = F.concat(
        F.lit("Unusual behavior from "), "ip", F.lit(" ("), _text(F.nullif("manufacturer", F.lit("")), "Unknown"),
        F.lit("): "), trigger, F.lit(" "), one_decimal(_rounded(F.col("ratio"), 1)), F.lit("x above baseline"),
    )
    mib = F.lit(float(MIB))
    details = F.struct(
        "ip", "manufacturer",
        F.col("bytes_5min").cast("bigint").alias("current_bytes_5min"),
        _rounded(F.col("bytes_5min") / mib, 2).alias("current_mb"),
        _rounded(F.col("avg_bytes_5min"), 0).cast("bigint").alias("baseline_bytes_5min"),
        _rounded(F.col("avg_bytes_5min") / mib, 2).alias("baseline_mb"),
        _rounded(F.col("bytes_ratio"), 1).alias("bytes_ratio"),
        F.col("conns_5min").cast("bigint").alias("current_conns_5min"),
        _rounded(F.col("avg_conns_5min"), 0).cast("bigint").alias("baseline_conns_5min"),
        _rounded(F.col("conns_ratio"), 1).alias("conns_ratio"),
        F.col("samples").alias("baseline_samples"),
    )
    return _anomaly(scored, "device_behavior", F.col("ip"), "high", summary, details, as_of)


def destination_fanout(conn: DataFrame, baselines: DataFrame, anomalies: DataFrame, as_of,
                       settings: Settings = Settings()) -> DataFrame:
    """Devices that suddenly reach many more distinct hosts than usual."""
    return fanouts_of(recent_stats(conn, as_of, settings, lan_only=False), baselines, anomalies, as_of, settings)


def fanouts_of(stats: DataFrame, baselines: DataFrame, anomalies: DataFrame, as_of,
               settings: Settings = Settings()) -> DataFrame:
    """`destination_fanout` from the last window's statistics."""
    mature = baselines.filter((F.col("samples") >= settings.min_samples) & (F.col("avg_dest_ips") > 0))
    scored = (
        mature.join(stats, "ip")
        .filter(F.col("dest_ips") >= settings.fanout_min_ips)
        .withColumn("ratio", _ratio("dest_ips", "avg_dest_ips"))
        .filter(F.col("ratio") >= settings.fanout_ratio)
        .withColumn("dedup_key", F.col("ip"))
    )
    scored = throttled_by_key(scored, anomalies, "dest_fanout", settings.fanout_cooldown_min, as_of)
    dests = F.col("dest_ips").cast("bigint")
    ratio = _rounded(F.col("ratio"), 1)
    summary = F.concat(
        F.lit("Unusual destination fan-out from "), "ip", F.lit(" ("),
        _text(F.nullif("manufacturer", F.lit("")), "Unknown"), F.lit("): "), dests.cast("string"),
        F.lit(" unique IPs ("), one_decimal(ratio), F.lit("x above baseline)"),
    )
    details = F.struct(
        "ip", "manufacturer", dests.alias("current_dest_ips"),
        _rounded(F.col("avg_dest_ips"), 1).alias("baseline_dest_ips"), ratio.alias("ratio"),
        F.col("samples").alias("baseline_samples"),
    )
    return _anomaly(scored, "dest_fanout", F.col("ip"), "high", summary, details, as_of)


def first_sight(conn: DataFrame, known: DataFrame, as_of, settings: Settings = Settings()) -> DataFrame:
    """Private sources of the last minutes that are not registered yet, with the MAC of their newest event."""
    recent = recent_rows(conn, as_of, settings.first_sight).filter(is_private_host(F.col("orig_h")))
    sources = (
        recent.groupBy(F.col("orig_h").alias("ip"), "mac").agg(F.max("timestamp").alias("seen"))
        .groupBy("ip").agg(F.max(F.struct("seen", "mac"))["mac"].alias("mac"))
    )
    fresh = sources.join(known.select("ip"), "ip", "left_anti")
    summary = F.concat(F.lit("New device "), "ip", F.lit(" detected"))
    details = F.struct("ip", "mac", F.lit("events_table").alias("detection_path"))
    return _anomaly(fresh, "new_device", F.col("ip"), "medium", summary, details, as_of)


def drained(queue: DataFrame, drained_ids: DataFrame, as_of) -> DataFrame:
    """Live-path queue rows this consumer has not taken yet, as anomalies."""
    todo = queue.join(drained_ids.select("id"), "id", "left_anti")
    summary = F.concat(F.lit("New device "), "ip", F.lit(" detected (fast path)"))
    details = F.struct("ip", "mac", F.col("detected_at").cast("string").alias("detected_at"),
                       F.lit("fast").alias("detection_path"))
    return _anomaly(todo, "new_device", F.col("ip"), "medium", summary, details, as_of)


def stored_form(anomalies: DataFrame) -> DataFrame:
    """Rows as the anomaly table keeps them: a deterministic id and the details as JSON.

    The id covers the details, since anomalies without a key (alerts without a signature) share all the rest.
    """
    details = F.to_json("details")
    return anomalies.select(
        F.xxhash64("anomaly_type", "dedup_key", F.col("detected_at").cast("string"), details).alias("id"),
        "detected_at", "anomaly_type", "dedup_key", "severity", "summary", details.alias("details"),
    )


# Subject and body of the message for a device seen by the live path.
FAST_SUBJECT = "[IDS FAST ALERT] New Device: {ip}"
FAST_BODY = (
    "New device detected on the network.\n\n"
    "IP Address:  {ip}\n"
    "MAC Address: {mac}\n"
    "Detected At: {detected_at}\n\n"
    "This is an automated fast alert.\n"
    "A detailed LLM analysis email will follow shortly."
)


def _filled(template: str, **values: Column) -> Column:
    """A text with {name} places; every value is text or NULL, which shows as `None`."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("None")))
    return text


def fast_alert_texts(queue: DataFrame) -> DataFrame:
    """(id, subject, body) of live-path queue rows; sending them is not built here."""
    mac = F.coalesce(F.nullif("mac", F.lit("")), F.lit("unknown"))
    return queue.select(
        "id", _filled(FAST_SUBJECT, ip=F.col("ip")).alias("subject"),
        _filled(FAST_BODY, ip=F.col("ip"), mac=mac, detected_at=F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss")).alias("body"),
    )


def detect_all(tables: SensorTables, known: DataFrame, baselines: DataFrame, anomalies: DataFrame, as_of,
               settings: Settings = Settings(), baseline: str = "previous", totals: DataFrame | None = None,
               clients: DataFrame | None = None) -> DataFrame:
    """All seven detectors of one tick in stored form.

    Four of them read `totals`, the tick's `source_totals`: give a stored one, or it is computed here. With `clients`
    (see `watched_countries`) the external hosts need no lists of clients.

    `baseline="previous"` compares a device with its past. `"updated"` folds the current window into the
    baseline first; the ratio then cannot exceed 1/alpha.
    """
    if baseline not in ("previous", "updated"):
        raise ValueError(f"unknown baseline order: {baseline}")
    totals = source_totals(tables.conn, as_of, settings) if totals is None else totals
    stats = stats_of(totals, lan_only=False)
    if baseline == "updated":
        baselines = updated_baselines(baselines, stats_of(totals), tables.devices, as_of, settings.ema_alpha)
    found = [
        new_devices(tables.devices, known, as_of),
        spikes_of(totals, anomalies, as_of, settings),
        severe_alerts(tables.alerts, anomalies, as_of, settings),
        watched_countries(tables.external_ips, anomalies, as_of, settings, clients),
        volumes_of(totals, anomalies, as_of, settings),
        behaviors_of(stats, baselines, anomalies, as_of, settings),
        fanouts_of(stats, baselines, anomalies, as_of, settings),
    ]
    result = stored_form(found[0])
    for part in found[1:]:
        result = result.unionByName(stored_form(part))
    return result
