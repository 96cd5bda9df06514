"""Dashboard panels: a registry of `name -> query(tables, start, end, **variables)`.

Every panel reads the silver tables or the two inventories. Limited panels order by their measure and then by
their remaining columns, so a result does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import is_home_lan, is_lan_or_ten, is_map_internal, is_outside_source
from ..functions.payload import or_zero, to_int
from ..functions.text import masked_mac, severity_label, shown
from ..functions.timing import back, bucket, instant, rows_between
from ..operators.correlate import newest_alerts_with_flows
from ..operators.inventory import byte_total, most_frequent
from ..operators.silver import SensorTables

Panel = Callable[..., DataFrame]
PANELS: dict[str, Panel] = {}

TIMELINE = "5 minutes"
INTERNAL_ONLY = "Internal Only"


def panel(name: str) -> Callable[[Panel], Panel]:
    def add(query: Panel) -> Panel:
        PANELS[name] = query
        return query

    return add


# --- building blocks -------------------------------------------------------------------------------------


def in_range(df: DataFrame, start, end) -> DataFrame:
    return rows_between(df, start, end)


def how_many(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("value"))


def how_many_distinct(df: DataFrame, value: Column | str) -> DataFrame:
    return df.agg(F.count_distinct(value).alias("value"))


def counted(df: DataFrame, count: str, **groups: Column | str) -> DataFrame:
    keys = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in groups.items()]
    return df.groupBy(*keys).agg(F.count("*").alias(count))


def top(df: DataFrame, measure: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(measure), *[c for c in df.columns if c != measure]).limit(n)


def newest(df: DataFrame, n: int = 50) -> DataFrame:
    return top(df, "timestamp", n)


def timeline(df: DataFrame, count: str, width: str = TIMELINE, **groups: Column | str) -> DataFrame:
    return counted(df, count, time=bucket(F.col("timestamp"), width), **groups)


def _eve(df: DataFrame) -> DataFrame:
    return df.filter(F.col("source_tool") == "suricata")


def _eve_anomalies(t: SensorTables, start, end) -> DataFrame:
    return in_range(_eve(t.activity).filter(F.col("event_type") == "anomaly"), start, end)


# --- overview --------------------------------------------------------------------------------------------


@panel("overview_total_events")
def overview_total_events(t, start, end, hours: int = 24):
    recent = (F.col("timestamp") > back(end, f"{hours} hours")) & (F.col("timestamp") <= instant(end))
    return how_many(t.activity.filter(recent))


@panel("overview_alerts")
def overview_alerts(t, start, end):
    return how_many(in_range(t.alerts, start, end))


@panel("overview_unique_sources")
def overview_unique_sources(t, start, end):
    return how_many_distinct(in_range(t.activity, start, end), "src_ip")


@panel("overview_unique_destinations")
def overview_unique_destinations(t, start, end):
    return how_many_distinct(in_range(t.activity, start, end), "dest_ip")


@panel("overview_events_over_time")
def overview_events_over_time(t, start, end):
    return timeline(in_range(t.activity, start, end), "count", source_tool="source_tool")


@panel("overview_event_types")
def overview_event_types(t, start, end):
    return top(counted(in_range(t.activity, start, end), "count", event_type="event_class"), "count", 15)


def _protocols(t, start, end):
    spoken = in_range(t.activity.filter("proto IS NOT NULL"), start, end)
    return top(counted(spoken, "count", protocol=F.lower("proto")), "count", 10)


PANELS["overview_protocols"] = _protocols


@panel("overview_source_split")
def overview_source_split(t, start, end):
    return counted(in_range(t.activity, start, end), "count", source_tool="source_tool")


def _masked_devices(devices: DataFrame, show_mac: bool, show_manufacturer: bool, show_hostname: bool):
    return devices.select(
        "ip",
        masked_mac(F.col("mac"), show_mac).alias("mac"),
        shown(F.col("manufacturer"), show_manufacturer, "Unknown").alias("manufacturer"),
        shown(F.col("hostname"), show_hostname, "N/A").alias("hostname"),
        "total_conns", "total_bytes", "protocols", "services",
    )


@panel("overview_internal_devices")
def overview_internal_devices(t, start, end, show_mac=False, show_manufacturer=False, show_hostname=False):
    rows = _masked_devices(t.devices, show_mac, show_manufacturer, show_hostname)
    return rows.drop("protocols", "services").orderBy(F.desc("total_conns"), "ip")


@panel("overview_external_ips")
def overview_external_ips(t, start, end):
    return t.external_ips.drop("top_dest_port").orderBy(F.desc("total_conns"), "ip")


# --- alerts ----------------------------------------------------------------------------------------------

PANELS["alerts_total"] = overview_alerts


@panel("alerts_high_severity")
def alerts_high_severity(t, start, end):
    return how_many(in_range(t.alerts.filter("severity = 1"), start, end))


@panel("alerts_unique_signatures")
def alerts_unique_signatures(t, start, end):
    return how_many_distinct(in_range(t.alerts, start, end), "signature")


@panel("alerts_severity_distribution")
def alerts_severity_distribution(t, start, end):
    return counted(in_range(t.alerts, start, end), "count", severity=severity_label(F.col("severity")))


@panel("alerts_top_signatures")
def alerts_top_signatures(t, start, end):
    rows = counted(in_range(t.alerts, start, end), "count", signature="signature", category="category",
                   severity="severity")
    return top(rows, "count", 10)


@panel("alerts_timeline")
def alerts_timeline(t, start, end):
    return timeline(in_range(t.alerts, start, end), "count", severity=severity_label(F.col("severity")))


@panel("alerts_top_sources")
def alerts_top_sources(t, start, end):
    return top(counted(in_range(t.alerts, start, end), "alerts", source_ip="src_ip"), "alerts", 10)


@panel("alerts_top_destinations")
def alerts_top_destinations(t, start, end):
    return top(counted(in_range(t.alerts, start, end), "alerts", dest_ip="dest_ip"), "alerts", 10)


@panel("alerts_recent")
def alerts_recent(t, start, end):
    return newest(in_range(t.alerts, start, end).select(
        "timestamp", "signature", "severity", "src_ip", "dest_ip", "dest_port", "proto"))


# --- traffic ---------------------------------------------------------------------------------------------


@panel("traffic_connections")
def traffic_connections(t, start, end):
    return how_many(in_range(t.conn, start, end))


@panel("traffic_bytes")
def traffic_bytes(t, start, end):
    return in_range(t.conn, start, end).agg(F.sum(byte_total()).alias("value"))


@panel("traffic_unique_protocols")
def traffic_unique_protocols(t, start, end):
    return how_many_distinct(in_range(t.activity, start, end), F.lower("proto"))


@panel("traffic_volume_over_time")
def traffic_volume_over_time(t, start, end):
    rows = in_range(t.conn, start, end)
    return rows.groupBy(bucket(F.col("timestamp"), TIMELINE).alias("time"), F.col("proto").alias("protocol")).agg(
        F.sum(byte_total()).alias("bytes"))


PANELS["traffic_protocols"] = _protocols


@panel("traffic_top_sources")
def traffic_top_sources(t, start, end):
    return top(counted(in_range(t.conn, start, end), "connections", source_ip="orig_h"), "connections", 10)


@panel("traffic_top_destinations")
def traffic_top_destinations(t, start, end):
    return top(counted(in_range(t.conn, start, end), "connections", dest_ip="resp_h"), "connections", 10)


@panel("traffic_top_ports")
def traffic_top_ports(t, start, end):
    return top(counted(in_range(t.conn, start, end), "connections", dest_port="resp_p"), "connections", 10)


@panel("traffic_recent_connections")
def traffic_recent_connections(t, start, end):
    return newest(in_range(t.conn, start, end).select(
        "timestamp", F.col("orig_h").alias("src_ip"), F.col("resp_h").alias("dest_ip"),
        F.col("resp_p").alias("dest_port"), "proto", "service", "community_id", F.col("conn_state").alias("state")))


# --- dns -------------------------------------------------------------------------------------------------


def _nxdomain(t, start, end):
    return in_range(_eve(t.dns).filter("rcode = 'NXDOMAIN'"), start, end)


@panel("dns_total")
def dns_total(t, start, end):
    return how_many(in_range(t.dns, start, end))


@panel("dns_unique_domains")
def dns_unique_domains(t, start, end):
    return how_many_distinct(in_range(t.dns, start, end), "domain")


@panel("dns_nxdomain_count")
def dns_nxdomain_count(t, start, end):
    return how_many(_nxdomain(t, start, end))


@panel("dns_over_time")
def dns_over_time(t, start, end):
    return timeline(in_range(t.dns, start, end), "count", source_tool="source_tool")


@panel("dns_top_domains")
def dns_top_domains(t, start, end):
    return top(counted(in_range(t.dns, start, end), "queries", domain="domain"), "queries", 20)


@panel("dns_query_types")
def dns_query_types(t, start, end):
    return counted(in_range(t.dns, start, end), "count", query_type="query_type")


@panel("dns_nxdomain_domains")
def dns_nxdomain_domains(t, start, end):
    return top(counted(_nxdomain(t, start, end), "count", domain="rrname", querier="src_ip"), "count", 20)


# --- threats ---------------------------------------------------------------------------------------------


def _eve_tls(t, start, end):
    return in_range(_eve(t.tls), start, end)


@panel("threats_anomaly_count")
def threats_anomaly_count(t, start, end):
    return how_many(_eve_anomalies(t, start, end))


@panel("threats_tls_events")
def threats_tls_events(t, start, end):
    return how_many(in_range(t.tls, start, end))


@panel("threats_unique_ja3")
def threats_unique_ja3(t, start, end):
    return how_many_distinct(_eve_tls(t, start, end), "ja3_hash")


@panel("threats_anomaly_timeline")
def threats_anomaly_timeline(t, start, end):
    return timeline(_eve_anomalies(t, start, end), "anomalies")


@panel("threats_tls_versions")
def threats_tls_versions(t, start, end):
    return counted(in_range(t.tls, start, end), "count", tls_version="tls_version")


@panel("threats_alert_flow_correlation")
def threats_alert_flow_correlation(t, start, end):
    return newest_alerts_with_flows(in_range(t.alerts, start, end), t.conn, 50)


@panel("threats_top_sni")
def threats_top_sni(t, start, end):
    named = _eve_tls(t, start, end).filter("sni IS NOT NULL")
    return top(counted(named, "count", sni="sni", version="eve_version"), "count", 20)


@panel("threats_top_ja3")
def threats_top_ja3(t, start, end):
    hashed = _eve_tls(t, start, end).filter("ja3_hash IS NOT NULL")
    return top(counted(hashed, "count", ja3_hash="ja3_hash", sample_sni="sni"), "count", 20)


# --- nodes -----------------------------------------------------------------------------------------------


@panel("nodes_internal_ips")
def nodes_internal_ips(t, start, end):
    return how_many(t.devices)


@panel("nodes_external_ips")
def nodes_external_ips(t, start, end):
    return how_many(t.external_ips)


@panel("nodes_dhcp_assignments")
def nodes_dhcp_assignments(t, start, end):
    return how_many(in_range(t.dhcp, start, end))


@panel("nodes_new_ips_over_time")
def nodes_new_ips_over_time(t, start, end):
    first = in_range(t.activity, start, end).filter("src_ip IS NOT NULL").groupBy("src_ip").agg(
        F.min("timestamp").alias("timestamp"))
    return timeline(first, "new_ips", width="1 hour")


@panel("nodes_traffic_direction")
def nodes_traffic_direction(t, start, end):
    direction = F.when(is_home_lan(F.col("dest_ip")), "Internal").otherwise("External")
    return counted(in_range(t.activity, start, end).filter("dest_ip IS NOT NULL"), "count", direction=direction)


@panel("nodes_device_inventory")
def nodes_device_inventory(t, start, end, show_mac=False, show_manufacturer=False, show_hostname=False):
    return _masked_devices(t.devices, show_mac, show_manufacturer, show_hostname).orderBy(
        F.desc("total_conns"), "ip").limit(50)


@panel("nodes_noisiest_devices")
def nodes_noisiest_devices(t, start, end, show_manufacturer=False):
    label = (
        F.concat(F.coalesce("manufacturer", F.lit("Unknown")), F.lit(" ("), "ip", F.lit(")"))
        if show_manufacturer else F.col("ip")
    )
    return top(t.devices.select(label.alias("device"), "total_conns", "total_bytes"), "total_bytes", 5)


@panel("nodes_by_manufacturer")
def nodes_by_manufacturer(t, start, end, show_manufacturer=False):
    return counted(t.devices, "count", manufacturer=shown(F.col("manufacturer"), show_manufacturer, "Unknown"))


@panel("nodes_dhcp_leases")
def nodes_dhcp_leases(t, start, end, show_mac=False):
    return newest(in_range(t.dhcp, start, end).select(
        "timestamp", F.col("assigned_addr").alias("assigned_ip"),
        masked_mac(F.col("mac"), show_mac).alias("mac_address"), F.col("server_addr").alias("dhcp_server"),
        "domain", F.col("lease_time").alias("lease_seconds")))


# --- device detail ---------------------------------------------------------------------------------------


def _device(t, device: str, value: Column) -> DataFrame:
    return t.devices.filter(F.col("ip") == device).select(value.alias("value"))


def _device_conns(t, start, end, device: str) -> DataFrame:
    return in_range(t.conn.filter(F.col("orig_h") == device), start, end)


@panel("device_ip")
def device_ip(t, start, end, device):
    return _device(t, device, F.col("ip"))


@panel("device_mac")
def device_mac(t, start, end, device, show_mac=False):
    return _device(t, device, masked_mac(F.coalesce("mac", F.lit("N/A")), show_mac))


@panel("device_manufacturer")
def device_manufacturer(t, start, end, device, show_manufacturer=False):
    return _device(t, device, shown(F.col("manufacturer"), show_manufacturer, "Unknown"))


@panel("device_hostname")
def device_hostname(t, start, end, device, show_hostname=False):
    return _device(t, device, shown(F.col("hostname"), show_hostname, "N/A"))


@panel("device_total_connections")
def device_total_connections(t, start, end, device):
    return _device(t, device, F.col("total_conns"))


@panel("device_total_bytes")
def device_total_bytes(t, start, end, device):
    return _device(t, device, F.col("total_bytes"))


@panel("device_traffic_over_time")
def device_traffic_over_time(t, start, end, device):
    return _device_conns(t, start, end, device).groupBy(bucket(F.col("timestamp"), "1 minute").alias("time")).agg(
        F.count("*").alias("connections"), F.sum(byte_total()).alias("bytes"))


@panel("device_services")
def device_services(t, start, end, device):
    return counted(_device_conns(t, start, end, device), "count", service=F.coalesce("service", F.lit("unknown")))


def _with_country(df: DataFrame, t: SensorTables, ip: str) -> DataFrame:
    return df.join(t.external_ips.select(F.col("ip").alias(ip), "country"), ip, "left")


@panel("device_external_destinations")
def device_external_destinations(t, start, end, device):
    rows = (
        _device_conns(t, start, end, device).filter(~is_lan_or_ten(F.col("resp_h")))
        .groupBy(F.col("resp_h").alias("dest_ip"), to_int(F.col("resp_p")).alias("port"), "service")
        .agg(F.count("*").alias("connections"), F.sum(byte_total()).alias("bytes"))
    )
    # the country depends on the destination alone, so it can be looked up after grouping
    return top(_with_country(rows, t, "dest_ip").select(
        "dest_ip", "country", "port", "service", "connections", "bytes"), "connections", 30)


@panel("device_internal_destinations")
def device_internal_destinations(t, start, end, device):
    inside = _device_conns(t, start, end, device).filter(is_lan_or_ten(F.col("resp_h")))
    return top(counted(inside, "connections", dest_ip="resp_h", port=to_int(F.col("resp_p")), service="service"),
               "connections", 30)


@panel("device_recent_connections")
def device_recent_connections(t, start, end, device):
    return newest(_device_conns(t, start, end, device).select(
        "timestamp", F.col("resp_h").alias("dest_ip"), to_int(F.col("resp_p")).alias("port"), "proto", "service",
        "duration", or_zero(F.col("orig_bytes")).alias("orig_bytes"),
        or_zero(F.col("resp_bytes")).alias("resp_bytes"), F.col("conn_state").alias("state")))


@panel("device_selector")
def device_selector(t, start, end):
    return t.devices.orderBy(F.desc("total_conns"), "ip").select("ip")


# --- external hosts and countries ------------------------------------------------------------------------


@panel("geo_unique_countries")
def geo_unique_countries(t, start, end):
    return how_many_distinct(t.external_ips, "country")


PANELS["geo_unique_external_ips"] = nodes_external_ips


def _external_total(measure: str) -> Panel:
    def query(t, start, end):
        return t.external_ips.agg(F.coalesce(F.sum(measure), F.lit(0)).cast("bigint").alias("value"))

    return query


PANELS["geo_external_bytes"] = _external_total("total_bytes")
PANELS["geo_external_connections"] = _external_total("total_conns")


def _countries(measure: str, name: str) -> Panel:
    def query(t, start, end):
        rows = t.external_ips.groupBy(F.coalesce("country", F.lit("??")).alias("country")).agg(
            F.sum(measure).cast("bigint").alias(name))
        return top(rows, name, 15)

    return query


PANELS["geo_countries_by_connections"] = _countries("total_conns", "connections")
PANELS["geo_countries_by_bytes"] = _countries("total_bytes", "bytes")


@panel("geo_top_external_ips")
def geo_top_external_ips(t, start, end):
    return top(t.external_ips.select(
        "ip", F.coalesce("country", F.lit("??")).alias("country"), F.col("total_conns").alias("connections"),
        F.col("total_bytes").alias("bytes"), F.col("contacted_by").alias("internal_clients"),
        F.col("top_service").alias("service"), F.col("top_dest_port").alias("port")), "connections", 20)


@panel("geo_unsolicited_inbound")
def geo_unsolicited_inbound(t, start, end):
    inbound = in_range(t.conn, start, end).filter(
        is_outside_source(F.col("orig_h")) & is_lan_or_ten(F.col("resp_h")))
    rows = counted(inbound, "connections", source_ip="orig_h", dest_ip="resp_h",
                   dest_port=to_int(F.col("resp_p")), service="service", proto="proto")
    return top(_with_country(rows, t, "source_ip").select(
        "source_ip", "country", "dest_ip", "dest_port", "service", "proto", "connections"), "connections", 30)


# --- connection map --------------------------------------------------------------------------------------


def _map_conns(t, start, end, view_mode: str) -> DataFrame:
    rows = in_range(t.conn, start, end)
    if view_mode == INTERNAL_ONLY:
        rows = rows.filter(is_map_internal(F.col("orig_h")) & is_map_internal(F.col("resp_h")))
    return rows


@panel("map_unique_devices")
def map_unique_devices(t, start, end):
    rows = in_range(t.conn, start, end)
    both = rows.select(F.col("orig_h").alias("ip")).union(rows.select("resp_h")).distinct()
    return both.agg(F.count("ip").alias("value"))


PANELS["map_connections"] = traffic_connections
PANELS["map_bytes"] = traffic_bytes


@panel("map_unique_pairs")
def map_unique_pairs(t, start, end):
    return how_many(in_range(t.conn, start, end).select("orig_h", "resp_h").distinct())


def _fan(key: str, key_name: str, other: str, other_name: str) -> Panel:
    def query(t, start, end, view_mode=INTERNAL_ONLY, min_conns=1):
        rows = _map_conns(t, start, end, view_mode).groupBy(F.col(key).alias(key_name)).agg(
            F.count_distinct(other).alias(other_name), F.count("*").alias("total_connections"))
        return top(rows.filter(F.col("total_connections") >= min_conns), other_name, 15)

    return query


PANELS["map_top_senders"] = _fan("orig_h", "device", "resp_h", "unique_destinations")
PANELS["map_top_destinations"] = _fan("resp_h", "destination", "orig_h", "unique_sources")


@panel("map_top_pairs")
def map_top_pairs(t, start, end, view_mode=INTERNAL_ONLY, min_conns=1):
    pairs = _map_conns(t, start, end, view_mode).groupBy("orig_h", "resp_h").agg(
        F.count("*").alias("connections"), F.sum(byte_total()).alias("bytes"))
    named = pairs.filter(F.col("connections") >= min_conns).select(
        F.concat("orig_h", F.lit(" -> "), "resp_h").alias("pair"), "connections", "bytes")
    return top(named, "bytes", 20)


@panel("map_connection_details")
def map_connection_details(t, start, end, show_manufacturer=False):
    # counted per label first, then per pair: no per-pair value map, and a busy pair is folded map-side
    labels = in_range(t.conn, start, end).groupBy(
        F.col("orig_h").alias("src_ip"), F.col("resp_h").alias("dst_ip"),
        F.coalesce("service", "resp_p").alias("label"),
    ).agg(F.count("*").alias("n"), F.sum(byte_total()).alias("b"))
    pairs = labels.groupBy("src_ip", "dst_ip").agg(
        F.sum("n").alias("connections"), F.sum("b").alias("bytes"),
        most_frequent("label", "n", F.lit(True)).alias("top_service"),
    )
    src = t.devices.select(F.col("ip").alias("src_ip"), F.col("manufacturer").alias("src_vendor"))
    dst = t.devices.select(F.col("ip").alias("dst_ip"), F.col("manufacturer").alias("dst_vendor"))
    ext = t.external_ips.select(F.col("ip").alias("dst_ip"), "country")
    rows = pairs.join(src, "src_ip", "left").join(dst, "dst_ip", "left").join(ext, "dst_ip", "left")
    if show_manufacturer:
        src_text = F.coalesce("src_vendor", F.lit(""))
        dst_text = F.coalesce("dst_vendor", "country", F.lit(""))
    else:
        src_text, dst_text = F.lit("***"), F.coalesce("country", F.lit("***"))
    return top(rows.select(
        "src_ip", src_text.alias("src_manufacturer"), "dst_ip", dst_text.alias("dst_info"), "connections", "bytes",
        "top_service"), "connections", 50)
