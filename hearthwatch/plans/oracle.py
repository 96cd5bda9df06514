"""Checking SQL for the registered queries, on the same generic tables.

Written independently of the DataFrame code: each statement states the result directly over the typed CTEs
below. Only the adapter's column expressions are shared, since they define the input.
"""

from __future__ import annotations

import re

from .. import adapter as A
from ..operators.rules import CLASS_DESCRIPTIONS

T = f"TIMESTAMP '{A.AS_OF}'"
START = f"TIMESTAMP '{A.START}'"
DEVICE = "192.168.0.1"


def _duck(expression: str) -> str:
    return expression.replace("<half_even>", "CAST((").replace("</half_even>", ") AS BIGINT)")


def _typed(name: str) -> str:
    where, columns = A.SILVER[name]
    cols = ", ".join(f'{_duck(e)} AS "{c}"' for c, e in columns.items())
    return f"SELECT {cols} FROM events WHERE {where}"


def _private(ip: str) -> str:
    return rf"regexp_matches({ip}, '^(192\.168|10|172\.(1[6-9]|2.|3[01]))\.')"


def _number(ip: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({ip}, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') "
        f"AND greatest({', '.join(_octet(ip, i) for i in (1, 2, 3, 4))}) <= 255 THEN "
        f"{_octet(ip, 1)} * 16777216 + {_octet(ip, 2)} * 65536 + {_octet(ip, 3)} * 256 + {_octet(ip, 4)} END"
    )


def _octet(ip: str, i: int) -> str:
    return f"TRY_CAST(split_part({ip}, '.', {i}) AS BIGINT)"


BYTES = "(coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0))"
_EXTERNAL = (
    f"NOT {_private('resp_h')} AND NOT contains(resp_h, ':') AND resp_h NOT IN ('255.255.255.255', '0.0.0.0') "
    "AND NOT regexp_matches(resp_h, '^(224|239)[.]')"
)
RECENT = f"timestamp > {T} - INTERVAL 6 HOUR AND timestamp <= {T}"
TREND = f"timestamp > {T} - INTERVAL 3 DAY AND timestamp <= {T}"

CTES = {
    **{name: _typed(name) for name in A.SILVER},
    "vendors": f"SELECT {A.VENDOR_PREFIX} AS oui_prefix, s_name AS manufacturer FROM supplier",
    "ranges": f"SELECT {A.RANGE_START} AS ip_start, {A.RANGE_END} AS ip_end, {A.COUNTRY} AS country FROM nation",
    "own": f"SELECT *, orig_h AS ip, {BYTES} AS bytes FROM conn WHERE {_private('orig_h')}",
    "newest_mac": """SELECT ip, mac AS conn_mac, l AS mac_seen FROM (
        SELECT ip, mac, max(timestamp) AS l FROM own WHERE mac <> '' GROUP BY ip, mac)
        QUALIFY row_number() OVER (PARTITION BY ip ORDER BY l DESC, mac DESC) = 1""",
    "newest_lease": """SELECT assigned_addr AS ip, mac AS lease_mac, host_name AS hostname, timestamp AS leased_at FROM dhcp
        WHERE assigned_addr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY assigned_addr
            ORDER BY timestamp DESC, mac DESC NULLS LAST, host_name DESC NULLS LAST) = 1""",
    "totals": """SELECT ip, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS total_conns,
        CAST(sum(bytes) AS BIGINT) AS total_bytes, string_agg(DISTINCT proto, ', ' ORDER BY proto) AS protocols,
        string_agg(DISTINCT service, ', ' ORDER BY service) AS services FROM own GROUP BY ip""",
    "devices": """SELECT t.ip, coalesce(m.conn_mac, l.lease_mac) AS mac, v.manufacturer, l.hostname, t.first_seen,
        t.last_seen, t.total_conns, t.total_bytes, t.protocols, t.services
        FROM totals t LEFT JOIN newest_mac m ON m.ip = t.ip LEFT JOIN newest_lease l ON l.ip = t.ip
        LEFT JOIN vendors v ON v.oui_prefix = upper(replace(substr(coalesce(m.conn_mac, l.lease_mac), 1, 8), ':', ''))""",
    "ext": f"SELECT *, resp_h AS ip, CAST(resp_p AS INT) AS port, {BYTES} AS bytes FROM conn WHERE {_EXTERNAL}",
    "ext_service": """SELECT ip, service FROM (SELECT ip, service, count(*) AS n FROM ext WHERE service IS NOT NULL
        GROUP BY ip, service) QUALIFY row_number() OVER (PARTITION BY ip ORDER BY n DESC, service) = 1""",
    "ext_port": """SELECT ip, port FROM (SELECT ip, port, count(*) AS n FROM ext WHERE port IS NOT NULL
        GROUP BY ip, port) QUALIFY row_number() OVER (PARTITION BY ip ORDER BY n DESC, port) = 1""",
    "ext_totals": """SELECT ip, count(*) AS total_conns, CAST(sum(bytes) AS BIGINT) AS total_bytes,
        string_agg(DISTINCT orig_h, ', ' ORDER BY orig_h) AS contacted_by FROM ext GROUP BY ip""",
    "external_ips": f"""SELECT e.ip, r.country, e.total_conns, e.total_bytes, e.contacted_by, s.service AS top_service,
        p.port AS top_dest_port FROM ext_totals e LEFT JOIN ext_service s ON s.ip = e.ip
        LEFT JOIN ext_port p ON p.ip = e.ip LEFT JOIN ranges r ON {_number('e.ip')} BETWEEN r.ip_start AND r.ip_end""",
    "known": "SELECT ip, first_seen AS first_detected FROM devices WHERE first_seen < TIMESTAMP '2024-01-15 00:00:00'",
    "history": """SELECT CAST(src_port AS BIGINT) AS id, timestamp AS detected_at,
        CASE category WHEN 'Category 0' THEN 'suricata_alert' WHEN 'Category 1' THEN 'suspicious_country'
            WHEN 'Category 2' THEN 'device_behavior' WHEN 'Category 3' THEN 'traffic_spike' WHEN 'Category 4' THEN 'massive_volume'
            WHEN 'Category 5' THEN 'new_device' ELSE 'dest_fanout' END AS anomaly_type,
        CASE category WHEN 'Category 0' THEN signature WHEN 'Category 1' THEN dest_ip ELSE src_ip END AS dedup_key,
        'high' AS severity, 'Alert ' || signature AS summary, signature FROM alerts WHERE severity = 1""",
    "cooling": f"""SELECT DISTINCT anomaly_type, dedup_key FROM history
        WHERE detected_at > {T} - INTERVAL 8 HOUR AND detected_at <= {T}""",
    "now_stats": f"""SELECT orig_h AS ip, CAST(sum({BYTES}) AS DOUBLE) AS bytes_5min, CAST(count(*) AS DOUBLE) AS conns_5min,
        CAST(count(DISTINCT resp_h) AS DOUBLE) AS dest_ips FROM conn
        WHERE {RECENT} AND orig_h LIKE '192.168.%' GROUP BY orig_h""",
    "now_any": f"""SELECT orig_h AS ip, CAST(sum({BYTES}) AS DOUBLE) AS bytes_5min,
        CAST(count(*) AS DOUBLE) AS conns_5min, CAST(count(DISTINCT resp_h) AS DOUBLE) AS dest_ips FROM conn
        WHERE {RECENT} AND orig_h IS NOT NULL GROUP BY orig_h""",
    "windows": f"""SELECT orig_h AS ip, time_bucket(INTERVAL '6 hours', timestamp) AS window_start,
        CAST(sum({BYTES}) AS DOUBLE) AS bytes_5min, CAST(count(*) AS DOUBLE) AS conns_5min,
        CAST(count(DISTINCT resp_h) AS DOUBLE) AS dest_ips FROM conn WHERE orig_h LIKE '192.168.%' GROUP BY 1, 2""",
    "ema": f"""SELECT w.ip, any_value(d.manufacturer) AS manufacturer,
        list_reduce(list(bytes_5min ORDER BY window_start), lambda e, x: 0.3::DOUBLE * x + 0.7::DOUBLE * e) AS avg_bytes_5min,
        list_reduce(list(conns_5min ORDER BY window_start), lambda e, x: 0.3::DOUBLE * x + 0.7::DOUBLE * e) AS avg_conns_5min,
        list_reduce(list(dest_ips ORDER BY window_start), lambda e, x: 0.3::DOUBLE * x + 0.7::DOUBLE * e) AS avg_dest_ips,
        CAST(count(*) AS INT) AS samples, max(window_start) AS updated_at
        FROM windows w LEFT JOIN devices d ON d.ip = w.ip
        WHERE window_start < {T} - INTERVAL 6 HOUR GROUP BY w.ip""",
    "ema_next": f"""SELECT coalesce(e.ip, c.ip) AS ip,
        CASE WHEN c.ip IS NULL THEN e.manufacturer ELSE d.manufacturer END AS manufacturer,
        {", ".join(f"CASE WHEN c.ip IS NULL THEN {a} WHEN e.ip IS NULL THEN {n} ELSE 0.3::DOUBLE * {n} + 0.7::DOUBLE * {a} END AS {a}"
                   for n, a in (("bytes_5min", "avg_bytes_5min"), ("conns_5min", "avg_conns_5min"), ("dest_ips", "avg_dest_ips")))},
        CAST(coalesce(e.samples, 0) + CASE WHEN c.ip IS NULL THEN 0 ELSE 1 END AS INT) AS samples,
        CASE WHEN c.ip IS NULL THEN e.updated_at ELSE {T} END AS updated_at
        FROM ema e FULL JOIN now_stats c ON c.ip = e.ip LEFT JOIN devices d ON d.ip = c.ip""",
    "allowed": """SELECT assigned_addr AS ip, max(host_name) AS description, max(timestamp) AS added_at FROM dhcp
        GROUP BY assigned_addr""",
    "handled": """SELECT id AS anomaly_id, detected_at, detected_at AS processed_at, true AS delivered FROM history
        WHERE detected_at < TIMESTAMP '2024-01-20 00:00:00'""",
    "rule_docs": """SELECT doc_id, lang, source, regexp_replace(text, '[;\\r\\n]', ' ', 'g') AS meta,
        CASE doc_id % 5 WHEN 0 THEN 'trojan-activity' WHEN 1 THEN 'misc-attack' WHEN 2 THEN 'policy-violation'
            WHEN 3 THEN 'home-made' ELSE '' END AS classtype FROM documents
        WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0""",
    "rule_rows": f"""SELECT doc_id AS position, doc_id % 5000 AS sid, 'Rule about ' || lang || ' from ' || source AS msg,
        classtype, 'Suricata rule: Rule about ' || lang || ' from ' || source
          || CASE classtype {" ".join(f"WHEN '{c}' THEN '. Category: {CLASS_DESCRIPTIONS[c]}'" for c in ("trojan-activity", "misc-attack", "policy-violation"))}
             WHEN 'home-made' THEN '. Category: home-made' ELSE '' END
          || CASE WHEN trim(regexp_replace(meta, '\\s+', ' ', 'g')) = '' THEN ''
             ELSE '. Metadata: ' || trim(regexp_replace(meta, '\\s+', ' ', 'g')) END || '.' AS chunk_text
        FROM rule_docs""",
    "corpus": """SELECT vec_id AS sid, 'Rule ' || vec_id AS msg,
        CASE WHEN label % 3 = 0 THEN 'unknown' ELSE 'class-' || label END AS classtype,
        'Suricata rule: ' || vec_id || '.' AS context, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings""",
    "cells": "SELECT label, i AS pos, v[i] AS x FROM corpus, range(1, 65) r(i)",
    "centroids": """SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM cells GROUP BY 1, 2)
        GROUP BY label""",
    "scored": """SELECT z.label AS query_id, k.sid, k.msg, k.classtype, k.context,
        list_cosine_similarity(k.v, z.c) AS s FROM corpus k, centroids z""",
    "ranked": """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, sid) AS INT) AS rank,
        sid, msg, classtype, context, round(s, 4) AS similarity FROM scored""",
}

_WORD = re.compile(r"[a-z_]+")


def sql(body: str, recursive: bool = False) -> str:
    """`body` with the CTEs it needs, in dependency order."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in CTES and word not in seen:
                seen.add(word)
                visit(CTES[word])
                needed.append(word)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f'"{n}" AS ({CTES[n]})' for n in needed)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


ORACLE: dict[str, str] = {}


def _put(name: str, body: str, recursive: bool = False) -> None:
    ORACLE[name] = sql(body, recursive)


def _in(table: str, where: str = "true") -> str:
    return f"FROM {table} WHERE timestamp BETWEEN {START} AND {T} AND {where}"


def _count(name: str, table: str, where: str = "true", what: str = "*") -> None:
    _put(name, f"SELECT count({what}) AS value {_in(table, where)}")


def _top(name: str, columns: str, measure: str, rest: str, n: int) -> None:
    """`columns` is the part after SELECT; NULLs sort first among ties, as they do in Spark."""
    ties = ", ".join(f"{c.strip()} NULLS FIRST" for c in rest.split(","))
    _put(name, f"SELECT {columns} ORDER BY {measure} DESC NULLS LAST, {ties} LIMIT {n}")


EVE = "source_tool = 'suricata'"
LABEL = "CASE severity WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' ELSE 'Unknown' END"
BUCKET = "time_bucket(INTERVAL '5 minutes', timestamp)"
SUM_BYTES = f"CAST(sum({BYTES}) AS BIGINT)"


def _mask(c: str) -> str:
    return f"regexp_replace(coalesce({c}, 'N/A'), '[0-9a-fA-F]', '*', 'g')"


# --- panels: overview and alerts
_put("panel_overview_total_events",
     f"SELECT count(*) AS value FROM activity WHERE timestamp > {T} - INTERVAL 24 HOUR AND timestamp <= {T}")
for _n in ("panel_overview_alerts", "panel_alerts_total", "panel_alerts_total_stored"):
    _count(_n, "alerts")
_count("panel_overview_unique_sources", "activity", what="DISTINCT src_ip")
_count("panel_overview_unique_destinations", "activity", what="DISTINCT dest_ip")
_put("panel_overview_events_over_time",
     f"SELECT {BUCKET} AS time, source_tool, count(*) AS count {_in('activity')} GROUP BY 1, 2")
_top("panel_overview_event_types", f"event_class AS event_type, count(*) AS count {_in('activity')} GROUP BY 1",
     "count", "event_type", 15)
for _n in ("panel_overview_protocols", "panel_traffic_protocols"):
    _top(_n, f"lower(proto) AS protocol, count(*) AS count {_in('activity', 'proto IS NOT NULL')} GROUP BY 1",
         "count", "protocol", 10)
_put("panel_overview_source_split", f"SELECT source_tool, count(*) AS count {_in('activity')} GROUP BY 1")
_put("panel_overview_internal_devices",
     f"SELECT ip, {_mask('mac')} AS mac, '***' AS manufacturer, '***' AS hostname, total_conns, total_bytes FROM devices")
_put("panel_overview_external_ips",
     "SELECT ip, country, total_conns, total_bytes, contacted_by, top_service FROM external_ips")
_count("panel_alerts_high_severity", "alerts", "severity = 1")
_count("panel_alerts_unique_signatures", "alerts", what="DISTINCT signature")
_put("panel_alerts_severity_distribution", f"SELECT {LABEL} AS severity, count(*) AS count {_in('alerts')} GROUP BY 1")
_top("panel_alerts_top_signatures", f"signature, category, severity, count(*) AS count {_in('alerts')} GROUP BY ALL",
     "count", "signature, category, severity", 10)
_put("panel_alerts_timeline", f"SELECT {BUCKET} AS time, {LABEL} AS severity, count(*) AS count {_in('alerts')} GROUP BY 1, 2")
_top("panel_alerts_top_sources", f"src_ip AS source_ip, count(*) AS alerts {_in('alerts')} GROUP BY 1", "alerts", "source_ip", 10)
_top("panel_alerts_top_destinations", f"dest_ip, count(*) AS alerts {_in('alerts')} GROUP BY 1", "alerts", "dest_ip", 10)
_top("panel_alerts_recent", f"timestamp, signature, severity, src_ip, dest_ip, dest_port, proto {_in('alerts')}",
     "timestamp", "signature, severity, src_ip, dest_ip, dest_port, proto", 50)

# --- panels: traffic
for _n in ("panel_traffic_connections", "panel_map_connections"):
    _count(_n, "conn")
for _n in ("panel_traffic_bytes", "panel_map_bytes"):
    _put(_n, f"SELECT {SUM_BYTES} AS value {_in('conn')}")
_count("panel_traffic_unique_protocols", "activity", what="DISTINCT lower(proto)")
_put("panel_traffic_volume_over_time",
     f"SELECT {BUCKET} AS time, proto AS protocol, {SUM_BYTES} AS bytes {_in('conn')} GROUP BY 1, 2")
_top("panel_traffic_top_sources", f"orig_h AS source_ip, count(*) AS connections {_in('conn')} GROUP BY 1",
     "connections", "source_ip", 10)
_top("panel_traffic_top_destinations", f"resp_h AS dest_ip, count(*) AS connections {_in('conn')} GROUP BY 1",
     "connections", "dest_ip", 10)
_top("panel_traffic_top_ports", f"resp_p AS dest_port, count(*) AS connections {_in('conn')} GROUP BY 1",
     "connections", "dest_port", 10)
_top("panel_traffic_recent_connections",
     f"timestamp, orig_h AS src_ip, resp_h AS dest_ip, resp_p AS dest_port, proto, service, community_id, "
     f"conn_state AS state {_in('conn')}",
     "timestamp", "src_ip, dest_ip, dest_port, proto, service, community_id, state", 50)

# --- panels: dns and threats
NX = f"{EVE} AND rcode = 'NXDOMAIN'"
_count("panel_dns_total", "dns")
_count("panel_dns_unique_domains", "dns", what="DISTINCT domain")
_count("panel_dns_nxdomain_count", "dns", NX)
_put("panel_dns_over_time", f"SELECT {BUCKET} AS time, source_tool, count(*) AS count {_in('dns')} GROUP BY 1, 2")
_top("panel_dns_top_domains", f"domain, count(*) AS queries {_in('dns')} GROUP BY 1", "queries", "domain", 20)
_put("panel_dns_query_types", f"SELECT query_type, count(*) AS count {_in('dns')} GROUP BY 1")
_top("panel_dns_nxdomain_domains", f"rrname AS domain, src_ip AS querier, count(*) AS count {_in('dns', NX)} GROUP BY 1, 2",
     "count", "domain, querier", 20)
_ANOMALY = f"{EVE} AND event_type = 'anomaly'"
_count("panel_threats_anomaly_count", "activity", _ANOMALY)
_count("panel_threats_tls_events", "tls")
_count("panel_threats_unique_ja3", "tls", EVE, "DISTINCT ja3_hash")
_put("panel_threats_anomaly_timeline", f"SELECT {BUCKET} AS time, count(*) AS anomalies {_in('activity', _ANOMALY)} GROUP BY 1")
_put("panel_threats_tls_versions", f"SELECT tls_version, count(*) AS count {_in('tls')} GROUP BY 1")
_FLOWS = """a.timestamp AS alert_time, a.signature AS alert_signature, a.severity, a.src_ip, a.dest_ip, a.community_id,
    c.duration AS zeek_duration, c.orig_bytes AS zeek_orig_bytes, c.resp_bytes AS zeek_resp_bytes,
    c.conn_state AS zeek_conn_state FROM alerts a LEFT JOIN conn c ON c.community_id = a.community_id"""
_top("panel_threats_alert_flow_correlation", _FLOWS, "alert_time",
     "alert_signature, a.severity, a.src_ip, a.dest_ip, a.community_id, zeek_duration, zeek_orig_bytes, "
     "zeek_resp_bytes, zeek_conn_state", 50)
_top("panel_threats_top_sni",
     f"sni, eve_version AS version, count(*) AS count {_in('tls', EVE + ' AND sni IS NOT NULL')} GROUP BY 1, 2",
     "count", "sni, version", 20)
_top("panel_threats_top_ja3",
     f"ja3_hash, sni AS sample_sni, count(*) AS count {_in('tls', EVE + ' AND ja3_hash IS NOT NULL')} GROUP BY 1, 2",
     "count", "ja3_hash, sample_sni", 20)

# --- panels: nodes
_put("panel_nodes_internal_ips", "SELECT count(*) AS value FROM devices")
for _n in ("panel_nodes_external_ips", "panel_geo_unique_external_ips"):
    _put(_n, "SELECT count(*) AS value FROM external_ips")
_count("panel_nodes_dhcp_assignments", "dhcp")
_put("panel_nodes_new_ips_over_time",
     f"SELECT time_bucket(INTERVAL '1 hour', f) AS time, count(*) AS new_ips FROM "
     f"(SELECT src_ip, min(timestamp) AS f {_in('activity', 'src_ip IS NOT NULL')} GROUP BY 1) GROUP BY 1")
_put("panel_nodes_traffic_direction",
     f"SELECT CASE WHEN dest_ip LIKE '192.168.%' THEN 'Internal' ELSE 'External' END AS direction, count(*) AS count "
     f"{_in('activity', 'dest_ip IS NOT NULL')} GROUP BY 1")
_put("panel_nodes_device_inventory",
     f"SELECT ip, {_mask('mac')} AS mac, '***' AS manufacturer, '***' AS hostname, total_conns, total_bytes, protocols, "
     f"services FROM devices ORDER BY total_conns DESC, ip LIMIT 50")
_put("panel_nodes_device_inventory_shown",
     "SELECT ip, mac, coalesce(manufacturer, 'Unknown') AS manufacturer, coalesce(hostname, 'N/A') AS hostname, "
     "total_conns, total_bytes, protocols, services FROM devices ORDER BY total_conns DESC, ip LIMIT 50")
_put("panel_nodes_noisiest_devices",
     "SELECT ip AS device, total_conns, total_bytes FROM devices ORDER BY total_bytes DESC, ip LIMIT 5")
_put("panel_nodes_noisiest_devices_shown",
     "SELECT coalesce(manufacturer, 'Unknown') || ' (' || ip || ')' AS device, total_conns, total_bytes FROM devices "
     "ORDER BY total_bytes DESC, device LIMIT 5")
_put("panel_nodes_by_manufacturer", "SELECT '***' AS manufacturer, count(*) AS count FROM devices GROUP BY 1")
_put("panel_nodes_by_manufacturer_shown",
     "SELECT coalesce(manufacturer, 'Unknown') AS manufacturer, count(*) AS count FROM devices GROUP BY 1")
for _n, _m in (("panel_nodes_dhcp_leases", _mask("mac")), ("panel_nodes_dhcp_leases_shown", "mac")):
    _top(_n, f"timestamp, assigned_addr AS assigned_ip, {_m} AS mac_address, server_addr AS dhcp_server, domain, "
             f"lease_time AS lease_seconds {_in('dhcp')}",
         "timestamp", "assigned_ip, mac_address, dhcp_server, domain, lease_seconds", 50)

# --- panels: one device
_DEV = f"FROM devices WHERE ip = '{DEVICE}'"
for _n, _e in {
    "ip": "ip", "mac": _mask("mac"), "mac_shown": "coalesce(mac, 'N/A')", "manufacturer": "'***'",
    "manufacturer_shown": "coalesce(manufacturer, 'Unknown')", "hostname": "'***'",
    "hostname_shown": "coalesce(hostname, 'N/A')", "total_connections": "total_conns", "total_bytes": "total_bytes",
}.items():
    _put(f"panel_device_{_n}", f"SELECT {_e} AS value {_DEV}")
_OF = f"orig_h = '{DEVICE}'"
_put("panel_device_traffic_over_time",
     f"SELECT time_bucket(INTERVAL '1 minute', timestamp) AS time, count(*) AS connections, {SUM_BYTES} AS bytes "
     f"{_in('conn', _OF)} GROUP BY 1")
_put("panel_device_services", f"SELECT coalesce(service, 'unknown') AS service, count(*) AS count {_in('conn', _OF)} GROUP BY 1")
_LAN10 = "(resp_h LIKE '192.168.%' OR resp_h LIKE '10.%')"
_top("panel_device_external_destinations",
     f"d.dest_ip, x.country, d.port, d.service, d.connections, d.bytes FROM (SELECT resp_h AS dest_ip, "
     f"CAST(resp_p AS INT) AS port, service, count(*) AS connections, {SUM_BYTES} AS bytes "
     f"{_in('conn', _OF + ' AND NOT ' + _LAN10)} GROUP BY 1, 2, 3) d LEFT JOIN external_ips x ON x.ip = d.dest_ip",
     "connections", "d.dest_ip, x.country, d.port, d.service, d.bytes", 30)
_top("panel_device_internal_destinations",
     f"resp_h AS dest_ip, CAST(resp_p AS INT) AS port, service, count(*) AS connections "
     f"{_in('conn', _OF + ' AND ' + _LAN10)} GROUP BY 1, 2, 3",
     "connections", "dest_ip, port, service", 30)
_top("panel_device_recent_connections",
     f"timestamp, resp_h AS dest_ip, CAST(resp_p AS INT) AS port, proto, service, duration, coalesce(orig_bytes, 0) AS "
     f"orig_bytes, coalesce(resp_bytes, 0) AS resp_bytes, conn_state AS state {_in('conn', _OF)}",
     "timestamp", "dest_ip, port, proto, service, duration", 50)
_put("panel_device_selector", "SELECT ip FROM devices")

# --- panels: countries and map
_put("panel_geo_unique_countries", "SELECT count(DISTINCT country) AS value FROM external_ips")
_put("panel_geo_external_bytes", "SELECT CAST(coalesce(sum(total_bytes), 0) AS BIGINT) AS value FROM external_ips")
_put("panel_geo_external_connections", "SELECT CAST(coalesce(sum(total_conns), 0) AS BIGINT) AS value FROM external_ips")
for _n, _m, _a in (("connections", "total_conns", "connections"), ("bytes", "total_bytes", "bytes")):
    _top(f"panel_geo_countries_by_{_n}",
         f"coalesce(country, '??') AS country, CAST(sum({_m}) AS BIGINT) AS {_a} FROM external_ips GROUP BY 1",
         _a, "1", 15)
_put("panel_geo_top_external_ips",
     "SELECT ip, coalesce(country, '??') AS country, total_conns AS connections, total_bytes AS bytes, contacted_by AS "
     "internal_clients, top_service AS service, top_dest_port AS port FROM external_ips ORDER BY total_conns DESC, ip LIMIT 20")
_top("panel_geo_unsolicited_inbound",
     f"s.source_ip, x.country, s.dest_ip, s.dest_port, s.service, s.proto, s.connections FROM (SELECT orig_h AS source_ip, "
     f"resp_h AS dest_ip, CAST(resp_p AS INT) AS dest_port, service, proto, count(*) AS connections "
     f"{_in('conn', 'NOT ' + _private('orig_h') + ' AND NOT starts_with(orig_h, ' + chr(39) + 'fe80:' + chr(39) + ') AND ' + _LAN10)} "
     f"GROUP BY ALL) s LEFT JOIN external_ips x ON x.ip = s.source_ip",
     "s.connections", "s.source_ip, x.country, s.dest_ip, s.dest_port, s.service, s.proto", 30)
_put("panel_map_unique_devices",
     f"SELECT count(DISTINCT ip) AS value FROM (SELECT orig_h AS ip {_in('conn')} UNION SELECT resp_h {_in('conn')})")
_put("panel_map_unique_pairs", f"SELECT count(*) AS value FROM (SELECT DISTINCT orig_h, resp_h {_in('conn')})")
_INNER = " AND ".join(f"regexp_matches({c}, '^(192[.]168|10|172[.]16)[.]')" for c in ("orig_h", "resp_h"))
for _sfx, _w, _min_fan, _min_pair in (("", _INNER, 1, 1), ("_all", "true", 5, 2)):
    _top(f"panel_map_top_senders{_sfx}",
         f"orig_h AS device, count(DISTINCT resp_h) AS unique_destinations, count(*) AS total_connections "
         f"{_in('conn', _w)} GROUP BY 1 HAVING count(*) >= {_min_fan}",
         "unique_destinations", "device, total_connections", 15)
    _top(f"panel_map_top_destinations{_sfx}",
         f"resp_h AS destination, count(DISTINCT orig_h) AS unique_sources, count(*) AS total_connections "
         f"{_in('conn', _w)} GROUP BY 1 HAVING count(*) >= {_min_fan}",
         "unique_sources", "destination, total_connections", 15)
    _top(f"panel_map_top_pairs{_sfx}",
         f"orig_h || ' -> ' || resp_h AS pair, count(*) AS connections, {SUM_BYTES} AS bytes {_in('conn', _w)} "
         f"GROUP BY orig_h, resp_h HAVING count(*) >= {_min_pair}",
         "bytes", "pair, connections", 20)
_LABELS = f"""SELECT orig_h AS src_ip, resp_h AS dst_ip, coalesce(service, resp_p) AS label, count(*) AS n,
    {SUM_BYTES} AS b {_in('conn')} GROUP BY 1, 2, 3"""
_PAIRS = f"""SELECT src_ip, dst_ip, CAST(sum(n) AS BIGINT) AS connections, CAST(sum(b) AS BIGINT) AS bytes,
    first(label ORDER BY n DESC, label) FILTER (label IS NOT NULL) AS top_service FROM ({_LABELS}) GROUP BY 1, 2"""
for _sfx, _s, _d in (
    ("", "'***'", "coalesce(x.country, '***')"),
    ("_shown", "coalesce(s.manufacturer, '')", "coalesce(d.manufacturer, x.country, '')"),
):
    _top(f"panel_map_connection_details{_sfx}",
         f"p.src_ip, {_s} AS src_manufacturer, p.dst_ip, {_d} AS dst_info, p.connections, p.bytes, p.top_service "
         f"FROM ({_PAIRS}) p LEFT JOIN devices s ON s.ip = p.src_ip LEFT JOIN devices d ON d.ip = p.dst_ip "
         f"LEFT JOIN external_ips x ON x.ip = p.dst_ip",
         "p.connections", "p.src_ip, src_manufacturer, p.dst_ip, dst_info, p.bytes, p.top_service", 50)

# --- sources
for _n in A.SILVER:
    _put(f"silver_{_n}", f"SELECT * FROM {_n}")
    _put(f"silver_{_n}_from_variant", f"SELECT * FROM {_n}")
_put("source_staged_events", f"""
    SELECT source_tool, log_type, count(*) AS rows, count(*) FILTER (second(timestamp) = 14) AS untimed,
        count(DISTINCT strftime(timestamp, '%Y-%m-%d-%H')) AS files, max(timestamp) FILTER (second(timestamp) <> 14) AS newest
    FROM activity WHERE second(timestamp) <> 13 GROUP BY 1, 2""")
_put("source_sensor_logs", f"""
    SELECT CASE WHEN {A.IS_EVE} THEN ts ELSE date_trunc('second', ts) END AS timestamp,
        {A.TOOL} AS source_tool, {A.LOG} AS log_type FROM events
    WHERE {A.IS_EVE} OR event_id % 7 NOT IN (0, 1)""")
_HOURS = "SELECT source_tool, log_type, strftime(timestamp, '%Y-%m-%d-%H') AS event_hour, count(*) AS rows FROM activity"
_put("source_hourly_layout", f"{_HOURS} GROUP BY 1, 2, 3")
_put("sink_hourly_roundtrip", f"{_HOURS.replace('%Y-%m-%d-%H', '2024-01-01-%H')} GROUP BY 1, 2, 3")
_put("sink_partitioned_rewrite", "SELECT proto, count(*) AS rows, CAST(sum(orig_bytes) AS BIGINT) AS bytes FROM conn WHERE proto <> 'udp' GROUP BY 1")
_put("anomaly_texts", """SELECT CAST(src_port AS BIGINT) AS id, '[IDS FAST ALERT] New Device: ' || src_ip AS subject,
    'New device detected on the network.' || chr(10) || chr(10) || 'IP Address:  ' || src_ip || chr(10) || 'MAC Address: '
      || CASE WHEN CAST(src_port AS BIGINT) % 3 = 0 THEN dest_ip ELSE 'unknown' END || chr(10) || 'Detected At: ' || strftime(timestamp, '%Y-%m-%d %H:%M:%S')
      || chr(10) || chr(10) || 'This is an automated fast alert.' || chr(10) || 'A detailed LLM analysis email will follow shortly.' AS body
    FROM alerts WHERE severity = 1""")
_put("sink_parquet_roundtrip", "SELECT * FROM devices")
_put("source_vendor_table", """
    SELECT oui_prefix, least(manufacturer, 'Reseller of ' || manufacturer) AS manufacturer FROM vendors""")
_put("source_range_table", "SELECT ip_start, ip_end, upper(country) AS country FROM ranges")
_put("source_vendor_csv", "SELECT oui_prefix, least(manufacturer, 'Reseller of ' || manufacturer) AS manufacturer FROM vendors")
_put("source_range_csv", "SELECT ip_start, ip_end, upper(country) AS country FROM ranges")
_put("rules_from_files", "SELECT sid, msg, classtype, chunk_text FROM rule_rows")
_put("rules_parse", "SELECT position, sid, msg, classtype, chunk_text FROM rule_rows")
_put("rules_latest_per_sid", """SELECT sid, msg, classtype, chunk_text FROM rule_rows
    QUALIFY row_number() OVER (PARTITION BY sid ORDER BY position DESC) = 1""")
_put("rules_stale_index", """SELECT '2024-01-31 00:00:00' AS rules_mtime, '2024-01-30 00:00:00' AS indexed_mtime,
    true AS stale, count(DISTINCT sid) AS rule_count FROM rule_rows""")
_LAST_RULE = "QUALIFY row_number() OVER (PARTITION BY sid ORDER BY position DESC) = 1"
_put("rules_rebuild", f"""
    SELECT reader, embedded_by, count(*) AS rules, CAST(sum(length(chunk_text)) AS BIGINT) AS characters FROM (
        SELECT 'old' AS reader, 1 AS embedded_by, chunk_text FROM (SELECT * FROM rule_rows {_LAST_RULE})
        UNION ALL
        SELECT 'new', CASE WHEN chunk_text IN (SELECT chunk_text FROM (SELECT * FROM rule_rows {_LAST_RULE})) THEN 1 ELSE 2 END, chunk_text
        FROM (SELECT sid, CASE WHEN position % 7 = 0 THEN replace(chunk_text, 'Rule about', 'New rule about') ELSE chunk_text END AS chunk_text
              FROM rule_rows WHERE position % 9 <> 0 {_LAST_RULE}))
    GROUP BY 1, 2""")
_put("rules_embed_batches", f"""
    SELECT sid, CASE WHEN length(chunk_text) % 11 <> 0 THEN CAST(length(chunk_text) AS INT) END AS length,
        CASE WHEN length(chunk_text) % 11 = 0 THEN 'ValueError: a text of this length is refused' END AS embedding_error
    FROM (SELECT * FROM rule_rows {_LAST_RULE})""")
_put("rules_term_vectors", """SELECT DISTINCT sid, 256 AS dims, CAST(1.0 AS DOUBLE) AS length FROM rule_rows""")
_TARGET = "'10.0.' || (o_custkey % 256) || '.0/24'"
_put("scan_json_ports", f"""
    SELECT o_orderkey AS id, {_TARGET} AS target,
        CASE WHEN o_orderstatus = 'F' THEN 'scheduled_service' ELSE 'quick' END AS scan_type,
        '10.0.' || (l_suppkey % 256) || '.' || l_linenumber AS ip, 'host' || l_suppkey AS hostname,
        CASE WHEN l_linestatus = 'O' THEN 'up' WHEN l_orderkey IS NOT NULL THEN 'down' END AS host_state,
        CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey % 65536 AS INT) END AS port,
        CASE WHEN l_returnflag <> 'R' THEN 'tcp' END AS protocol, CASE WHEN l_returnflag <> 'R' THEN 'open' END AS port_state,
        CASE WHEN l_returnflag <> 'R' THEN 'svc' || (l_partkey % 9) END AS service,
        CASE WHEN l_returnflag <> 'R' THEN '1.0' END AS version, CASE WHEN l_returnflag <> 'R' THEN '' END AS product
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderkey % 7 <> 0""")
_put("scan_xml_documents", """
    SELECT c_custkey AS id, CAST(2 AS INT) AS host_count, '10.0.0.' || (c_custkey % 250) AS ip, c_name AS hostname,
        CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'up' END AS state,
        '[{"port":' || (c_nationkey + 20) || ',"protocol":"tcp","state":"open"},{"port":53,"protocol":"udp",'
        || '"state":"closed","service":"dns","version":"","product":"d"}]' AS ports
    FROM customer WHERE c_custkey % 10 <> 9
    UNION ALL SELECT c_custkey, 2, 'unknown', '', 'unknown', '[]' FROM customer WHERE c_custkey % 10 <> 9
    UNION ALL SELECT c_custkey, 0, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 10 = 9""")

# --- functions
_put("function_ip_tests", f"""
    SELECT ip, {_number('ip')} AS number, {_private('ip')} AS private,
        NOT {_private('ip')} AND ip NOT LIKE '%:%' AND ip NOT IN ('255.255.255.255', '0.0.0.0')
            AND ip NOT LIKE '224.%' AND ip NOT LIKE '239.%' AS external,
        coalesce(regexp_matches(ip, '^(10|192[.]168|172[.](1[6-9]|2[0-9]|3[01]))[.]') AND ip NOT LIKE '%:%', false) AS private_host,
        ip LIKE '192.168.%' AS home_lan, ip LIKE '192.168.%' OR ip LIKE '10.%' AS lan_or_ten,
        ip LIKE '192.168.%' OR ip LIKE '10.%' OR ip LIKE '172.16.%' AS map_internal,
        NOT {_private('ip')} AND ip NOT LIKE 'fe80:%' AS outside_source
    FROM (SELECT src_ip AS ip FROM activity UNION SELECT dest_ip FROM activity)""")
_put("function_ip_to_long_sql", f"SELECT DISTINCT dest_ip AS ip, {_number('dest_ip')} AS number FROM activity")
_put("function_scan_scope", f"""
    SELECT target, coalesce(a IS NOT NULL AND len <= 32 AND (
        (lo >= 167772160 AND hi <= 184549375) OR (lo >= 2886729728 AND hi <= 2887778303)
        OR (lo >= 3232235520 AND hi <= 3232301055)), false) AS in_scope FROM (
        SELECT *, a - a % size AS lo, a - a % size + size - 1 AS hi FROM (
            SELECT *, CAST(pow(2, 32 - least(len, 32)) AS BIGINT) AS size FROM (
                SELECT target, {_number("split_part(target, '/', 1)")} AS a, CAST(split_part(target, '/', 2) AS INT) AS len
                FROM (SELECT DISTINCT orig_h || '/' || (length(uid) * 3 + length(orig_h)) AS target FROM conn))))""")
_put("function_text_forms", f"""
    SELECT timestamp, mac, upper(substr(mac, 1, 2) || substr(mac, 4, 2) || substr(mac, 7, 2)) AS prefix,
        {_mask('mac')} AS masked FROM dhcp""")
_put("function_json_numbers", "SELECT uid, resp_bytes, CAST(resp_p AS INT) AS port FROM conn")

# --- joins
_put("join_vendor", """SELECT timestamp, assigned_addr, mac, manufacturer FROM dhcp
    LEFT JOIN vendors ON oui_prefix = upper(replace(substr(mac, 1, 8), ':', ''))""")
_put("join_ip_range", f"""SELECT ip, country FROM (SELECT DISTINCT resp_h AS ip FROM conn WHERE resp_h IS NOT NULL)
    LEFT JOIN ranges ON {_number('ip')} BETWEEN ip_start AND ip_end""")
_put("join_event_country", f"""SELECT uid, resp_h, country FROM conn
    LEFT JOIN ranges ON {_number('resp_h')} BETWEEN ip_start AND ip_end""")
_put("join_alerts_with_flows", f"SELECT {_FLOWS}")
_put("join_known_devices_anti", "SELECT ip, first_seen FROM devices WHERE ip NOT IN (SELECT ip FROM known)")
_put("join_latest_mac_and_lease", """SELECT coalesce(m.ip, l.ip) AS ip, conn_mac, mac_seen, lease_mac, hostname, leased_at
    FROM newest_mac m FULL JOIN newest_lease l ON l.ip = m.ip""")

# --- summaries and baselines
for _n in ("device_inventory", "device_inventory_from_raw"):
    _put(_n, "SELECT * FROM devices")
_put("external_inventory", "SELECT * FROM external_ips")
_put("connection_stats_by_mac", """SELECT ip, mac, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
    count(*) AS total_conns, CAST(sum(bytes) AS BIGINT) AS total_bytes,
    string_agg(DISTINCT proto, ', ' ORDER BY proto) AS protocols,
    string_agg(DISTINCT service, ', ' ORDER BY service) AS services FROM own GROUP BY ip, mac""")
_put("connection_totals_by_ip", "SELECT * FROM totals")
_put("baseline_recent_stats", "SELECT * FROM now_stats")
_put("baseline_window_stats", "SELECT * FROM windows")
_put("baseline_sketched_destinations", "SELECT ip, window_start, bytes_5min, conns_5min, dest_ips AS exact, true AS within_error FROM windows")
NUDGE = "3.14159e-8::DOUBLE"
_AVERAGES = ", ".join(f"round({a} + {NUDGE}, 6) AS {a}" for a in ("avg_bytes_5min", "avg_conns_5min", "avg_dest_ips"))
_put("baseline_replay", f"SELECT ip, manufacturer, {_AVERAGES}, samples, updated_at FROM ema")
_put("baseline_update", f"SELECT ip, manufacturer, {_AVERAGES}, samples, updated_at FROM ema_next")


# --- cycles over staged files, and stored tables
_put("cycle_two_runs", "SELECT * FROM devices")
_put("cycle_external_hosts", "SELECT * FROM external_ips")
_put("cycle_drained", """SELECT CAST(CASE WHEN assigned_addr LIKE '%1' THEN 1 ELSE 2 END AS INT) AS cycle, assigned_addr AS ip,
    'new_device' AS anomaly_type, true AS registered FROM dhcp WHERE assigned_addr IS NOT NULL GROUP BY assigned_addr""")
_put("cycle_retention", " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS rows, min(timestamp) AS oldest FROM {t} WHERE timestamp >= {T} - INTERVAL 163 HOUR"
    for n, t in (("events", "activity"), *((n, n) for n in A.SILVER))))
_put("baseline_recent_stats_stored", "SELECT * FROM now_stats")
_put("external_clients", """SELECT ip, orig_h AS client, count(*) AS conns, CAST(sum(bytes) AS BIGINT) AS bytes
    FROM ext WHERE orig_h IS NOT NULL GROUP BY 1, 2""")
ORACLE["join_alerts_with_flows_stored"] = ORACLE["panel_threats_alert_flow_correlation"]
_put("upkeep_bucketed_upsert", """SELECT ip, CASE WHEN ip LIKE '%1' THEN description WHEN ip LIKE '%5' THEN 'inserted' ELSE 'replaced' END AS description,
    added_at FROM allowed WHERE ip LIKE '%1' OR ip LIKE '%2' OR ip LIKE '%4' OR ip LIKE '%5'""")
ORACLE["panel_threats_top_sni_stored"] = ORACLE["panel_threats_top_sni"]

# --- detectors
def _cool(kind: str, key: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM cooling k WHERE k.anomaly_type = '{kind}' AND k.dedup_key = {key})"


def _none_of(kind: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM history h WHERE h.anomaly_type = '{kind}' AND h.detected_at > {T} - INTERVAL 1 HOUR AND h.detected_at <= {T})"


_PARTS: dict[str, tuple[str, str]] = {}
_PARTS["detect_new_devices"] = (f"""SELECT 'new_device' AS anomaly_type, ip AS dedup_key, 'medium' AS severity,
    'New device ' || ip || ' (' || coalesce(manufacturer, 'Unknown manufacturer') || ') appeared on the network' AS summary,
    {T} AS detected_at""", """ip AS d_ip, mac AS d_mac, manufacturer AS d_manufacturer, hostname AS d_hostname,
    first_seen AS d_first_seen, total_conns AS d_total_conns FROM devices WHERE ip NOT IN (SELECT ip FROM known)""")
_TALKERS = f"""(SELECT '[' || string_agg('{{' || coalesce('"ip":"' || ip || '",', '') || '"conns":' || n || '}}', ',' ORDER BY n DESC, ip NULLS FIRST) || ']'
    FROM (SELECT orig_h AS ip, count(*) AS n FROM conn WHERE {RECENT} GROUP BY 1 ORDER BY n DESC, ip NULLS FIRST LIMIT 5))"""
_PARTS["detect_traffic_spike"] = (f"""SELECT 'traffic_spike' AS anomaly_type, 'network' AS dedup_key, 'high' AS severity,
    'Traffic spike: ' || cur || ' connections in 5 min (' || printf('%.1f', round_even(cur / average, 1)) || 'x above average)' AS summary,
    {T} AS detected_at""", f"""cur AS d_current_5min_conns, round_even(average, 1) AS d_hourly_avg_5min,
    round_even(cur / average, 1) AS d_ratio, {_TALKERS} AS d_top_talkers
    FROM (SELECT count(*) FILTER ({RECENT}) AS cur, count(*) / 12.0::DOUBLE AS average FROM conn WHERE {TREND})
    WHERE cur >= 10 AND average > 1 AND cur > 0.5 * average AND {_none_of('traffic_spike')}""")
_GROUPS = f"""SELECT signature, category, src_ip, dest_ip, min(severity) AS severity, count(*) AS count,
    min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM alerts WHERE severity <= 2 AND {RECENT} GROUP BY ALL"""
_put("alert_groups", _GROUPS)
_PARTS["detect_severe_alerts"] = (f"""SELECT 'suricata_alert' AS anomaly_type, signature AS dedup_key,
    CASE WHEN severity = 1 THEN 'critical' ELSE 'high' END AS severity,
    'Suricata alert: ' || signature || ' (' || coalesce(src_ip, 'None') || ' → ' || coalesce(dest_ip, 'None') || ', ' || count || ' hits)' AS summary,
    {T} AS detected_at""", f"""signature AS d_signature, category AS d_category, src_ip AS d_src_ip, dest_ip AS d_dest_ip,
    count AS d_count, first_seen AS d_first_seen, last_seen AS d_last_seen FROM (SELECT * FROM ({_GROUPS}) g
    WHERE {_cool('suricata_alert', 'g.signature')} QUALIFY row_number() OVER (PARTITION BY signature
        ORDER BY count DESC, src_ip NULLS FIRST, dest_ip NULLS FIRST, category) = 1)""")
_PARTS["detect_watched_countries"] = (f"""SELECT 'suspicious_country' AS anomaly_type, ip AS dedup_key, 'high' AS severity,
    'Traffic to suspicious country: ' || ip || ' (' || country || ') — ' || total_conns || ' connections' AS summary,
    {T} AS detected_at""", f"""ip AS d_ip, country AS d_country, total_conns AS d_total_conns, total_bytes AS d_total_bytes,
    contacted_by AS d_contacted_by, top_service AS d_top_service FROM (SELECT * FROM external_ips
        WHERE country IN ('CN', 'RU', 'KP', 'IR', 'BY')) x
    WHERE {_cool('suspicious_country', 'x.ip')}""")
_PARTS["detect_massive_volume"] = (f"""SELECT 'massive_volume' AS anomaly_type, ip AS dedup_key, 'high' AS severity,
    'Massive data transfer: ' || coalesce(ip, 'None') || ' moved ' || printf('%.1f', round_even(total_bytes / 1048576.0::DOUBLE, 1))
      || ' MB in 5 minutes (' || connections || ' connections)' AS summary, {T} AS detected_at""",
    f"""ip AS d_ip, total_bytes AS d_total_bytes, round_even(total_bytes / 1048576.0::DOUBLE, 1) AS d_total_mb,
    connections AS d_connections FROM (SELECT orig_h AS ip, {SUM_BYTES} AS total_bytes, count(*) AS connections
        FROM conn WHERE {RECENT} GROUP BY 1 HAVING sum({BYTES}) > 0)
    WHERE {_none_of('massive_volume')}""")


def _behavior(table: str) -> tuple[str, str]:
    scored = f"""SELECT b.*, c.bytes_5min, c.conns_5min, c.bytes_5min / greatest(b.avg_bytes_5min, 1) AS br,
        c.conns_5min / greatest(b.avg_conns_5min, 1) AS cr FROM {table} b JOIN now_any c ON c.ip = b.ip
        WHERE b.samples >= 3 AND b.avg_bytes_5min > 0 AND c.bytes_5min <> 0"""
    return (f"""SELECT 'device_behavior' AS anomaly_type, ip AS dedup_key, 'high' AS severity,
        'Unusual behavior from ' || ip || ' (' || coalesce(manufacturer, 'Unknown') || '): '
          || CASE WHEN br >= cr THEN 'bytes' ELSE 'connections' END || ' ' || printf('%.1f', round_even(greatest(br, cr), 1))
          || 'x above baseline' AS summary, {T} AS detected_at""",
            f"""ip AS d_ip, manufacturer AS d_manufacturer, CAST(bytes_5min AS BIGINT) AS d_current_bytes_5min,
        round_even(bytes_5min / 1048576, 2) AS d_current_mb, CAST(round_even(avg_bytes_5min, 0) AS BIGINT) AS d_baseline_bytes_5min,
        round_even(avg_bytes_5min / 1048576, 2) AS d_baseline_mb, round_even(br, 1) AS d_bytes_ratio,
        CAST(conns_5min AS BIGINT) AS d_current_conns_5min, CAST(round_even(avg_conns_5min, 0) AS BIGINT) AS d_baseline_conns_5min,
        round_even(cr, 1) AS d_conns_ratio, samples AS d_baseline_samples FROM ({scored}) s
        WHERE greatest(br, cr) >= 1.5 AND {_cool('device_behavior', 's.ip')}""")


def _fanout(table: str) -> tuple[str, str]:
    return (f"""SELECT 'dest_fanout' AS anomaly_type, ip AS dedup_key, 'high' AS severity,
        'Unusual destination fan-out from ' || ip || ' (' || coalesce(manufacturer, 'Unknown') || '): '
          || CAST(dest_ips AS BIGINT) || ' unique IPs (' || printf('%.1f', round_even(r, 1)) || 'x above baseline)' AS summary,
        {T} AS detected_at""",
            f"""ip AS d_ip, manufacturer AS d_manufacturer, CAST(dest_ips AS BIGINT) AS d_current_dest_ips,
        round_even(avg_dest_ips, 1) AS d_baseline_dest_ips, round_even(r, 1) AS d_ratio, samples AS d_baseline_samples
        FROM (SELECT b.*, c.dest_ips, c.dest_ips / greatest(b.avg_dest_ips, 1) AS r FROM {table} b
            JOIN now_any c ON c.ip = b.ip WHERE b.samples >= 3 AND b.avg_dest_ips > 0 AND c.dest_ips >= 2) s
        WHERE r >= 1.2 AND {_cool('dest_fanout', 's.ip')}""")


_PARTS["detect_device_behavior"] = _behavior("ema")
_PARTS["detect_destination_fanout"] = _fanout("ema")
for _n, (_head, _rest) in _PARTS.items():
    _put(_n, f"{_head}, {_rest}")


def _all_detectors(parts: dict[str, tuple[str, str]]) -> str:
    names = "anomaly_type, dedup_key, severity, summary, detected_at"
    return " UNION ALL ".join(f"SELECT {names} FROM ({head}, {rest})" for head, rest in parts.values())


for _n, _order in (("detect_watched_countries", "d_total_conns DESC, d_ip LIMIT 10"), ("detect_massive_volume", "d_total_bytes DESC, d_ip LIMIT 5")):
    _put(f"{_n}_top", f"SELECT * FROM ({', '.join(_PARTS[_n])}) ORDER BY {_order}")
# severe alerts of severity 2 keep their signature; the others are one row for each category, source and destination
_put("anomalies_null_signature", f"""SELECT n AS "left", n AS ids FROM (SELECT count(*) - CAST(count(*) FILTER (signature IS NULL) > 0 AS INT) AS n FROM (
    SELECT DISTINCT signature, CASE WHEN signature IS NULL THEN category || '|' || coalesce(src_ip, '') || '|' || coalesce(dest_ip, '') END AS g
    FROM (SELECT CASE WHEN severity > 1 THEN signature END AS signature, category, src_ip, dest_ip
          FROM alerts WHERE severity <= 2 AND {RECENT})))""")
_put("detect_all", _all_detectors(_PARTS))
# nothing known, found or learnt before
_put("cycle_empty_start", f"""SELECT anomaly_type, severity, count(*) AS found, count(DISTINCT dedup_key) AS keys FROM (
    {_all_detectors({k: v for k, v in _PARTS.items() if k not in ("detect_device_behavior", "detect_destination_fanout")})}
    ) GROUP BY 1, 2""".replace("cooling k", "(SELECT * FROM cooling WHERE false) k").replace("history h", "(SELECT * FROM history WHERE false) h")
     .replace("(SELECT ip FROM known)", "(SELECT ip FROM known WHERE false)"))
_put("detect_all_updated_baseline", _all_detectors({
    **_PARTS, "detect_device_behavior": _behavior("ema_next"), "detect_destination_fanout": _fanout("ema_next")}))
_put("detect_first_sight", f"""
    SELECT 'new_device' AS anomaly_type, ip AS dedup_key, 'medium' AS severity, 'New device ' || ip || ' detected' AS summary,
        {T} AS detected_at, ip AS d_ip, mac AS d_mac, 'events_table' AS d_detection_path
    FROM (SELECT orig_h AS ip, mac FROM conn WHERE {RECENT}
            AND regexp_matches(orig_h, '^(10|192[.]168|172[.](1[6-9]|2[0-9]|3[01]))[.]')
          QUALIFY row_number() OVER (PARTITION BY orig_h ORDER BY timestamp DESC, mac DESC NULLS LAST) = 1)
    WHERE ip NOT IN (SELECT ip FROM known)""")
_put("detect_drained_queue", f"""
    SELECT 'new_device' AS anomaly_type, assigned_addr AS dedup_key, 'medium' AS severity,
        'New device ' || assigned_addr || ' detected (fast path)' AS summary, {T} AS detected_at,
        assigned_addr AS d_ip, mac AS d_mac, 'fast' AS d_detection_path
    FROM dhcp WHERE timestamp >= TIMESTAMP '2024-01-15 00:00:00'""")
_TICKS = """SELECT signature AS k, time_bucket(INTERVAL '10 minutes', timestamp) AS t, count(*) AS hits FROM alerts
    WHERE severity <= 2 GROUP BY 1, 2"""
_put("cooldown_replay", f"""
    , ticks AS ({_TICKS}),
    fired AS (
        SELECT k, min(t) AS t FROM ticks GROUP BY k
        UNION ALL
        SELECT f.k, (SELECT min(n.t) FROM ticks n WHERE n.k = f.k AND n.t >= f.t + INTERVAL 1 HOUR) AS t
        FROM fired f WHERE f.t IS NOT NULL
    )
    SELECT 'suricata_alert' AS anomaly_type, ticks.k AS dedup_key, ticks.t AS detected_at, ticks.hits
    FROM ticks JOIN fired ON fired.k = ticks.k AND fired.t = ticks.t""", recursive=True)
_put("cooldown_anti_join", f"""
    SELECT signature AS dedup_key, count(*) AS hits FROM alerts WHERE severity <= 2
        AND signature NOT IN (SELECT dedup_key FROM history WHERE anomaly_type = 'suricata_alert'
            AND detected_at > {T} - INTERVAL 12 HOUR AND detected_at <= {T}) GROUP BY 1""")

# --- analyst queries
_put("report_devices_by_bytes", "SELECT * FROM devices")
_put("report_devices_by_last_seen", "SELECT * FROM devices ORDER BY last_seen DESC, ip LIMIT 20")
_put("report_alerts", f"SELECT timestamp, signature, severity_text AS severity, category, src_ip, dest_ip, src_port, dest_port "
     f"FROM alerts WHERE timestamp > {T} - INTERVAL 24 HOUR AND timestamp <= {T}")
_put("report_external", "SELECT * FROM external_ips")
_put("report_external_one_country", "SELECT * FROM external_ips WHERE country = 'RU'")
_LAST_10_DAYS = f"timestamp > {T} - INTERVAL 240 HOUR AND timestamp <= {T}"
_top("report_dns", f"query AS domain, count(*) AS queries FROM dns WHERE source_tool = 'zeek' AND {_LAST_10_DAYS} GROUP BY 1",
     "queries", "domain", 10)
_put("report_protocols", f"SELECT proto AS protocol, count(*) AS connections, {SUM_BYTES} AS total_bytes FROM conn "
     f"WHERE {_LAST_10_DAYS} GROUP BY 1")
_put("report_event_stats", "SELECT source_tool, log_type, count(*) AS count FROM activity GROUP BY 1, 2")
_put("report_scan_history", f"""
    SELECT id, target, scan_type, host_count FROM (
        SELECT o_orderkey AS id, o_orderdate, {_TARGET} AS target,
            CASE WHEN o_orderstatus = 'F' THEN 'scheduled_service' ELSE 'quick' END AS scan_type,
            CASE WHEN o_orderkey % 7 <> 0 THEN (SELECT nullif(CAST(count(*) AS INT), 0) FROM lineitem WHERE l_orderkey = o_orderkey) END AS host_count
        FROM orders) WHERE contains(target, '10.0.1') """)
_put("report_sql", """SELECT orig_h AS source, count(*) AS conns, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS newest
    FROM conn GROUP BY 1 """)
_put("allow_list_newest_first", "SELECT * FROM allowed")
_put("allow_list_check", """SELECT d.ip, a.ip IS NOT NULL AS whitelisted, a.description, a.added_at
    FROM devices d LEFT JOIN allowed a ON a.ip = d.ip""")
_put("allow_list_add", f"""SELECT ip, 'Added via chat' AS description, {T} AS added_at FROM devices
    UNION ALL SELECT * FROM allowed WHERE ip NOT IN (SELECT ip FROM devices)""")
_put("allow_list_remove", "SELECT * FROM allowed WHERE ip NOT IN (SELECT ip FROM devices WHERE total_bytes > 2000000)")
_put("anomalies_unprocessed", """SELECT id, detected_at, anomaly_type, dedup_key, severity, summary FROM history
    WHERE detected_at >= TIMESTAMP '2024-01-20 00:00:00'""")
_put("anomalies_mark_processed", f"""
    SELECT id AS anomaly_id, detected_at, CASE WHEN detected_at < TIMESTAMP '2024-01-15 00:00:00' THEN detected_at ELSE {T} END AS processed_at,
        detected_at < TIMESTAMP '2024-01-15 00:00:00' OR anomaly_type = 'suricata_alert' AS delivered FROM history""")
_put("anomalies_recent", """SELECT id, anomaly_type, severity, summary, detected_at FROM history
    ORDER BY detected_at DESC, id DESC LIMIT 10""")
_put("table_sizes", """SELECT 'events' AS "table", count(*) AS rows FROM events UNION ALL SELECT 'devices', count(*) FROM devices
    UNION ALL SELECT 'external_ips', count(*) FROM external_ips UNION ALL SELECT 'anomalies', count(*) FROM history""")
_put("quality_events", f"""SELECT count(*) AS events, count(*) FILTER (ts < {T} - INTERVAL 240 HOUR) AS expired,
    count(DISTINCT {A.TOOL}) AS source_tools,
    count(*) FILTER (({A.IS_CONN} OR ({A.IS_ALERT})) AND event_id % 10 <> 9) AS with_flow_id FROM events""")
_put("quality_corpus", """SELECT count(*) FILTER (vec_id % 9 <> 0) AS with_vector,
    count(*) FILTER (vec_id % 9 = 0) AS without_vector FROM embeddings""")
_put("quality_sensors_present", "SELECT DISTINCT source_tool FROM activity")

# --- similarity
_put("similarity_nearest", "SELECT * FROM ranked WHERE rank <= 5")
_put("similarity_cosine_expression", "SELECT sid, round(s, 6) AS score FROM (SELECT scored.*, k.label FROM scored "
     "JOIN corpus k ON k.sid = scored.sid) WHERE query_id = label")
_put("similarity_alert_context", """SELECT h.id, h.detected_at, h.anomaly_type,
        CASE WHEN h.anomaly_type = 'suricata_alert' THEN h.signature END AS signature, r.rank, r.sid, r.classtype, r.similarity
    FROM history h LEFT JOIN (SELECT * FROM ranked WHERE rank <= 3) r
        ON h.anomaly_type = 'suricata_alert' AND h.signature = 'SIG ' || r.query_id""")

# --- table upkeep
_put("upkeep_replace_by_file", """
    SELECT source_tool, log_type, CAST(hour(timestamp) AS INT) AS hour, count(*) AS rows,
        count(DISTINCT strftime(timestamp, '%Y-%m-%d-%H')) AS files
    FROM activity a WHERE NOT (hour(timestamp) = 5 AND minute(timestamp) < 30)
        OR (timestamp < TIMESTAMP '2024-01-20 00:00:00' AND NOT EXISTS (SELECT 1 FROM activity b
            WHERE b.source_tool = a.source_tool AND b.log_type = a.log_type
              AND date_trunc('hour', b.timestamp) = date_trunc('hour', a.timestamp) AND minute(b.timestamp) >= 30))
    GROUP BY 1, 2, 3""")
_put("upkeep_register_devices", f"""SELECT ip, CASE WHEN first_seen < TIMESTAMP '2024-01-15 00:00:00' THEN first_seen ELSE {T} END
    AS first_detected FROM devices""")
_put("upkeep_upsert", """SELECT ip, coalesce(hostname, 'unnamed') AS description, last_seen AS added_at FROM devices
    UNION ALL SELECT * FROM allowed WHERE ip NOT IN (SELECT ip FROM devices)""")
_put("upkeep_last_by_key", """SELECT assigned_addr, timestamp, mac, host_name FROM dhcp QUALIFY row_number() OVER (
    PARTITION BY assigned_addr ORDER BY timestamp DESC, mac DESC NULLS LAST, host_name DESC NULLS LAST) = 1""")
_put("upkeep_delete_keys", "SELECT * FROM allowed WHERE ip NOT IN (SELECT ip FROM known WHERE ip LIKE '%1')")
_put("upkeep_retention", f"""SELECT source_tool, log_type, count(*) AS rows, min(timestamp) AS oldest FROM activity
    WHERE timestamp >= {T} - INTERVAL 72 HOUR GROUP BY 1, 2""")
_put("upkeep_anomaly_retention", f"""SELECT id, detected_at, anomaly_type, dedup_key, severity, summary FROM history
    WHERE detected_at >= {T} - INTERVAL 72 HOUR""")
_put("upkeep_unsynced_scans", """
    SELECT o_orderkey AS id, '10.0.0.' || (o_custkey % 250) AS target, 'quick' AS scan_type,
        CASE o_orderstatus WHEN 'O' THEN '{"total":' || o_custkey || ',"sqlite_id":' || o_orderkey || '}'
            WHEN 'F' THEN '{"raw":"no \\"route\\"","sqlite_id":' || o_orderkey || '}'
            ELSE CASE WHEN o_custkey % 2 = 0 THEN '{"hosts":[1,{"a":"b"}],' ELSE '{' END || '"sqlite_id":' || o_orderkey || '}' END AS results
    FROM orders WHERE o_orderkey > (SELECT coalesce(max(o_orderkey), 0) FROM orders WHERE o_orderpriority = '1-URGENT'
        AND o_custkey % 5 <> 0 AND o_orderkey <= (SELECT max(o_orderkey) // 2 FROM orders))""")


# --- streams
def _closed(table: str) -> str:
    """Last instant the watermark has passed when the stream has read everything."""
    return f"(SELECT max(timestamp) - INTERVAL 10 MINUTE FROM {table})"


_put("stream_new_addresses", """SELECT DISTINCT src_ip AS ip FROM activity
    WHERE regexp_matches(src_ip, '^(10|192[.]168|172[.](1[6-9]|2[0-9]|3[01]))[.]') AND src_ip NOT IN (SELECT ip FROM known)""")
_put("stream_sightings", """SELECT DISTINCT src_ip AS ip FROM activity WHERE (source_tool = 'suricata' OR log_type = 'conn')
    AND regexp_matches(src_ip, '^(10|192[.]168|172[.](1[6-9]|2[0-9]|3[01]))[.]') AND src_ip NOT IN (SELECT ip FROM known)""")
_put("stream_tail_files", """SELECT source_tool, log_type, count(*) AS rows, min(timestamp) AS oldest, max(timestamp) AS newest
    FROM activity WHERE timestamp >= TIMESTAMP '2024-01-16' GROUP BY 1, 2""")
_put("stream_trailing_stats", f"""
    SELECT orig_h AS ip, w AS window_start, w + INTERVAL 6 HOUR AS window_end, CAST(sum({BYTES}) AS DOUBLE) AS bytes_5min,
        CAST(count(*) AS DOUBLE) AS conns_5min, CAST(count(DISTINCT resp_h) AS DOUBLE) AS dest_ips
    FROM (SELECT *, time_bucket(INTERVAL '2 hours', timestamp) - to_hours(CAST(2 * s AS INT)) AS w FROM conn, range(0, 3) r(s))
    WHERE w + INTERVAL 6 HOUR <= {_closed('conn')} GROUP BY 1, 2""")
_put("stream_timeline", f"""SELECT {BUCKET} AS time, source_tool, count(*) AS count FROM activity
    WHERE {BUCKET} + INTERVAL 5 MINUTE <= {_closed('activity')} GROUP BY 1, 2""")
_put("stream_running_baselines", f"""
    SELECT w.ip, w.window_start, CAST(count(*) AS INT) AS samples, CAST(0 AS INT) AS late,
        {", ".join(f"round(list_reduce(list(p.{n} ORDER BY p.window_start), lambda e, x: 0.3::DOUBLE * x + 0.7::DOUBLE * e) + {NUDGE}, 6) AS {a}"
                   for n, a in (("bytes_5min", "avg_bytes_5min"), ("conns_5min", "avg_conns_5min"), ("dest_ips", "avg_dest_ips")))}
    FROM windows w JOIN windows p ON p.ip = w.ip AND p.window_start <= w.window_start
    WHERE w.window_start + INTERVAL 6 HOUR <= {_closed('conn')} GROUP BY 1, 2""")
_put("stream_cooldown", f"""
    , ticks AS (SELECT * FROM ({_TICKS}) WHERE t + INTERVAL 10 MINUTE <= (SELECT max(timestamp) - INTERVAL 10 MINUTE
        FROM alerts WHERE severity <= 2)),
    fired AS (
        SELECT k, min(t) AS t FROM ticks GROUP BY k
        UNION ALL
        SELECT f.k, (SELECT min(n.t) FROM ticks n WHERE n.k = f.k AND n.t >= f.t + INTERVAL 1 HOUR) AS t
        FROM fired f WHERE f.t IS NOT NULL
    )
    SELECT 'suricata_alert' AS anomaly_type, ticks.k AS dedup_key, ticks.t AS detected_at, ticks.hits
    FROM ticks JOIN fired ON fired.k = ticks.k AND fired.t = ticks.t""", recursive=True)
_put("stream_alerts_with_flows", f"""
    SELECT a.timestamp AS alert_time, a.signature, a.severity, a.src_ip, a.dest_ip, a.community_id,
        c.timestamp AS flow_time, c.duration, c.conn_state
    FROM alerts a LEFT JOIN conn c ON c.community_id = a.community_id
        AND c.timestamp BETWEEN a.timestamp - INTERVAL 1 HOUR AND a.timestamp + INTERVAL 1 HOUR
    WHERE c.timestamp IS NOT NULL OR a.timestamp + INTERVAL 1 HOUR < least({_closed('alerts')}, {_closed('conn')})""")
for _n in ("source_ndjson_files", "stream_ingest_files"):
    _put(_n, "SELECT source_tool, log_type, count(*) AS rows, max(timestamp) AS newest FROM activity GROUP BY 1, 2")
_put("upkeep_current_rows", """
    SELECT source_tool, log_type, CAST(CASE WHEN hour(timestamp) % 2 = 0 THEN 2 ELSE 1 END AS INT) AS batch, count(*) AS rows
    FROM activity WHERE hour(timestamp) % 2 = 1 OR minute(timestamp) < 30 GROUP BY 1, 2, 3""")
_NEW = ("(SELECT DISTINCT src_ip FROM activity WHERE regexp_matches(src_ip, '^(10|192[.]168|172[.](1[6-9]|2[0-9]|3[01]))[.]') "
        "AND src_ip NOT IN (SELECT ip FROM known))")
_put("stream_queue_consumers", " UNION ALL ".join(
    f"SELECT '{c}' AS consumer, count(*) AS rows, count(*) AS addresses FROM {_NEW}" for c in ("mailer", "store")))
_CLOCK = "(SELECT max(timestamp) FROM conn)"
_put("stream_detector_tick", ", ".join(_PARTS["detect_massive_volume"]).replace(T, _CLOCK))
