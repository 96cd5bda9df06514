"""Schemas of the stored tables and of the JSON payloads inside `events.raw`."""

from __future__ import annotations

EVENTS = "timestamp TIMESTAMP, source_tool STRING, log_type STRING, source_file STRING, raw STRING"

INGEST_LEDGER = "source_file STRING, modified_at TIMESTAMP"

VENDORS = "oui_prefix STRING, manufacturer STRING"

# IPv4 bounds exceed 2**31 and Spark has no unsigned int, hence BIGINT.
IP_RANGES = "ip_start BIGINT, ip_end BIGINT, country STRING"

DEVICES = (
    "ip STRING, mac STRING, manufacturer STRING, hostname STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, "
    "total_conns BIGINT, total_bytes BIGINT, protocols STRING, services STRING"
)

EXTERNAL_IPS = (
    "ip STRING, country STRING, total_conns BIGINT, total_bytes BIGINT, contacted_by STRING, "
    "top_service STRING, top_dest_port INT"
)

BASELINES = (
    "ip STRING, manufacturer STRING, avg_bytes_5min DOUBLE, avg_conns_5min DOUBLE, avg_dest_ips DOUBLE, "
    "samples INT, updated_at TIMESTAMP"
)

ANOMALIES = (
    "id BIGINT, detected_at TIMESTAMP, anomaly_type STRING, dedup_key STRING, severity STRING, "
    "summary STRING, details STRING"
)

KNOWN_DEVICES = "ip STRING, first_detected TIMESTAMP"

SCANS = "id BIGINT, scanned_at TIMESTAMP, target STRING, scan_type STRING, results STRING"

SCAN_PORT = "STRUCT<port INT, protocol STRING, state STRING, service STRING, version STRING, product STRING>"
SCAN_HOST = f"STRUCT<ip STRING, hostname STRING, state STRING, ports ARRAY<{SCAN_PORT}>>"
SCAN_RESULT = f"STRUCT<target STRING, scan_type STRING, host_count INT, hosts ARRAY<{SCAN_HOST}>>"

RULES = "sid BIGINT, msg STRING, classtype STRING, chunk_text STRING"

ALLOW_LIST = "ip STRING, description STRING, added_at TIMESTAMP"

PROCESSED = "anomaly_id BIGINT, detected_at TIMESTAMP, processed_at TIMESTAMP, delivered BOOLEAN"

# Payload leaves are read as text and converted with the tolerant casts of functions.payload, so that one
# badly typed number does not void the record.
CONN_PAYLOAD = (
    "ts STRING, uid STRING, `id.orig_h` STRING, `id.orig_p` STRING, `id.resp_h` STRING, `id.resp_p` STRING, "
    "proto STRING, service STRING, duration STRING, orig_bytes STRING, resp_bytes STRING, conn_state STRING, "
    "orig_l2_addr STRING, resp_l2_addr STRING, community_id STRING"
)
DHCP_PAYLOAD = (
    "assigned_addr STRING, mac STRING, host_name STRING, server_addr STRING, domain STRING, lease_time STRING"
)
ALERT_PAYLOAD = (
    "event_type STRING, src_ip STRING, dest_ip STRING, src_port STRING, dest_port STRING, proto STRING, "
    "community_id STRING, alert STRUCT<signature STRING, category STRING, severity STRING>"
)
DNS_PAYLOAD = (
    "event_type STRING, src_ip STRING, `id.orig_h` STRING, query STRING, qtype_name STRING, rcode_name STRING, "
    "dns STRUCT<rrname STRING, rrtype STRING, rcode STRING>"
)
TLS_PAYLOAD = (
    "event_type STRING, src_ip STRING, `id.orig_h` STRING, server_name STRING, version STRING, "
    "tls STRUCT<sni STRING, version STRING, ja3 STRUCT<hash STRING>>"
)
ACTIVITY_PAYLOAD = (
    "event_type STRING, src_ip STRING, dest_ip STRING, `id.orig_h` STRING, `id.resp_h` STRING, proto STRING"
)
