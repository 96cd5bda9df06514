"""Sensor records for the tests: made-up hosts in a private net, documentation addresses outside."""

import json
from datetime import timedelta

from conftest import NOW
from pyspark.sql import functions as F

PRINTER, THERMOSTAT, CRAWLER, LAPTOP = (f"192.168.40.{n}" for n in (77, 31, 12, 58))
PRINTER_MAC, THERMOSTAT_MAC = "02:00:5e:10:00:4d", "00:11:22:9a:0b:1f"
VENDOR_CLOUD, COLLECTOR, BOTNET = "198.51.100.40", "203.0.113.200", "198.51.100.66"
DROPPER, SWEEP = "TEST Dropper callback", "TEST Sweep of neighbours"


def time_before(seconds):
    return f"{NOW - timedelta(seconds=seconds):%Y-%m-%dT%H:%M:%SZ}"


def flow(src, dst, port, before, mac="", **other):
    """A connection record; `other` replaces fields, with `__` for the dots in their names."""
    ends = {"id.orig_h": src, "id.orig_p": 40000 + port, "id.resp_h": dst, "id.resp_p": port}
    rest = {"proto": "tcp", "conn_state": "SF", "orig_bytes": 10, "resp_bytes": 20, "orig_l2_addr": mac}
    return {"timestamp": time_before(before), **ends, **rest, **{k.replace("__", "."): v for k, v in other.items()}}


def warning(src, dst, text, level, before, group="Testing"):
    body = {"signature": text, "category": group, "severity": level}
    return {"timestamp": time_before(before), "event_type": "alert", "src_ip": src, "dest_ip": dst, "alert": body}


def printer_joins():
    """Five flows of a host that nobody has seen before."""
    web = [flow(PRINTER, VENDOR_CLOUD, 443, 60 * k, PRINTER_MAC, service="ssl") for k in (1, 2, 3)]
    return web + [flow(PRINTER, "192.168.40.1", 53, 200, PRINTER_MAC, proto="udp", service=None), flow(PRINTER, VENDOR_CLOUD, 80, 210, PRINTER_MAC)]


def thermostat_reports():
    """Four flows to one host of a watched country, three of them TLS."""
    kinds = {30: "ssl", 90: None, 150: "ssl", 280: "ssl"}
    return [flow(THERMOSTAT, COLLECTOR, 8883, s, THERMOSTAT_MAC, service=kind) for s, kind in kinds.items()]


def crawl(count=2000):
    """Many flows within the last minutes, no two to the same address in a row."""
    return [flow(CRAWLER, f"10.{k % 7}.{k % 200}.9", 8080, k % 240, orig_bytes=1, resp_bytes=0) for k in range(count)]


def dropper_alerts(before=0):
    """Three critical alerts and one of the second level, the oldest 200 s before `before` seconds ago."""
    calls = [warning(LAPTOP, BOTNET, DROPPER, 1, before + s) for s in (200, 110, 20)]
    return [*calls, warning(LAPTOP, "192.168.40.1", SWEEP, 2, before + 70)]


def events_frame(spark, zeek=(), eve=(), dhcp=()):
    logs = {("zeek", "conn"): zeek, ("suricata", "eve"): eve, ("zeek", "dhcp"): dhcp}
    rows = [(r["timestamp"], *log, "f", json.dumps(r)) for log, records in logs.items() for r in records]
    frame = spark.createDataFrame(rows, "timestamp STRING, source_tool STRING, log_type STRING, source_file STRING, raw STRING")
    return frame.withColumn("timestamp", F.to_timestamp("timestamp"))
