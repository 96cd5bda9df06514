import gzip
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from hearthwatch.functions.timing import instant
from hearthwatch.sources import event_files, lookups, scans, tables


def put(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines))


def test_staged_files(spark, tmp_path, now):
    put(tmp_path / "zeek/conn/2024-01-30-23.ndjson", ['{"timestamp":"2024-01-30T23:00:01Z","uid":"a"}', "{broken", '{"uid":"b"}'])
    put(tmp_path / "suricata/eve/2024-01-30-23.ndjson", ['{"timestamp":"2024-01-30T23:00:02+0000"}'])
    put(tmp_path / "loose.ndjson", ['{"x":1}'])
    put(tmp_path / "zeek/conn/readme.txt", ['{"x":1}'])
    rows = event_files.read_events(spark, str(tmp_path), instant(now)).withColumn("t", F.col("timestamp").cast("string")).collect()
    assert sorted((r.source_tool, r.log_type, r.t) for r in rows) == [
        ("loose.ndjson", "unknown", "2024-01-31 00:00:00"), ("suricata", "eve", "2024-01-30 23:00:02"),
        ("zeek", "conn", "2024-01-30 23:00:01"), ("zeek", "conn", "2024-01-31 00:00:00")]
    assert all(r.source_file.endswith(".ndjson") for r in rows)
    files = event_files.list_files(spark, str(tmp_path))
    assert files.count() == 3


def test_read_since_skips_older_files(spark, tmp_path):
    put(tmp_path / "zeek/conn/a.ndjson", ["{}"])
    put(tmp_path / "zeek/conn/b.ndjson", ["{}", "{}"])
    os.utime(tmp_path / "zeek/conn/a.ndjson", (1_600_000_000, 1_600_000_000))
    since = datetime(2021, 1, 1, tzinfo=timezone.utc)
    assert event_files.read_lines(spark, str(tmp_path), since=since).count() == 2


def test_sensor_files(spark, now):
    lines = [
        ('{"timestamp":"2024-01-30T01:00:00Z","event_type":"dns"}', "file:/logs/suricata-wifi/eve.json"),
        ('{"ts":1706576400.9,"uid":"x"}', "file:/logs/zeek-virbr/conn.2024-01-30-02-52.log"),
        ('{"uid":"y"}', "file:/logs/zeek/dns.log"), ("#separator", "file:/logs/zeek/dns.log"),
        ("{}", "file:/logs/zeek/packet_filter.log"), ("{}", "file:/logs/zeek/reporter.2024.log"), ("{}", "file:/logs/suricata/stats.log"),
    ]
    df = spark.createDataFrame([(*r, now) for r in lines], event_files.LINES)
    got = event_files.normalised_events(df, instant(now)).select("source_tool", "log_type", F.col("timestamp").cast("string")).collect()
    assert sorted(map(tuple, got)) == [("suricata", "eve", "2024-01-30 01:00:00"), ("zeek", "conn", "2024-01-30 01:00:00"),
                                       ("zeek", "dns", "2024-01-31 00:00:00")]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_hourly_sink(spark, tmp_path, fmt, now):
    rows = [(datetime(2024, 1, 30, h, 30, tzinfo=timezone.utc), "zeek", "conn", "f", "{}") for h in (1, 1, 2)]
    df = spark.createDataFrame(rows, "timestamp TIMESTAMP, source_tool STRING, log_type STRING, source_file STRING, raw STRING")
    event_files.write_hourly(df, str(tmp_path / "t"), fmt)
    folder = tmp_path / "t/source_tool=zeek/log_type=conn"
    assert sorted(p.name for p in folder.iterdir()) == ["event_hour=2024-01-30-01", "event_hour=2024-01-30-02"]
    assert spark.read.format(fmt).load(str(tmp_path / "t")).count() == 3


def test_vendor_csv(spark, tmp_path):
    put(tmp_path / "v.csv", ["Registry,Assignment,Organization Name,Organization Address", 'MA-L,080030,"NETWORK, INC","a ""b"" c"',
                             "MA-L,080030,CERN,x", "MA-L,aabbcc,Lower,x", "MA-L,0800,Short,x", "MA-L,112233,,x", "MA-L,short"])
    got = lookups.vendor_table(lookups.read_vendor_csv(spark, str(tmp_path / "v.csv"))).collect()
    assert sorted(map(tuple, got)) == [("080030", "CERN"), ("AABBCC", "Lower")]


def test_range_csv_gz(spark, tmp_path):
    with gzip.open(tmp_path / "g.csv.gz", "wt") as f:
        f.write("1.0.0.0,1.0.0.255,au\n2001:db8::,2001:db8::1,xx\nnope,1.1.1.1,us\n200.0.0.0,200.0.0.1,brazil\n1.2.3.4\n")
    got = lookups.range_table(lookups.read_range_csv(spark, str(tmp_path / "g.csv.gz"))).collect()
    assert sorted(map(tuple, got)) == [(16777216, 16777471, "AU"), (3355443200, 3355443201, "BR")]


def test_rule_file(spark, tmp_path):
    put(tmp_path / "r.rules", ['alert ip (msg:"a"; sid:1;)', 'alert ip (msg:"b"; sid:1;)'])
    rows = lookups.read_rule_lines(spark, str(tmp_path / "r.rules")).orderBy("position").collect()
    assert [r.value[15] for r in rows] == ["a", "b"] and rows[0].modified_at is not None


XML = """<?xml version="1.0"?><nmaprun scanner="x"><host><status state="up"/><address addr="10.0.0.1" addrtype="ipv4"/>
<address addr="aa:bb" addrtype="mac"/><hostnames><hostname name="h1"/><hostname name="h2"/></hostnames>
<ports><port protocol="tcp" portid="22"><state state="open"/><service name="ssh" version="9" product="OpenSSH"/></port>
<port protocol="udp" portid="53"><state state="closed"/></port></ports></host><host></host></nmaprun>"""


def test_scan_xml(spark, tmp_path):
    (tmp_path / "s.xml").write_text(XML)
    hosts = {r.ip: r for r in scans.read_scan_xml(spark, str(tmp_path)).collect()}
    assert hosts["10.0.0.1"].hostname == "h1" and hosts["10.0.0.1"].state == "up"
    first, second = hosts["10.0.0.1"].ports
    assert tuple(first) == (22, "tcp", "open", "ssh", "9", "OpenSSH") and tuple(second) == (53, "udp", "closed", None, None, None)
    docs = scans.scan_documents(spark.createDataFrame([("t", "q", XML), ("t", "q", "<nmaprun")], "target STRING, scan_type STRING, xml STRING"))
    results = [r.results for r in docs.collect()]
    assert results[0].host_count == 2 and results[0].hosts[1].ip == "unknown" and results[1].hosts == []


def test_scan_json(spark, now):
    doc = {"target": "t", "scan_type": "q", "host_count": 2, "hosts": [
        {"ip": "a", "hostname": "", "state": "up", "ports": [{"port": 1, "protocol": "tcp"}, {"port": 2, "protocol": "udp", "service": "dns"}]},
        {"ip": "b", "hostname": "", "state": "up", "ports": []}]}
    df = spark.createDataFrame([(1, now, "t", "q", json.dumps(doc)), (2, now, "t", "q", "oops")],
                               "id BIGINT, scanned_at TIMESTAMP, target STRING, scan_type STRING, results STRING")
    got = scans.scan_host_ports(df).select("id", "ip", "port", "service").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a", 1, None), (1, "a", 2, "dns"), (1, "b", None, None), (2, None, None, None)]


def test_tables_roundtrip_and_daily_layout(spark, tmp_path, now):
    df = spark.createDataFrame([(now, 1), (now, 2)], "timestamp TIMESTAMP, v INT")
    tables.export_table(df, str(tmp_path / "a"))
    assert tables.import_table(spark, str(tmp_path / "a"), "timestamp TIMESTAMP, v INT").count() == 2
    tables.write_by_day(df, str(tmp_path / "d"))
    assert [p.name for p in (tmp_path / "d").iterdir() if p.is_dir()] == ["event_date=2024-01-31"]


def test_silver_tables_round_trip(spark, tmp_path, now):
    import records

    from hearthwatch.operators.silver import SensorTables, write_silver

    events = records.events_frame(spark, zeek=records.printer_joins(), eve=records.dropper_alerts())
    write_silver(events, str(tmp_path / "silver"))
    stored, direct = SensorTables.from_path(spark, str(tmp_path / "silver")), SensorTables.from_events(events)
    assert stored.conn.count() == 5 and stored.alerts.count() == 4 and stored.dns.count() == 0
    assert sorted(map(str, stored.conn.drop("event_date").collect())) == sorted(map(str, direct.conn.collect()))
