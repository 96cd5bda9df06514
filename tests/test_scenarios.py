"""The four incidents, each through the whole detector set."""

import json
from dataclasses import replace

import pytest
import records
from conftest import ago
from pyspark.sql import functions as F

from hearthwatch import schemas
from hearthwatch.config import Settings
from hearthwatch.operators import baselines, detectors, inventory, maintenance
from hearthwatch.operators.silver import SensorTables


@pytest.fixture(scope="module")
def lookups(spark):
    vendors = spark.createDataFrame([("001122", "Camera Works")], schemas.VENDORS)
    first = 203 * 2**24 + 113 * 2**8  # 203.0.113.0/24
    ranges = spark.createDataFrame([(first, first + 255, "KP")], schemas.IP_RANGES)
    return vendors, ranges


def tables(events, lookups):
    t = SensorTables.from_events(events)
    return SensorTables.from_events(
        events, devices=inventory.device_inventory(t.conn, t.dhcp, lookups[0]),
        external_ips=inventory.external_inventory(t.conn, lookups[1]))


def none(spark, schema):
    return spark.createDataFrame([], schema)


def run(spark, t, now, known=None, history=None, base=None, **kw):
    found = detectors.detect_all(
        t, known if known is not None else none(spark, schemas.KNOWN_DEVICES),
        base if base is not None else none(spark, schemas.BASELINES),
        history if history is not None else none(spark, schemas.ANOMALIES), now, **kw)
    return {(r.anomaly_type, r.dedup_key): r for r in found.collect()}


def test_new_device(spark, now, lookups):
    t = tables(records.events_frame(spark, records.printer_joins()), lookups)
    found = run(spark, t, now)
    assert list(found) == [("new_device", records.PRINTER)]
    row = found["new_device", records.PRINTER]
    assert row.severity == "medium" and "Unknown manufacturer" in row.summary
    details = json.loads(row.details)
    assert details["mac"] == records.PRINTER_MAC and details["total_conns"] == 5 and "manufacturer" not in details
    known = t.devices.select("ip", F.lit(now).alias("first_detected"))
    assert run(spark, t, now, known=known) == {}


def test_watched_country(spark, now, lookups):
    t = tables(records.events_frame(spark, records.thermostat_reports()), lookups)
    found = run(spark, t, now)
    row = found["suspicious_country", records.COLLECTOR]
    details = json.loads(row.details)
    assert (details["total_conns"], details["contacted_by"], details["country"]) == (4, records.THERMOSTAT, "KP")
    assert details["top_service"] == "ssl" and row.severity == "high"
    assert found["new_device", records.THERMOSTAT].summary.count("Camera Works") == 1
    off = run(spark, t, now, settings=replace(Settings(), watch_countries=("",)))
    assert ("suspicious_country", records.COLLECTOR) not in off


def test_cooling_hosts_leave_room_for_others(spark, now, lookups):
    """Eleven watched hosts of which ten cool down: the eleventh is reported, with or without a limit of ten."""
    far = [f"203.0.113.{n}" for n in range(1, 12)]
    rows = [records.flow(records.THERMOSTAT, ip, 443, 60) for k, ip in enumerate(far) for _ in range(20 - k)]
    t = tables(records.events_frame(spark, rows), lookups)
    history = spark.createDataFrame([(k, ago(minutes=5), "suspicious_country", ip, "high", "", "") for k, ip in enumerate(far[:10])], schemas.ANOMALIES)
    for settings in (Settings(), replace(Settings(), country_top=10)):
        rows = detectors.watched_countries(t.external_ips, history, now, settings).collect()
        assert [r.dedup_key for r in rows] == [far[10]]
    two = replace(Settings(), country_top=2)
    assert {r.dedup_key for r in detectors.watched_countries(t.external_ips, none(spark, schemas.ANOMALIES), now, two).collect()} == set(far[:2])


def test_spike(spark, now, lookups):
    t = tables(records.events_frame(spark, records.crawl()), lookups)
    row = run(spark, t, now)["traffic_spike", "network"]
    details = json.loads(row.details)
    assert details["current_5min_conns"] == 2000 and details["ratio"] == 12.0 and details["hourly_avg_5min"] == 166.7
    assert details["top_talkers"] == [{"ip": records.CRAWLER, "conns": 2000}]
    assert row.summary == "Traffic spike: 2000 connections in 5 min (12.0x above average)"
    history = spark.createDataFrame(
        [(1, ago(minutes=59), "traffic_spike", "network", "high", "", "")], schemas.ANOMALIES)
    assert ("traffic_spike", "network") not in run(spark, t, now, history=history)
    old = history.withColumn("detected_at", F.lit(ago(minutes=60)))
    assert ("traffic_spike", "network") in run(spark, t, now, history=old)


@pytest.mark.parametrize("recent,earlier,fires", [(1000, 1399, True), (1000, 1400, False), (999, 0, False)])
def test_spike_limits(spark, now, lookups, recent, earlier, fires):
    # ratio 12*1000/2400 is exactly 5 and must not fire
    rows = records.crawl(recent) + [records.flow("192.168.40.9", "10.9.9.9", 1, 1800) for _ in range(earlier)]
    conn = tables(records.events_frame(spark, rows), lookups).conn
    assert detectors.traffic_spike(conn, none(spark, schemas.ANOMALIES), now).count() == int(fires)


def test_average_of_exactly_ten_does_not_fire(spark, now, lookups):
    conn = tables(records.events_frame(spark, records.crawl(120)), lookups).conn
    low = replace(Settings(), spike_min_conns=1)
    assert detectors.traffic_spike(conn, none(spark, schemas.ANOMALIES), now, low).count() == 0


def test_alerts(spark, now, lookups):
    t = tables(records.events_frame(spark, eve=records.dropper_alerts()), lookups)
    found = run(spark, t, now)
    first, second = found["suricata_alert", records.DROPPER], found["suricata_alert", records.SWEEP]
    assert (first.severity, second.severity) == ("critical", "high") and len(found) == 2
    assert json.loads(first.details)["count"] == 3
    history = spark.createDataFrame([(1, ago(minutes=10), "suricata_alert", records.DROPPER, "high", "", "")], schemas.ANOMALIES)
    assert list(run(spark, t, now, history=history)) == [("suricata_alert", records.SWEEP)]


def test_alerts_without_signature_have_ids_of_their_own(spark, now, lookups):
    eve = [records.warning("192.168.1.1", d, None, 1, 30) for d in ("198.51.100.1", "198.51.100.2")]
    alerts = tables(records.events_frame(spark, eve=eve), lookups).alerts
    stored = detectors.stored_form(detectors.severe_alerts(alerts, none(spark, schemas.ANOMALIES), now))
    ids = [r.id for r in stored.collect()]
    assert len(set(ids)) == 2
    ledger = spark.createDataFrame([(ids[0], now)], "anomaly_id BIGINT, detected_at TIMESTAMP")
    assert [r.id for r in maintenance.unprocessed(stored, ledger).collect()] == ids[1:]


def test_one_row_per_signature_and_odd_characters(spark, now, lookups):
    odd = '100%_"quoted" é'
    eve = [records.warning("192.168.1.1", d, odd, 2, 30) for d in ("9.9.9.9", "9.9.9.8", "9.9.9.8")]
    eve += [records.warning("192.168.1.1", "9.9.9.9", "100Z_ anything", 2, 30),
            records.warning("192.168.1.1", "9.9.9.9", "minor", 3, 30),
            records.warning("192.168.1.1", "9.9.9.9", "stale", 1, 301)]
    alerts = tables(records.events_frame(spark, eve=eve), lookups).alerts
    history = spark.createDataFrame([(1, ago(minutes=5), "suricata_alert", "100%_", "high", "", "")], schemas.ANOMALIES)
    rows = detectors.severe_alerts(alerts, history, now).collect()
    assert {r.dedup_key for r in rows} == {odd, "100Z_ anything"}
    assert {r.dedup_key: r.details["dest_ip"] for r in rows}[odd] == "9.9.9.8"


def test_behaviour_uses_the_past_and_is_bounded_when_updated_first(spark, now, lookups):
    rows = [records.flow("192.168.1.7", f"9.9.9.{i}", 80, 60, orig_bytes=1000, resp_bytes=0) for i in range(30)]
    t = tables(records.events_frame(spark, rows), lookups)
    base = spark.createDataFrame([("192.168.1.7", None, 300.0, 1.0, 2.0, 3, now)], schemas.BASELINES)
    found = run(spark, t, now, base=base)
    behavior = json.loads(found["device_behavior", "192.168.1.7"].details)
    assert behavior["bytes_ratio"] == 100.0 and behavior["conns_ratio"] == 30.0 and behavior["baseline_samples"] == 3
    assert "bytes 100.0x" in found["device_behavior", "192.168.1.7"].summary
    fanout = json.loads(found["dest_fanout", "192.168.1.7"].details)
    assert fanout["current_dest_ips"] == 30 and fanout["ratio"] == 15.0
    updated = run(spark, t, now, base=base, baseline="updated")
    assert not [k for k in updated if k[0] in ("device_behavior", "dest_fanout")]
    young = base.withColumn("samples", F.lit(2))
    assert not [k for k in run(spark, t, now, base=young) if k[0] in ("device_behavior", "dest_fanout")]
    with pytest.raises(ValueError):
        run(spark, t, now, baseline="later")


def test_volume(spark, now, lookups):
    big = [records.flow("192.168.1.8", "9.9.9.9", 80, 60, orig_bytes=300 * 2**20, resp_bytes=200 * 2**20 + 1)]
    edge = [records.flow("192.168.1.9", "9.9.9.9", 80, 60, orig_bytes=300 * 2**20, resp_bytes=200 * 2**20)]
    conn = tables(records.events_frame(spark, big + edge), lookups).conn
    rows = detectors.massive_volume(conn, none(spark, schemas.ANOMALIES), now).collect()
    assert [r.dedup_key for r in rows] == ["192.168.1.8"] and rows[0].details["total_mb"] == 500.0
    assert rows[0].summary == "Massive data transfer: 192.168.1.8 moved 500.0 MB in 5 minutes (1 connections)"


def test_first_sight_and_queue(spark, now, lookups):
    rows = [records.flow("192.168.1.3", "9.9.9.9", 1, 119, "aa"), records.flow("192.168.1.3", "9.9.9.9", 1, 10, "bb"),
            records.flow("192.168.1.4", "9.9.9.9", 1, 121, "aa"), records.flow("8.8.4.4", "9.9.9.9", 1, 5, "aa")]
    conn = tables(records.events_frame(spark, rows), lookups).conn
    found = detectors.first_sight(conn, none(spark, schemas.KNOWN_DEVICES), now).collect()
    assert [(r.dedup_key, r.details["mac"], r.details["detection_path"]) for r in found] == [("192.168.1.3", "bb", "events_table")]
    queue = spark.createDataFrame([(1, now, "10.0.0.1", None), (2, now, "10.0.0.2", None)],
                                  "id BIGINT, detected_at TIMESTAMP, ip STRING, mac STRING")
    got = detectors.drained(queue, queue.filter("id = 1"), now).collect()
    assert [r.summary for r in got] == ["New device 10.0.0.2 detected (fast path)"]


def test_inventory_edges(spark, now, lookups):
    zeek = [
        records.flow("192.168.1.2", "9.9.9.9", 80, 50), records.flow("192.168.1.2", "9.9.9.9", 80, 40, "00:11:22:00:00:01"),
        records.flow("192.168.1.2", "9.9.9.9", 80, 30, "00:11:22:00:00:02", proto="udp"),
        records.flow("192.168.1.5", "9.9.9.9", 80, 30, None, orig_bytes=None, resp_bytes="x"),
    ]
    dhcp = [{"timestamp": records.time_before(90), "assigned_addr": "192.168.1.5", "mac": "00:11:22:00:00:05", "host_name": "old"},
            {"timestamp": records.time_before(80), "assigned_addr": "192.168.1.5", "mac": "00:11:22:00:00:06"}]
    t = tables(records.events_frame(spark, zeek, dhcp=dhcp), lookups)
    got = {r.ip: r for r in t.devices.collect()}
    assert got["192.168.1.2"].mac == "00:11:22:00:00:02" and got["192.168.1.2"].protocols == "tcp, udp"
    assert got["192.168.1.2"].total_conns == 3 and got["192.168.1.2"].services is None
    assert got["192.168.1.5"].mac == "00:11:22:00:00:06" and got["192.168.1.5"].hostname is None
    assert got["192.168.1.5"].total_bytes == 0 and got["192.168.1.5"].manufacturer == "Camera Works"
    stats = inventory.conn_stats(t.conn).filter("ip = '192.168.1.2'").count()
    assert stats == 3 and baselines.recent_stats(t.conn, now).count() == 2
