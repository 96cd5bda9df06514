"""Whole cycles over staged files."""

import json
import os
from datetime import timedelta

import records

from hearthwatch import schemas
from hearthwatch.plans.cycle import TableFolder, run_cycle


def stage(root, name, rows, mtime):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (mtime, mtime))


def test_cycles(spark, tmp_path, now):
    staged, root = tmp_path / "staged", str(tmp_path / "tables")
    vendors = spark.createDataFrame([("02005E", "Acme")], schemas.VENDORS)
    first = 203 * 2**24 + 113 * 2**8
    ranges = spark.createDataFrame([(first, first + 255, "KP")], schemas.IP_RANGES)
    hour = int((now - timedelta(hours=1)).timestamp())

    def run(cycle, at, **kw):
        return {(r.anomaly_type, r.dedup_key): r for r in run_cycle(spark, root, str(staged), cycle, at, vendors, ranges, **kw).collect()}

    staged.mkdir()
    assert run(1, now - timedelta(minutes=1)) == {}  # nothing staged yet

    stage(staged, "zeek/conn/2024-01-30-23.ndjson", records.printer_joins(), hour)
    found = run(2, now)
    # the newest flows are within the last two minutes: the quick check has the device, and the summary does not repeat it
    assert list(found) == [("new_device", records.PRINTER)]
    assert run(3, now + timedelta(seconds=50)) == {}  # nothing new, device registered

    # the hour's file grew: its rows replace the earlier reading
    stage(staged, "zeek/conn/2024-01-30-23.ndjson", records.printer_joins() + records.thermostat_reports(), hour + 100)
    stage(staged, "suricata/eve/2024-01-30-23.ndjson", records.dropper_alerts(), hour + 100)
    third = run(4, now + timedelta(seconds=60))
    assert {k[0] for k in third} == {"new_device", "suspicious_country", "suricata_alert"} and len(third) == 4
    store = TableFolder(spark, root)
    devices = {r.ip: r for r in store.read("devices", 4, schemas.DEVICES).collect()}
    assert devices[records.PRINTER].total_conns == 5  # not doubled
    assert "Acme" in devices[records.PRINTER].manufacturer
    assert store.read("anomalies", 4, schemas.ANOMALIES).count() == 5
    samples = {r.ip: r.samples for r in store.read("baselines", 4, schemas.BASELINES).collect()}
    assert samples[records.PRINTER] == 3 and samples[records.THERMOSTAT] == 1

    # a repeated cycle gives the same tables; the country alert is cooling down afterwards
    assert set(run(4, now + timedelta(seconds=60))) == set(third)
    assert run(5, now + timedelta(minutes=2)) == {}
    assert ("suspicious_country", records.COLLECTOR) in run(6, now + timedelta(minutes=70))

    # rows of the live path are reported once and registered
    queue = spark.createDataFrame([(1, now, "192.168.40.200", None), (2, now, records.PRINTER, None)], "id BIGINT, detected_at TIMESTAMP, ip STRING, mac STRING")
    assert list(run(7, now + timedelta(minutes=71), queue=queue)) == [("new_device", "192.168.40.200")]
    assert run(8, now + timedelta(minutes=72), queue=queue) == {}

    # everything expires: no event older than the retention stays, and old cycles go
    assert run(9, now + timedelta(hours=80)) == {}
    assert not [p for p in (tmp_path / "tables" / "events").iterdir() if p.name.startswith("batch=")]
    assert sorted(p.name for p in (tmp_path / "tables" / "devices").iterdir()) == ["cycle=8", "cycle=9"]


def test_a_retried_batch_with_fewer_files_replaces_all(spark, tmp_path, now):
    staged, root = tmp_path / "staged", str(tmp_path / "tables")
    none = [spark.createDataFrame([], schemas.VENDORS), spark.createDataFrame([], schemas.IP_RANGES)]
    hour = int((now - timedelta(hours=1)).timestamp())
    stage(staged, "zeek/conn/2024-01-30-23.ndjson", records.printer_joins(), hour)
    stage(staged, "suricata/eve/2024-01-30-23.ndjson", records.dropper_alerts(), hour)
    run_cycle(spark, root, str(staged), 1, now, *none)
    os.remove(staged / "suricata/eve/2024-01-30-23.ndjson")
    run_cycle(spark, root, str(staged), 1, now, *none)
    logs = {r.log_type for r in spark.read.parquet(f"{root}/events").select("log_type").distinct().collect()}
    assert logs == {"conn"}
