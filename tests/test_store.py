"""Stored tables: batches of events, keyed tables, look-ups, and the replayed cooldown."""

from datetime import timedelta

import numpy as np
import records
from pyspark.sql import functions as F

from hearthwatch import schemas
from hearthwatch.config import Settings
from hearthwatch.functions.timing import back
from hearthwatch.operators import baselines, cooldown, correlate, detectors, inventory, silver
from hearthwatch.plans import cycle
from hearthwatch.plans.event_store import EventStore
from hearthwatch.sources import tables
from hearthwatch.sources.keyed import KeyedTable


def rows_of(df):
    return sorted(map(str, df.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_events(spark, now, seed, n=300):
    """Connections and leases of the last four days."""
    rnd = np.random.default_rng(seed)
    zeek, dhcp = [], []
    for _ in range(n):
        before = int(rnd.integers(0, 4 * 24 * 3600))
        src = f"192.168.40.{rnd.integers(1, 9)}"
        dst = f"203.0.113.{rnd.integers(1, 5)}" if rnd.random() < 0.6 else f"192.168.40.{rnd.integers(1, 9)}"
        service = [None, "ssl", "dns"][rnd.integers(0, 3)]
        zeek.append(records.flow(src, dst, int(rnd.integers(1, 4)), before, ["", records.PRINTER_MAC, None][rnd.integers(0, 3)], service=service))
        if rnd.random() < 0.1:
            dhcp.append({"timestamp": records.time_before(before), "assigned_addr": src, "mac": records.THERMOSTAT_MAC, "host_name": f"h{rnd.integers(0, 3)}"})
    return records.events_frame(spark, zeek=zeek, dhcp=dhcp).withColumn("source_file", F.concat(F.lit("f"), (F.hash("raw") % 5).cast("string")))


def test_partial_summaries_equal_full_ones(spark, tmp_path, now):
    """Two batches, of which the second reads a file again, and a retention that cuts through an hour."""
    store = EventStore(spark, str(tmp_path / "store"))
    assert store.read("conn").count() == 0 and store.profile("sources", spark.createDataFrame([], cycle.LEDGER), now, 70).count() == 0
    first, second = some_events(spark, now, 1), some_events(spark, now, 2)
    store.write_batch(2, first)
    store.write_batch(4, second.filter("source_file IN ('f0', 'f1', 'f-2')"))
    store.write_batch(4, second.filter("source_file IN ('f0', 'f1')"))  # a retry, of less
    ledger = spark.createDataFrame([(f"f{i}", now, 4 if i in (0, 1) else 2) for i in range(-4, 5)], cycle.LEDGER)
    in_force = first.filter("source_file NOT IN ('f0', 'f1')").unionByName(second.filter("source_file IN ('f0', 'f1')"))
    at = now - timedelta(minutes=17)
    vendors = spark.createDataFrame([("02005E", "Acme")], schemas.VENDORS)
    for hours in (200, 50, 1):
        kept = in_force.filter(F.col("timestamp") >= back(at, f"{hours} hours"))
        conn, dhcp = silver.conn(kept), silver.dhcp(kept)
        profile = {name: store.profile(name, ledger, at, hours) for name in ("sources", "leases", "externals")}
        assert rows_of(inventory.devices_of(profile["sources"], profile["leases"], vendors)) == rows_of(inventory.device_inventory(conn, dhcp, vendors))
        assert rows_of(inventory.external_totals(profile["externals"])) == rows_of(inventory.external_totals(inventory.external_profile(conn)))
        assert rows_of(inventory.external_clients(profile["externals"])) == rows_of(inventory.external_clients(inventory.external_profile(conn)))
        typed = store.sensor_tables(ledger, at, hours)
        assert rows_of(typed.conn.drop("event_date")) == rows_of(conn) and rows_of(typed.dhcp.drop("event_date")) == rows_of(dhcp)
    # all files into one batch: the same rows, without those that are expired or out of force
    store.move_files(5, ledger, at, 50)
    store.keep_batches({5})
    moved = ledger.withColumn("batch", F.lit(5))
    kept = in_force.filter(F.col("timestamp") >= back(at, "50 hours"))
    assert store.read("events").count() == kept.count() == store.events(moved, at, 50).count()
    assert rows_of(store.sensor_tables(moved, at, 50).conn.drop("event_date")) == rows_of(silver.conn(kept))
    assert rows_of(inventory.external_totals(store.profile("externals", moved, at, 50))) == rows_of(inventory.external_totals(inventory.external_profile(silver.conn(kept))))
    store.drop_days_before("2024-01-30")
    assert min(store.days()) == "2024-01-30"


def test_stored_tables_are_not_parsed_again_and_prune_days(spark, tmp_path, now):
    store = EventStore(spark, str(tmp_path / "store"))
    store.write_batch(2, some_events(spark, now, 3))
    ledger = spark.createDataFrame([(f"f{i}", now, 2) for i in range(-4, 5)], cycle.LEDGER)
    empty = [spark.createDataFrame([], s) for s in (schemas.KNOWN_DEVICES, schemas.BASELINES, schemas.ANOMALIES)]
    devices, externals = spark.createDataFrame([], schemas.DEVICES), spark.createDataFrame([], cycle.EXTERNAL_TOTALS)
    clients = spark.createDataFrame([], cycle.EXTERNAL_CLIENTS)
    typed = store.sensor_tables(ledger, now, 72, devices=devices, external_ips=externals)
    plan = plan_of(detectors.detect_all(typed, *empty, now, clients=clients))
    assert "from_json" not in plan and "variant_get" not in plan and "get_json_object" not in plan
    stats = plan_of(baselines.recent_stats(typed.conn, now))
    assert "PartitionFilters: [isnotnull(event_date" in stats and "2024-01-30" in stats or "PartitionFilters: [(event_date" in stats


def test_newest_alerts_look_up_their_flows(spark, tmp_path, now):
    n = 20000
    conn = spark.range(n).select(
        (F.lit(now) - F.expr("make_interval(0,0,0,0,0,0,id)")).alias("timestamp"), F.concat(F.lit("1:"), (F.col("id") * 7919 % n).cast("string")).alias("community_id"),
        F.lit("1.0").alias("duration"), F.col("id").alias("orig_bytes"), F.lit(1).cast("bigint").alias("resp_bytes"), F.lit("SF").alias("conn_state"))
    tables.write_by_day(conn.coalesce(1), str(tmp_path / "conn"))
    stored = spark.read.parquet(str(tmp_path / "conn"))
    alerts = spark.createDataFrame(
        [(now, "s", 1, "a", "b", c) for c in ("1:5", "1:6", None, "none")], "timestamp TIMESTAMP, signature STRING, severity INT, src_ip STRING, dest_ip STRING, community_id STRING")
    found = correlate.newest_alerts_with_flows(alerts, stored, 3)
    assert rows_of(found) == rows_of(correlate.newest_alerts_with_flows(alerts, conn, 3)) and found.count() == 3
    assert "PushedFilters: [In(community_id" in plan_of(found) or "In(community_id" in plan_of(found)
    # an id between the least and the greatest that is in no row group: the filter says so, and nothing is read
    scan = stored.filter(F.col("community_id").isin(["1:5x"]))
    scan.collect()
    nodes = scan._jdf.queryExecution().executedPlan().collectLeaves()
    read = sum(nodes.apply(i).metrics().apply("numOutputRows").value() for i in range(nodes.size()))
    assert read == 0


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "ip STRING, n INT", ("ip",), 8)
    assert table.read().count() == 0 and table.version() == 0
    rows = [(f"10.0.0.{i}", i) for i in range(100)]
    assert table.upsert(spark.createDataFrame(rows, "ip STRING, n INT")) == 1
    before = set(table.read().inputFiles())
    assert table.upsert(spark.createDataFrame([("10.0.0.3", -3)], "ip STRING, n INT")) == 2
    after = set(table.read().inputFiles())
    assert len({f.rsplit("/", 2)[1] for f in before - after}) == 1 and len(before & after) >= 7
    assert table.insert_missing(spark.createDataFrame([("10.0.0.3", 5), ("new", 6)], "ip STRING, n INT")) == 3
    assert table.delete(spark.createDataFrame([("10.0.0.4",), ("absent",)], "ip STRING")) == 4
    want = {**dict(rows), "10.0.0.3": -3, "new": 6}
    del want["10.0.0.4"]
    assert {r.ip: r.n for r in table.read().collect()} == want
    assert table.upsert(spark.createDataFrame([], "ip STRING, n INT")) == 5 and table.read().count() == len(want)
    again = KeyedTable(spark, str(tmp_path / "t"), "ip STRING, n INT", ("ip",), 64)  # the number of buckets stays
    assert again.buckets == 8 and {r.ip: r.n for r in again.read().collect()} == want
    assert {r.ip: r.n for r in again.read(4).collect()} == want  # the version before is still there
    again.delete(again.read().select("ip"))
    assert again.read().count() == 0 and again.upsert(spark.createDataFrame([("z", 1)], "ip STRING, n INT")) == 7
    assert [tuple(r) for r in again.read().collect()] == [("z", 1)]


def test_a_keyed_table_change_that_loses_the_race_changes_nothing(spark, tmp_path):
    a = KeyedTable(spark, str(tmp_path / "t"), "k STRING, n INT", ("k",), 4)
    a.upsert(spark.createDataFrame([("x", 1)], "k STRING, n INT"))
    late = a.version()
    a.upsert(spark.createDataFrame([("x", 2)], "k STRING, n INT"))
    try:
        a._put({"buckets": 4, "copies": {}}, late + 1)
        raise AssertionError("a second manifest of the same number")
    except Exception as e:
        assert "already exists" in str(e)
    assert [tuple(r) for r in a.read().collect()] == [("x", 2)]


def test_replayed_cooldown_of_long_histories(spark):
    """A key with very many ticks, keys that cross batches, ties, and keys that hold a NULL."""
    n = 200_000
    at = F.timestamp_seconds(F.col("id") * 10 + (F.col("id") % 7))
    long = spark.range(n).select(F.lit("a").alias("anomaly_type"), F.lit("k").alias("dedup_key"), at.alias("detected_at"))
    rows = long.unionByName(long.filter("id % 3 = 0").withColumn("dedup_key", F.lit("l"))).unionByName(long.filter("id < 50").withColumn("dedup_key", F.lit(None).cast("string")))
    got = {}
    for r in cooldown.replayed_cooldown(rows, 13, "10 seconds").select("dedup_key", F.unix_seconds("detected_at").alias("t"), "hits").collect():
        got.setdefault(r.dedup_key, {})[r.t] = r.hits
    for key, ids in (("k", range(n)), ("l", range(0, n, 3))):
        hits = {}
        for i in ids:
            t = (i * 10 + i % 7) // 10 * 10
            hits[t] = hits.get(t, 0) + 1
        want, last = {}, None
        for t in sorted(hits):
            if last is None or t >= last + 13 * 60:
                want[t], last = hits[t], t
        assert got[key] == want
    assert len(got[None]) == 50  # a NULL equals no other, so nothing holds it back
    assert "collect_list" not in plan_of(cooldown.replayed_cooldown(rows, 13, "10 seconds"))


def test_one_pass_totals_equal_separate_statistics(spark, now):
    events = records.events_frame(spark, zeek=records.crawl(300) + records.thermostat_reports() + [records.flow(None, "10.0.0.1", 1, 5)])
    conn, settings = silver.conn(events), Settings()
    totals = baselines.source_totals(conn, now, settings)
    for lan in (True, False):
        assert rows_of(baselines.stats_of(totals, lan)) == rows_of(baselines.recent_stats(conn, now, settings, lan))
    none = spark.createDataFrame([], schemas.ANOMALIES)
    small = Settings(spike_min_conns=1, spike_min_average=0.1, spike_ratio=0.1, volume_threshold_mb=0)
    assert rows_of(detectors.spikes_of(totals, none, now, small)) == rows_of(detectors.traffic_spike(conn, none, now, small))
    assert rows_of(detectors.volumes_of(totals, none, now, small)) == rows_of(detectors.massive_volume(conn, none, now, small))
