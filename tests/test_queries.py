"""Registered queries against their checking SQL, plan shape, and the read-only SQL entry."""

import os
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from hearthwatch.plans import analyst
from hearthwatch.plans.oracle import ORACLE
from hearthwatch.plans.registry import QUERIES
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# every query with HEARTHWATCH_ALL=1; by default one of each kind (tools/check_oracle.py runs them all)
SAMPLE = [
    "device_inventory_from_raw", "external_inventory", "baseline_update", "detect_all", "cooldown_replay",
    "panel_overview_event_types", "panel_threats_alert_flow_correlation", "panel_map_connection_details_shown",
    "panel_nodes_new_ips_over_time", "panel_geo_unsolicited_inbound", "similarity_alert_context", "rules_latest_per_sid",
    "scan_json_ports", "upkeep_replace_by_file", "report_sql", "stream_cooldown",
]
OWN = {name: q for name, q in queries().items() if name in QUERIES}
NAMES = list(OWN) if os.environ.get("HEARTHWATCH_ALL") else SAMPLE


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, db, name):
    df = queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, result.fetchall())


def test_every_query_has_an_oracle():
    assert set(OWN) == set(ORACLE) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "device_inventory", "external_inventory", "join_ip_range", "panel_threats_alert_flow_correlation",
    "panel_map_connection_details", "detect_device_behavior", "detect_watched_countries", "detect_traffic_spike", "join_alerts_with_flows",
])
def test_no_nested_loop_joins(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_time_filters_reach_the_scan(spark):
    text = plan(queries()["baseline_recent_stats"](spark, SF))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "GreaterThan(ts," in scan and "ReadSchema" in scan and "user_id" in scan
    assert "props" not in plan(queries()["panel_alerts_total"](spark, SF))


def test_stored_tables_prune_days(spark):
    text = plan(queries()["panel_alerts_total_stored"](spark, SF))
    assert "PartitionFilters: [isnotnull(event_date" in text
    raw = queries()["upkeep_retention"](spark, SF)
    assert "GreaterThanOrEqual(ts," in plan(raw)


@pytest.fixture(scope="module")
def views(spark):
    spark.range(100).selectExpr("id", "array(id) AS ids", "current_timestamp() AS t").createOrReplaceTempView("events")


@pytest.mark.parametrize("sql,rows", [
    ("SELECT id FROM events", 100), ("select id from events limit 5;", 5), ("WITH x AS (SELECT 1 AS a) SELECT * FROM x", 1),
    ("SELECT id FROM events ORDER BY id DESC -- newest", 100),
])
def test_sql_entry(spark, views, sql, rows):
    assert analyst.query_events(spark, sql).count() == rows
    assert analyst.query_events(spark, sql, 3).count() == min(rows, 3)


def test_sql_entry_keeps_order_and_prints_other_types(spark, views):
    rows = analyst.query_events(spark, "SELECT id, ids, t FROM events ORDER BY id DESC").collect()
    assert rows[0].id == 99 and rows[0].ids == "[99]" and isinstance(rows[0].t, str)


@pytest.mark.parametrize("sql", [
    "DROP TABLE events", "INSERT INTO events SELECT 1", "CREATE TABLE x AS SELECT 1", "SET spark.x=1", "SHOW TABLES",
    "SELECT 1; SELECT 2", "SELECT 1) ; DROP VIEW events --", "CACHE TABLE events", "",
])
def test_sql_entry_refuses_commands(spark, views, sql):
    with pytest.raises(Exception):
        analyst.query_events(spark, sql).collect()
    assert spark.table("events").count() == 100


def test_report_limits(spark):
    from hearthwatch.operators.silver import SensorTables

    devices = spark.range(80).selectExpr("cast(id AS STRING) ip", "id total_bytes", "-id total_conns", "current_timestamp() last_seen")
    t = SensorTables(devices=devices)
    assert analyst.devices_report(t, "nonsense").count() == 80 and analyst.devices_report(t, limit=7).count() == 7
    assert analyst.devices_report(t, "conns", 1).first().ip == "0" and analyst.devices_report(t, "bytes", 1).first().ip == "79"
    assert Counter(analyst.sensors_present(spark.createDataFrame([("a",), ("a",)], "source_tool STRING")).collect()).total() == 1
    with pytest.raises(TypeError):
        SensorTables(nothing=devices)
