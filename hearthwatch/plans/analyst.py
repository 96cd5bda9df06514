"""Analyst queries: the preset reports, the read-only SQL entry, queue and allow-list reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import back, instant, recent_rows
from ..operators.inventory import byte_total
from ..operators.maintenance import unprocessed, upsert
from ..operators.silver import SensorTables
from ..schemas import SCAN_RESULT

DEVICE_ORDER = {"bytes": "total_bytes", "conns": "total_conns", "last_seen": "last_seen"}
QUERY_VIEWS = ("events", "devices", "external_ips", "oui_lookup", "geoip_lookup")


def _recent(df: DataFrame, as_of, hours: int) -> DataFrame:
    return recent_rows(df, as_of, f"{int(hours)} hours")


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of an ordered report; all of them without a limit."""
    return df if limit is None else df.limit(max(0, int(limit)))


def query_events(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """Run one read-only query over the temporary views; `limit` caps the answer.

    The text is placed as a derived table, so Spark's own grammar refuses anything that is not a query
    (commands, DDL, writes, several statements). Values that are not plain scalars come back as text.
    """
    text = sql.strip().rstrip(";")
    answer = _first(spark.sql(f"SELECT * FROM (\n{text}\n)"), limit)
    plain = (T.StringType, T.NumericType, T.BooleanType, T.NullType)
    return answer.select(*[
        answer[f"`{f.name}`"] if isinstance(f.dataType, plain) else answer[f"`{f.name}`"].cast("string").alias(f.name)
        for f in answer.schema.fields
    ])


def devices_report(t: SensorTables, sort_by: str = "bytes", limit: int | None = None) -> DataFrame:
    order = DEVICE_ORDER.get(sort_by, "total_bytes")
    return _first(t.devices.orderBy(F.desc(order), "ip"), limit)


def alerts_report(t: SensorTables, as_of, hours: int = 24, limit: int | None = None) -> DataFrame:
    rows = _recent(t.alerts.filter("log_type = 'eve'"), as_of, hours).select(
        "timestamp", "signature", F.col("severity_text").alias("severity"), "category", "src_ip", "dest_ip",
        "src_port", "dest_port")
    return _first(rows.orderBy(F.desc("timestamp"), *rows.columns[1:]), limit)


def external_report(t: SensorTables, country: str = "", limit: int | None = None) -> DataFrame:
    rows = t.external_ips
    if country:
        rows = rows.filter(F.col("country") == country.strip().upper()[:2])
    return _first(rows.orderBy(F.desc("total_conns"), "ip"), limit)


def dns_report(t: SensorTables, as_of, hours: int = 24, limit: int | None = None) -> DataFrame:
    rows = _recent(t.dns.filter("source_tool = 'zeek'"), as_of, hours)
    counts = rows.groupBy(F.col("query").alias("domain")).agg(F.count("*").alias("queries"))
    return _first(counts.orderBy(F.desc("queries"), "domain"), limit)


def protocol_report(t: SensorTables, as_of, hours: int = 24) -> DataFrame:
    return (
        _recent(t.conn, as_of, hours).groupBy(F.col("proto").alias("protocol"))
        .agg(F.count("*").alias("connections"), F.sum(byte_total()).alias("total_bytes"))
        .orderBy(F.desc("connections"), "protocol")
    )


def event_stats(t: SensorTables) -> DataFrame:
    return (
        t.activity.groupBy("source_tool", "log_type").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "source_tool", "log_type")
    )


def scan_history(scans: DataFrame, ip: str = "", limit: int | None = None) -> DataFrame:
    """Newest scans, optionally those whose target contains `ip`; the document is parsed where it is JSON."""
    rows = scans.filter(F.col("target").contains(ip)) if ip else scans
    newest = _first(rows.orderBy(F.desc("scanned_at"), F.desc("id")), limit)
    return newest.withColumn("document", F.from_json("results", SCAN_RESULT))


def allow_list(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.desc("added_at"), "ip")


def allow_list_check(entries: DataFrame, addresses: DataFrame) -> DataFrame:
    """Each asked address with its entry, if any."""
    return addresses.select("ip").join(entries, "ip", "left").select(
        "ip", F.col("added_at").isNotNull().alias("whitelisted"), "description", "added_at")


def allow_list_add(entries: DataFrame, addresses: DataFrame, as_of, description: str = "Added via chat") -> DataFrame:
    rows = addresses.select("ip", F.lit(description).alias("description"), instant(as_of).alias("added_at"))
    return upsert(entries, rows.dropDuplicates(["ip"]), "ip")


def allow_list_remove(entries: DataFrame, addresses: DataFrame) -> DataFrame:
    return entries.join(addresses.select("ip"), "ip", "left_anti")


def unprocessed_anomalies(anomalies: DataFrame, ledger: DataFrame) -> DataFrame:
    return unprocessed(anomalies, ledger).orderBy("detected_at", "id")


def table_sizes(**tables: DataFrame) -> DataFrame:
    """Row count per table, as one frame."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
              for name, df in tables.items()]
    result = counts[0]
    for part in counts[1:]:
        result = result.union(part)
    return result


def recent_anomalies(anomalies: DataFrame, n: int = 10) -> DataFrame:
    return (
        anomalies.select("id", "anomaly_type", "severity", "summary", "detected_at")
        .orderBy(F.desc("detected_at"), F.desc("id")).limit(n)
    )


def event_quality(events: DataFrame, as_of, retention_hours: int) -> DataFrame:
    """Expired rows, sensors present and rows with a flow id, in one pass over the raw events."""
    expired = F.col("timestamp") < back(as_of, f"{retention_hours} hours")
    return events.agg(
        F.count("*").alias("events"),
        F.count_if(expired).alias("expired"),
        F.count_distinct("source_tool").alias("source_tools"),
        F.count_if(F.col("raw").contains("community_id")).alias("with_flow_id"),
    )


def corpus_quality(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count("embedding").alias("with_vector"), F.count_if(F.col("embedding").isNull()).alias("without_vector"))


def sensors_present(events: DataFrame) -> DataFrame:
    return events.select("source_tool").distinct()
