"""Typed tables cut from the events' payloads, with only the needed leaves."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions.payload import json_text, to_double, to_int, to_long
from ..sources.tables import days_between, write_by_day


PAYLOAD = "payload"  # column of events that holds the parsed document


def _is(tool: str, log: str | None = None) -> Column:
    hit = F.col("source_tool") == tool
    return hit if log is None else hit & (F.col("log_type") == log)


def _leaves(payload: Column, fields: StructType, path: str = "$") -> Column:
    """The wanted leaves of a parsed document as text, in the shape of `fields`."""
    return F.struct(*[
        (_leaves(payload, f.dataType, f"{path}['{f.name}']") if isinstance(f.dataType, StructType)
         else F.try_variant_get(payload, f"{path}['{f.name}']", "string")).alias(f.name)
        for f in fields.fields
    ])


def _parsed(events: DataFrame, schema: str) -> DataFrame:
    """Payload leaves as struct `p`: from the parsed `payload` if the events have one, else from their text."""
    if PAYLOAD in events.columns:
        return events.withColumn("p", _leaves(F.col(PAYLOAD), StructType.fromDDL(schema)))
    return events.withColumn("p", F.from_json("raw", schema))


def with_payload(events: DataFrame) -> DataFrame:
    """Events with their text parsed once, to be stored: every table below then reads single fields of it."""
    return events.withColumn(PAYLOAD, F.try_parse_json("raw"))


def conn(events: DataFrame, *keep: str) -> DataFrame:
    """Zeek connections.

    A parsed payload keeps the value of a decimal number but not its digits (2.0 becomes 2); the duration is shown as it was
    logged, so that one field is read from the text.
    """
    duration = json_text(F.col("raw"), "duration") if PAYLOAD in events.columns else F.col("p.duration")
    return _parsed(events.filter(_is("zeek", "conn")), schemas.CONN_PAYLOAD).select(
        *keep, "timestamp",
        F.col("p.uid").alias("uid"),
        F.col("p.`id.orig_h`").alias("orig_h"),
        F.col("p.`id.resp_h`").alias("resp_h"),
        F.col("p.`id.resp_p`").alias("resp_p"),
        F.col("p.proto").alias("proto"),
        F.col("p.service").alias("service"),
        duration.alias("duration"),
        to_long(F.col("p.orig_bytes")).alias("orig_bytes"),
        to_long(F.col("p.resp_bytes")).alias("resp_bytes"),
        F.col("p.conn_state").alias("conn_state"),
        F.col("p.orig_l2_addr").alias("mac"),
        F.col("p.community_id").alias("community_id"),
    )


def dhcp(events: DataFrame, *keep: str) -> DataFrame:
    """Zeek DHCP leases."""
    return _parsed(events.filter(_is("zeek", "dhcp")), schemas.DHCP_PAYLOAD).select(
        *keep, "timestamp",
        F.col("p.assigned_addr").alias("assigned_addr"),
        F.col("p.mac").alias("mac"),
        F.col("p.host_name").alias("host_name"),
        F.col("p.server_addr").alias("server_addr"),
        F.col("p.domain").alias("domain"),
        to_double(F.col("p.lease_time")).alias("lease_time"),
    )


def alerts(events: DataFrame, *keep: str) -> DataFrame:
    """Suricata alerts."""
    return (
        _parsed(events.filter(_is("suricata")), schemas.ALERT_PAYLOAD)
        .filter(F.col("p.event_type") == "alert")
        .select(
            *keep, "timestamp",
            "log_type",
            F.col("p.alert.signature").alias("signature"),
            F.col("p.alert.category").alias("category"),
            F.col("p.alert.severity").alias("severity_text"),
            to_int(F.col("p.alert.severity")).alias("severity"),
            F.col("p.src_ip").alias("src_ip"),
            F.col("p.dest_ip").alias("dest_ip"),
            F.col("p.src_port").alias("src_port"),
            F.col("p.dest_port").alias("dest_port"),
            F.col("p.proto").alias("proto"),
            F.col("p.community_id").alias("community_id"),
        )
    )


def dns(events: DataFrame, *keep: str) -> DataFrame:
    """DNS records of both sensors."""
    wanted = _is("zeek", "dns") | (_is("suricata") & (F.col("p.event_type") == "dns"))
    return (
        _parsed(events.filter(_is("zeek", "dns") | _is("suricata")), schemas.DNS_PAYLOAD)
        .filter(wanted)
        .select(
            *keep, "timestamp",
            "source_tool",
            F.coalesce(F.col("p.dns.rrname"), F.col("p.query")).alias("domain"),
            F.coalesce(F.col("p.dns.rrtype"), F.col("p.qtype_name")).alias("query_type"),
            F.col("p.dns.rrname").alias("rrname"),
            F.col("p.dns.rcode").alias("rcode"),
            F.col("p.query").alias("query"),
            F.col("p.src_ip").alias("src_ip"),
        )
    )


def tls(events: DataFrame, *keep: str) -> DataFrame:
    """TLS handshakes of both sensors."""
    wanted = _is("zeek", "ssl") | (_is("suricata") & (F.col("p.event_type") == "tls"))
    return (
        _parsed(events.filter(_is("zeek", "ssl") | _is("suricata")), schemas.TLS_PAYLOAD)
        .filter(wanted)
        .select(
            *keep, "timestamp",
            "source_tool",
            F.coalesce(F.col("p.tls.version"), F.col("p.version")).alias("tls_version"),
            F.col("p.tls.version").alias("eve_version"),
            F.col("p.tls.sni").alias("sni"),
            F.col("p.tls.ja3.hash").alias("ja3_hash"),
        )
    )


def activity(events: DataFrame, *keep: str) -> DataFrame:
    """Every event with the few fields both sensors share."""
    return _parsed(events, schemas.ACTIVITY_PAYLOAD).select(
        *keep, "timestamp",
        "source_tool",
        "log_type",
        F.col("p.event_type").alias("event_type"),
        F.when(F.col("source_tool") == "suricata", F.col("p.event_type"))
        .otherwise(F.col("log_type")).alias("event_class"),
        F.coalesce(F.col("p.src_ip"), F.col("p.`id.orig_h`")).alias("src_ip"),
        F.coalesce(F.col("p.dest_ip"), F.col("p.`id.resp_h`")).alias("dest_ip"),
        F.col("p.proto").alias("proto"),
    )


BUILDERS = {"conn": conn, "dhcp": dhcp, "alerts": alerts, "dns": dns, "tls": tls, "activity": activity}


def read_silver(spark: SparkSession, root: str, name: str, days: tuple | None = None) -> DataFrame:
    """One stored silver table, with the schema its builder declares (so an empty table reads too).

    `days` is the time range (start, end) that will be asked for: other days are not listed or opened.
    """
    schema = BUILDERS[name](spark.createDataFrame([], schemas.EVENTS)).schema.add("event_date", "date")
    table = spark.read.schema(schema).parquet(f"{root}/{name}")
    return table if days is None else table.filter(days_between(*days))


class SensorTables:
    """The silver tables every later operator reads, plus the two summaries the panels join.

    A table is given as a DataFrame or as a function that builds one on first use, so a query only analyses
    the tables it touches.
    """

    NAMES = (*BUILDERS, "devices", "external_ips")

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(self.NAMES)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        self._tables = dict(tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        table = self._tables[name]
        if callable(table):
            table = self._tables[name] = table()
        return table

    @classmethod
    def from_events(cls, events: DataFrame, **summaries) -> "SensorTables":
        return cls(**{name: partial(build, events) for name, build in BUILDERS.items()}, **summaries)

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, days: tuple | None = None, **summaries) -> "SensorTables":
        return cls(**{name: partial(read_silver, spark, root, name, days) for name in BUILDERS}, **summaries)


def write_silver(events: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Parse the raw events once per payload kind and store the typed tables by day."""
    for name, build in BUILDERS.items():
        write_by_day(build(events), f"{root}/{name}", mode)
