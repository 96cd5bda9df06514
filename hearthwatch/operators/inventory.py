"""Device and external-host inventories.

Both start with one grouping on plain keys whose buffers are fixed-width numbers, so the bulk of the rows is
folded map-side by Spark's hash aggregate; text lists, latest values and modes are built from that much
smaller result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import is_external, is_private
from ..functions.payload import or_zero, to_int
from ..functions.text import sorted_list
from .enrich import with_country, with_vendor


def byte_total() -> Column:
    return or_zero(F.col("orig_bytes")) + or_zero(F.col("resp_bytes"))


def source_profile(conn: DataFrame, *parts: Column) -> DataFrame:
    """Private sources by (ip, mac, proto, service): the shared first step of the device summaries.

    With further keys `parts` these are partial profiles; any union of them folds to the same summaries.
    """
    return (
        conn.filter(is_private(F.col("orig_h")))
        .groupBy(*parts, F.col("orig_h").alias("ip"), "mac", "proto", "service")
        .agg(
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.count("*").alias("conns"),
            F.sum(byte_total()).alias("bytes"),
        )
    )


def _folded() -> list[Column]:
    return [
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("conns").alias("total_conns"),
        F.sum("bytes").alias("total_bytes"),
        sorted_list(F.collect_set("proto")).alias("protocols"),
        sorted_list(F.collect_set("service")).alias("services"),
    ]


def conn_stats(conn: DataFrame) -> DataFrame:
    """Connection statistics per (ip, mac)."""
    return source_profile(conn).groupBy("ip", "mac").agg(*_folded())


def latest_mac(profile: DataFrame) -> DataFrame:
    """Most recently seen non-empty MAC per IP; the larger MAC wins a tie."""
    return (
        profile.filter("mac != ''")
        .groupBy("ip")
        .agg(F.max(F.struct("last_seen", "mac")).alias("m"))
        .select("ip", F.col("m.mac").alias("conn_mac"), F.col("m.last_seen").alias("mac_seen"))
    )


def lease_profile(dhcp: DataFrame, *parts: Column) -> DataFrame:
    """Last renewal by (ip, mac, host name), in parts if further keys are given."""
    return (
        dhcp.filter("assigned_addr IS NOT NULL")
        .groupBy(*parts, F.col("assigned_addr").alias("ip"), "mac", "host_name")
        .agg(F.max("timestamp").alias("leased_at"))
    )


def latest_lease(dhcp: DataFrame) -> DataFrame:
    """MAC and host name of the newest lease per address (the name may be NULL there)."""
    return latest_of(lease_profile(dhcp))


def latest_of(leases: DataFrame) -> DataFrame:
    return (
        leases.groupBy("ip")
        .agg(F.max(F.struct("leased_at", "mac", "host_name")).alias("l"))
        .select(
            "ip", F.col("l.mac").alias("lease_mac"), F.col("l.host_name").alias("hostname"),
            F.col("l.leased_at").alias("leased_at"),
        )
    )


def ip_totals(profile: DataFrame) -> DataFrame:
    """Per-IP totals and merged lists over all of an IP's MACs."""
    return profile.groupBy("ip").agg(*_folded())


def device_inventory(conn: DataFrame, dhcp: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row per private source address: totals, protocol and service lists, MAC, host name, vendor."""
    return devices_of(source_profile(conn), lease_profile(dhcp), vendors)


def devices_of(sources: DataFrame, leases: DataFrame, vendors: DataFrame) -> DataFrame:
    """The device inventory from profiles, which may be partial ones."""
    newest = F.max(F.when(F.col("mac") != "", F.struct("last_seen", "mac")))["mac"]
    devices = sources.groupBy("ip").agg(*_folded(), newest.alias("conn_mac"))
    named = devices.join(latest_of(leases), "ip", "left").withColumn("mac", F.coalesce("conn_mac", "lease_mac"))
    return with_vendor(named, vendors).select(
        "ip", "mac", "manufacturer", "hostname", "first_seen", "last_seen", "total_conns", "total_bytes",
        "protocols", "services",
    )


def external_profile(conn: DataFrame, *parts: Column) -> DataFrame:
    """External destinations by (ip, client, service, port), in parts if further keys are given."""
    return (
        conn.filter(is_external(F.col("resp_h")))
        .groupBy(
            *parts, F.col("resp_h").alias("ip"), F.col("orig_h").alias("client"), "service",
            to_int(F.col("resp_p")).alias("port"),
        )
        .agg(F.count("*").alias("conns"), F.sum(byte_total()).alias("bytes"))
    )


def most_frequent(value: str, weight: str, where: Column) -> Column:
    """Mode over pre-counted values: the heaviest non-NULL value, the smallest one on a tie."""
    return F.min(F.when(where & F.col(value).isNotNull(), F.struct(-F.col(weight), F.col(value))))[value]


def external_clients(profile: DataFrame) -> DataFrame:
    """Edges (ip, client): which internal host met which external address, with connections and bytes.

    This is what grows with the traffic; an address with very many clients is many rows here, not one long text.
    """
    return profile.filter("client IS NOT NULL").groupBy("ip", "client").agg(F.sum("conns").alias("conns"), F.sum("bytes").alias("bytes"))


def external_totals(profile: DataFrame) -> DataFrame:
    """One row per external address from its profile, without country and clients.

    The profile is regrouped by address, by service and by port in one pass of grouping sets; the latter two key on the
    address *and* the facet. The last grouping sees one row per facet value.
    """
    facets = profile.groupingSets([["ip"], ["ip", "service"], ["ip", "port"]], "ip", "service", "port").agg(
        F.grouping_id().alias("facet"), F.sum("conns").alias("conns"), F.sum("bytes").alias("bytes"),
    )
    # grouping ids of the three sets above
    whole, by_service, by_port = (F.col("facet") == n for n in (3, 1, 2))
    return facets.groupBy("ip").agg(
        F.max(F.when(whole, F.col("conns"))).alias("total_conns"),
        F.max(F.when(whole, F.col("bytes"))).alias("total_bytes"),
        most_frequent("service", "conns", by_service).alias("top_service"),
        most_frequent("port", "conns", by_port).alias("top_dest_port"),
    )


def with_client_lists(externals: DataFrame, clients: DataFrame) -> DataFrame:
    """For display: addresses with their clients as one ordered text. Only the addresses given are listed."""
    lists = clients.join(externals.select("ip"), "ip", "left_semi").groupBy("ip").agg(
        sorted_list(F.collect_set("client")).alias("contacted_by"))
    return externals.join(lists, "ip", "left")


def external_inventory(conn: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row per external address with its country and, for display, its clients."""
    profile = external_profile(conn)
    return with_client_lists(with_country(external_totals(profile), ranges), external_clients(profile)).select(
        "ip", "country", "total_conns", "total_bytes", "contacted_by", "top_service", "top_dest_port"
    )
