"""Port-scan results: XML documents, stored JSON documents, one row per host and port."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCAN_HOST, SCAN_PORT, SCAN_RESULT

_XML_PORT = (
    "STRUCT<_portid STRING, _protocol STRING, state STRUCT<_state STRING>, "
    "service STRUCT<_name STRING, _version STRING, _product STRING>>"
)
# A host may carry several addresses or names; the first of each counts.
HOST_XML = (
    "status STRUCT<_state STRING>, address ARRAY<STRUCT<_addr STRING>>, "
    "hostnames STRUCT<hostname ARRAY<STRUCT<_name STRING>>>, "
    f"ports STRUCT<port ARRAY<{_XML_PORT}>>"
)
RUN_XML = f"host ARRAY<STRUCT<{HOST_XML}>>"


def _port(port: Column) -> Column:
    return F.struct(
        F.coalesce(port["_portid"].try_cast("int"), F.lit(0)).alias("port"),
        F.coalesce(port["_protocol"], F.lit("")).alias("protocol"),
        F.when(port["state"].isNotNull(), F.coalesce(port["state"]["_state"], F.lit(""))).alias("state"),
        F.when(port["service"].isNotNull(), F.coalesce(port["service"]["_name"], F.lit(""))).alias("service"),
        F.when(port["service"].isNotNull(), F.coalesce(port["service"]["_version"], F.lit(""))).alias("version"),
        F.when(port["service"].isNotNull(), F.coalesce(port["service"]["_product"], F.lit(""))).alias("product"),
    )


def _host(status: Column, address: Column, hostnames: Column, ports: Column) -> Column:
    return F.struct(
        F.coalesce(F.get(address, F.lit(0))["_addr"], F.lit("unknown")).alias("ip"),
        F.coalesce(F.get(hostnames["hostname"], F.lit(0))["_name"], F.lit("")).alias("hostname"),
        F.coalesce(status["_state"], F.lit("unknown")).alias("state"),
        F.coalesce(
            F.transform(ports["port"], _port), F.array().cast(f"ARRAY<{SCAN_PORT}>")
        ).alias("ports"),
    )


def read_scan_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per `host` element of the scan files."""
    hosts = spark.read.format("xml").option("rowTag", "host").schema(HOST_XML).load(path)
    return hosts.select(
        _host(F.col("status"), F.col("address"), F.col("hostnames"), F.col("ports")).alias("host")
    ).select("host.*")


def scan_documents(xml_rows: DataFrame, target: str = "target", scan_type: str = "scan_type",
                   xml: str = "xml") -> DataFrame:
    """XML text per scan to the stored result document (`results` STRUCT); unreadable XML has no hosts."""
    parsed = xml_rows.withColumn("_run", F.from_xml(xml, RUN_XML, {"mode": "PERMISSIVE"}))
    hosts = F.coalesce(
        F.transform(
            F.col("_run")["host"], lambda h: _host(h["status"], h["address"], h["hostnames"], h["ports"])
        ),
        F.array().cast(f"ARRAY<{SCAN_HOST}>"),
    )
    result = F.struct(
        F.col(target).alias("target"), F.col(scan_type).alias("scan_type"),
        F.size(hosts).alias("host_count"), hosts.alias("hosts"),
    )
    return parsed.withColumn("results", result.cast(SCAN_RESULT)).drop("_run")


def scan_host_ports(scans: DataFrame) -> DataFrame:
    """Stored scan documents (`results` JSON text) to one row per host and port; hosts without ports stay."""
    doc = scans.withColumn("_doc", F.from_json("results", SCAN_RESULT))
    hosts = doc.select("id", "scanned_at", "target", "scan_type", F.explode_outer("_doc.hosts").alias("h"))
    ports = hosts.select("*", F.explode_outer("h.ports").alias("p"))
    return ports.select(
        "id", "scanned_at", "target", "scan_type",
        F.col("h.ip").alias("ip"), F.col("h.hostname").alias("hostname"), F.col("h.state").alias("host_state"),
        F.col("p.port").alias("port"), F.col("p.protocol").alias("protocol"), F.col("p.state").alias("port_state"),
        F.col("p.service").alias("service"), F.col("p.version").alias("version"), F.col("p.product").alias("product"),
    )
