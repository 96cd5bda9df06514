"""Domain tables cut from the generic test tables by integer arithmetic.

The expressions are written in SQL both Spark and the checking engine understand; `//` is integer division
and is rewritten for Spark. Each row of the generic `events` table becomes exactly one sensor record:

* view, click, signup -> a connection
* error               -> an alert, or every fifth one a protocol anomaly
* purchase            -> in turn a DHCP lease, a DNS answer of either sensor, a TLS handshake of either sensor
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.inventory import device_inventory, external_inventory
from .operators.silver import SensorTables
from .session import use_utc

AS_OF = "2024-01-31 00:00:00"
START = "2024-01-01 00:00:00"

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

LAN = "'192.168.' || ((user_id // 250) % 256) || '.' || (user_id % 250 + 1)"
ORIG = f"""CASE WHEN event_id % 499 = 4 THEN NULL
    WHEN event_id % 97 = 0 THEN (100 + event_id % 50) || '.' || (event_id % 13) || '.7.' || (event_id % 250 + 1)
    WHEN event_id % 89 = 1 THEN '172.' || (15 + user_id % 18) || '.' || (user_id % 250) || '.9'
    WHEN event_id % 101 = 2 THEN 'fe80::' || user_id
    WHEN event_id % 83 = 3 THEN '10.' || (user_id % 4) || '.0.' || (user_id % 250 + 1)
    ELSE {LAN} END"""
_J = "(event_id * 31 % 607)"
RESP = f"""CASE WHEN event_id % 239 = 11 THEN NULL
    WHEN event_id % 211 = 5 THEN '224.0.0.251' WHEN event_id % 223 = 6 THEN '239.255.255.250'
    WHEN event_id % 227 = 7 THEN '255.255.255.255' WHEN event_id % 229 = 9 THEN 'ff02::fb'
    WHEN event_id % 233 = 10 THEN 'printer.local'
    WHEN event_id % 4 = 0 THEN '192.168.' || ((event_id // 7) % 8) || '.' || (event_id % 250 + 1)
    WHEN event_id % 46 = 1 THEN '10.0.' || (event_id % 8) || '.' || (event_id % 250 + 1)
    ELSE (11 + {_J} % 180) || '.' || ({_J} * 7 % 256) || '.' || ({_J} * 13 % 256) || '.' || ({_J} % 254 + 1) END"""
PORT = f"""CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id // 2 % 5 = 0 THEN 443 WHEN event_id // 2 % 5 = 1 THEN 80
    WHEN event_id // 2 % 5 = 2 THEN 53 WHEN event_id // 2 % 5 = 3 THEN 22 ELSE 8000 + {K} END"""
PROTO = """CASE WHEN event_id % 71 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'udp' WHEN event_id % 5 = 1 THEN 'TCP'
    WHEN event_id % 5 = 2 THEN 'icmp' ELSE 'tcp' END"""
SERVICE = """CASE event_type WHEN 'view' THEN 'http' WHEN 'signup' THEN 'ssl'
    ELSE CASE event_id % 3 WHEN 1 THEN 'dns' WHEN 2 THEN 'ssl' END END"""
ORIG_BYTES = "CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(round(value * 1000) AS BIGINT) END"
RESP_NUMBER = """CASE WHEN event_id % 43 = 0 THEN NULL
    WHEN event_id % 37 = 0 THEN CAST(event_id % 1000 AS DOUBLE) + 0.5
    ELSE CAST(event_id * 17 % 5000 AS DOUBLE) END"""
DURATION = "CAST(event_id % 3000 AS DOUBLE) / 1000"
STATE = """CASE event_id % 6 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' WHEN 2 THEN 'REJ' WHEN 3 THEN 'RSTO' WHEN 4 THEN 'S1'
    ELSE 'OTH' END"""


def _hex(n: str) -> str:
    return f"lower(lpad(hex({n}), 2, '0'))"


MAC_OF_USER = f"'00:00:' || {_hex('user_id % 120')} || ':aa:' || {_hex('(user_id // 256) % 256')} || ':' || " \
              f"{_hex('user_id % 256')}"
MAC = f"""CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 23 = 0 THEN NULL
    WHEN user_id % 5 = 0 AND event_id % 2 = 1 THEN '00:00:' || {_hex('user_id % 7')} || ':bb:00:' || {_hex('user_id % 256')}
    WHEN user_id % 11 = 3 THEN NULL
    ELSE {MAC_OF_USER} END"""
FLOW_ID = "CASE WHEN event_id % 10 = 9 THEN NULL ELSE '1:' || (event_id // 3) END"

SIGNATURE = """CASE WHEN event_id % 11 = 3 THEN 'SIG 3 "50%_off" é' ELSE 'SIG ' || (event_id % 11) END"""
CATEGORY = "'Category ' || (event_id % 11 % 4)"
SEVERITY = "CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 3 + 1 END"

DOMAIN = "CASE WHEN event_id % 47 = 0 THEN NULL ELSE 'host' || (event_id * 7 % 53) || '.example.com' END"
QTYPE = "CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'MX' ELSE 'TXT' END"
RCODE = "CASE WHEN event_id % 3 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END"
SNI = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'www' || (event_id * 3 % 41) || '.example.org' END"
TLS_VERSION = "CASE event_id % 3 WHEN 0 THEN 'TLS 1.2' WHEN 1 THEN 'TLS 1.3' ELSE 'TLSv1' END"
JA3 = "CASE WHEN event_id % 19 = 0 THEN NULL ELSE lower(lpad(hex(event_id * 11 % 37), 8, '0')) END"

LEASE_MAC = f"CASE WHEN user_id % 13 = 0 THEN NULL ELSE {MAC_OF_USER} END"
HOST_NAME = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'host-' || user_id END"
LEASE_TIME = "CAST(3600 + event_id % 7 AS DOUBLE)"

IS_CONN = "event_type IN ('view', 'click', 'signup')"
IS_ALERT = "event_type = 'error' AND event_id % 5 <> 0"
IS_EVE_ANOMALY = "event_type = 'error' AND event_id % 5 = 0"
IS_DHCP = "event_type = 'purchase' AND event_id % 5 = 0"
IS_EVE_DNS = "event_type = 'purchase' AND event_id % 5 = 1"
IS_ZEEK_DNS = "event_type = 'purchase' AND event_id % 5 = 2"
IS_EVE_TLS = "event_type = 'purchase' AND event_id % 5 = 3"
IS_ZEEK_TLS = "event_type = 'purchase' AND event_id % 5 = 4"
IS_EVE = f"(event_type = 'error' OR ({IS_EVE_DNS}) OR ({IS_EVE_TLS}))"

TOOL = f"CASE WHEN {IS_EVE} THEN 'suricata' ELSE 'zeek' END"
LOG = (
    f"CASE WHEN {IS_EVE} THEN 'eve' WHEN {IS_DHCP} THEN 'dhcp' WHEN {IS_ZEEK_DNS} THEN 'dns' "
    f"WHEN {IS_ZEEK_TLS} THEN 'ssl' ELSE 'conn' END"
)
EVE_TYPE = (
    f"CASE WHEN {IS_ALERT} THEN 'alert' WHEN {IS_EVE_ANOMALY} THEN 'anomaly' WHEN {IS_EVE_DNS} THEN 'dns' "
    f"WHEN {IS_EVE_TLS} THEN 'tls' END"
)
# DHCP records name no source or destination
SRC = f"CASE WHEN {IS_DHCP} THEN NULL ELSE {ORIG} END"
DEST = f"CASE WHEN {IS_CONN} OR event_type = 'error' THEN {RESP} END"
ACTIVITY_PROTO = f"CASE WHEN {IS_CONN} THEN {PROTO} WHEN {IS_ALERT} THEN 'TCP' END"

# name -> (row filter, output column -> expression)
SILVER = {
    "conn": (IS_CONN, {
        "timestamp": "ts", "uid": "'C' || event_id", "orig_h": ORIG, "resp_h": RESP,
        "resp_p": f"CAST({PORT} AS STRING)", "proto": PROTO, "service": SERVICE,
        "duration": f"CAST({DURATION} AS STRING)", "orig_bytes": ORIG_BYTES,
        "resp_bytes": f"<half_even>{RESP_NUMBER}</half_even>", "conn_state": STATE, "mac": MAC, "community_id": FLOW_ID,
    }),
    "dhcp": (IS_DHCP, {
        "timestamp": "ts", "assigned_addr": LAN, "mac": LEASE_MAC, "host_name": HOST_NAME,
        "server_addr": "'192.168.0.1'", "domain": "'lan'", "lease_time": LEASE_TIME,
    }),
    "alerts": (IS_ALERT, {
        "timestamp": "ts", "log_type": "'eve'", "signature": SIGNATURE, "category": CATEGORY,
        "severity_text": f"CAST({SEVERITY} AS STRING)", "severity": f"CAST({SEVERITY} AS INT)", "src_ip": ORIG,
        "dest_ip": RESP, "src_port": "CAST(40000 + event_id % 20000 AS STRING)",
        "dest_port": f"CAST({PORT} AS STRING)", "proto": "'TCP'", "community_id": FLOW_ID,
    }),
    "dns": (f"({IS_EVE_DNS}) OR ({IS_ZEEK_DNS})", {
        "timestamp": "ts", "source_tool": TOOL, "domain": DOMAIN, "query_type": QTYPE,
        "rrname": f"CASE WHEN {IS_EVE_DNS} THEN {DOMAIN} END", "rcode": f"CASE WHEN {IS_EVE_DNS} THEN {RCODE} END",
        "query": f"CASE WHEN {IS_ZEEK_DNS} THEN {DOMAIN} END", "src_ip": f"CASE WHEN {IS_EVE_DNS} THEN {ORIG} END",
    }),
    "tls": (f"({IS_EVE_TLS}) OR ({IS_ZEEK_TLS})", {
        "timestamp": "ts", "source_tool": TOOL, "tls_version": TLS_VERSION,
        "eve_version": f"CASE WHEN {IS_EVE_TLS} THEN {TLS_VERSION} END",
        "sni": f"CASE WHEN {IS_EVE_TLS} THEN {SNI} END", "ja3_hash": f"CASE WHEN {IS_EVE_TLS} THEN {JA3} END",
    }),
    "activity": ("event_id IS NOT NULL", {
        "timestamp": "ts", "source_tool": TOOL, "log_type": LOG, "event_type": EVE_TYPE,
        "event_class": f"CASE WHEN {IS_EVE} THEN {EVE_TYPE} ELSE {LOG} END", "src_ip": SRC, "dest_ip": DEST,
        "proto": ACTIVITY_PROTO,
    }),
}


def spark_sql(expression: str) -> str:
    half_even = expression.replace("<half_even>", "CAST(bround(").replace("</half_even>", ") AS BIGINT)")
    return half_even.replace("//", "div")


# declared, so that building a query needs no job to read file footers
SOURCE_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}


def _source(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    use_utc(spark)
    return spark.read.schema(SOURCE_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def silver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One typed table straight from the generic columns."""
    return _typed(_source(spark, sf_dir), name)


def silver_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream, with a TIMESTAMP event time for watermarks."""
    use_utc(spark)
    # as a pattern, so that the table may be one file or a folder of files
    rows = spark.readStream.schema(SOURCE_SCHEMAS["events"]).parquet(f"{sf_dir}/events.parque[t]")
    return _typed(rows, name).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _typed(rows: DataFrame, name: str) -> DataFrame:
    where, columns = SILVER[name]
    return rows.filter(where).select(*[F.expr(spark_sql(e)).alias(c) for c, e in columns.items()])


KINDS = {
    "conn": IS_CONN, "alert": IS_ALERT, "anomaly": IS_EVE_ANOMALY, "dhcp": IS_DHCP, "eve_dns": IS_EVE_DNS,
    "zeek_dns": IS_ZEEK_DNS, "eve_tls": IS_EVE_TLS, "zeek_tls": IS_ZEEK_TLS,
}
# payload field -> (kinds that carry it, prepared column or expression)
_ZEEK_FLOW = ("conn", "zeek_dns", "zeek_tls")
_EVE = ("alert", "anomaly", "eve_dns", "eve_tls")
PAYLOAD = {
    "event_type": (_EVE, EVE_TYPE),
    "uid": (("conn",), "'C' || event_id"),
    "id.orig_h": (_ZEEK_FLOW, "orig"),
    "id.resp_h": (("conn",), "resp"),
    "id.resp_p": (("conn",), "port"),
    "src_ip": (_EVE, "orig"),
    "dest_ip": (("alert", "anomaly"), "resp"),
    "src_port": (("alert",), "40000 + event_id % 20000"),
    "dest_port": (("alert",), "port"),
    "proto": (("conn", "alert"), f"CASE WHEN event_type = 'error' THEN 'TCP' ELSE {PROTO} END"),
    "service": (("conn",), SERVICE),
    "duration": (("conn",), DURATION),
    "orig_bytes": (("conn",), ORIG_BYTES),
    "resp_bytes": (("conn",), RESP_NUMBER),
    "conn_state": (("conn",), STATE),
    "orig_l2_addr": (("conn",), MAC),
    "community_id": (("conn", "alert"), FLOW_ID),
    "alert": (("alert",), f"named_struct('signature', {SIGNATURE}, 'category', {CATEGORY}, 'severity', {SEVERITY})"),
    "assigned_addr": (("dhcp",), LAN),
    "mac": (("dhcp",), LEASE_MAC),
    "host_name": (("dhcp",), HOST_NAME),
    "server_addr": (("dhcp",), "'192.168.0.1'"),
    "domain": (("dhcp",), "'lan'"),
    "lease_time": (("dhcp",), LEASE_TIME),
    "query": (("zeek_dns",), DOMAIN),
    "qtype_name": (("zeek_dns",), QTYPE),
    "dns": (("eve_dns",), f"named_struct('rrname', {DOMAIN}, 'rrtype', {QTYPE}, 'rcode', {RCODE})"),
    "server_name": (("zeek_tls",), SNI),
    "version": (("zeek_tls",), TLS_VERSION),
    "tls": (("eve_tls",), f"named_struct('sni', {SNI}, 'version', {TLS_VERSION}, 'ja3', named_struct('hash', {JA3}))"),
}


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table with JSON payloads: one scan, one record per generic row."""
    prepared = _source(spark, sf_dir).select(
        "ts", "event_id", "user_id", "event_type", "value",
        F.expr(spark_sql(TOOL)).alias("source_tool"),
        F.expr(spark_sql(LOG)).alias("log_type"), F.expr(spark_sql(ORIG)).alias("orig"),
        F.expr(spark_sql(RESP)).alias("resp"), F.expr(spark_sql(PORT)).alias("port"),
    )
    # fields a kind does not carry are NULL, and NULL fields are left out of the JSON
    fields = [
        F.expr(spark_sql(f"CASE WHEN {' OR '.join(f'({KINDS[k]})' for k in kinds)} THEN {e} END")).alias(name)
        for name, (kinds, e) in PAYLOAD.items()
    ]
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    hour = F.date_format("ts", "yyyy-MM-dd-HH")
    return prepared.select(
        F.col("ts").alias("timestamp"), "source_tool", "log_type",
        F.concat(F.lit("/logs/staged/"), "source_tool", F.lit("/"), "log_type", F.lit("/"), hour, F.lit(".ndjson"))
        .alias("source_file"),
        F.to_json(F.struct(stamp, *fields)).alias("raw"),
    )


# supplier -> MAC vendors, nation -> 25 IPv4 slices with gaps; three of the codes are on the watch list
VENDOR_PREFIX = "lpad(hex(s_suppkey), 6, '0')"
COUNTRY = (
    "CASE n_nationkey WHEN 3 THEN 'CN' WHEN 7 THEN 'RU' WHEN 11 THEN 'KP' ELSE "
    "chr(CAST(65 + n_nationkey AS INT)) || chr(CAST(90 - n_nationkey AS INT)) END"
)
RANGE_START = "CAST(n_nationkey AS BIGINT) * 171798691"
RANGE_END = "CAST(n_nationkey AS BIGINT) * 171798691 + 160000000"


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir, "supplier").select(
        F.expr(VENDOR_PREFIX).alias("oui_prefix"), F.col("s_name").alias("manufacturer"))


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir, "nation").select(
        F.expr(RANGE_START).alias("ip_start"), F.expr(RANGE_END).alias("ip_end"), F.expr(COUNTRY).alias("country"))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device_inventory(silver(spark, sf_dir, "conn"), silver(spark, sf_dir, "dhcp"), vendors(spark, sf_dir))


def external_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external_inventory(silver(spark, sf_dir, "conn"), ip_ranges(spark, sf_dir))


def sensor_tables(spark: SparkSession, sf_dir: str) -> SensorTables:
    """All tables; a query only builds the ones it reads."""
    return SensorTables(
        **{name: partial(silver, spark, sf_dir, name) for name in SILVER},
        devices=partial(devices, spark, sf_dir), external_ips=partial(external_ips, spark, sf_dir),
    )
