"""IPv4 arithmetic and the internal/external tests.

The tests are deliberately separate: each consumer of the data draws the line elsewhere, and merging them
would change results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# One pattern per test keeps the address a single reference, however the column is computed.
_PRIVATE = r"192\.168\.|10\.|172\.(1[6-9]|2.|3[01])\."
_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_QUAD = rf"^({_OCTET}\.){{3}}{_OCTET}$"
_CIDR = r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}(/[0-9]{1,2})?$"


def ip_to_long(ip: Column) -> Column:
    """Dotted quad to its 32-bit value as BIGINT; NULL unless it is exactly four octets of 0-255."""
    octets = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    return F.when(ip.rlike(_QUAD), reduce(lambda acc, o: acc * 256 + o, octets))


def register_ip_to_long(spark) -> None:
    """The same conversion for SQL text, as a temporary SQL function (no Python at run time)."""
    a, b, c, d = (f"try_cast(split_part(ip, '.', {i}) AS BIGINT)" for i in range(1, 5))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION ip_to_long(ip STRING) RETURNS BIGINT
        RETURN CASE WHEN ip RLIKE r'{_QUAD}' THEN (({a} * 256 + {b}) * 256 + {c}) * 256 + {d} END
    """)


def is_private(ip: Column) -> Column:
    """RFC 1918 by prefix: 10/8, 192.168/16, 172.16/12."""
    return ip.rlike(f"^({_PRIVATE})")


def is_external(ip: Column) -> Column:
    """Routable IPv4 destination: not private, no IPv6, no broadcast or any-address, not 224.* or 239.*."""
    return ~ip.rlike(rf"^({_PRIVATE}|224\.|239\.)|:|^(255\.255\.255\.255|0\.0\.0\.0)$")


def is_private_host(ip: Column) -> Column:
    """First-sight test on the live path; never NULL."""
    hit = ip.rlike(r"^(10\.|192\.168\.|172\.0*(1[6-9]|2[0-9]|3[01])(\.|$))[^:]*$")
    return F.coalesce(hit, F.lit(False))


def is_home_lan(ip: Column) -> Column:
    return ip.startswith("192.168.")


def is_lan_or_ten(ip: Column) -> Column:
    return ip.rlike(r"^(192\.168|10)\.")


def is_map_internal(ip: Column) -> Column:
    return ip.rlike(r"^(192\.168|10|172\.16)\.")


def is_outside_source(ip: Column) -> Column:
    """Inbound source: neither private nor IPv6 link-local."""
    return ~ip.rlike(f"^({_PRIVATE}|fe80:)")


def scan_target_in_scope(target: Column) -> Column:
    """True when an address or CIDR block lies wholly inside one private block; bad input gives False."""
    base = ip_to_long(F.split_part(target, F.lit("/"), F.lit(1)))
    length = F.when(target.contains("/"), F.split_part(target, F.lit("/"), F.lit(2)).try_cast("int")).otherwise(F.lit(32))
    size = F.when(length.between(0, 32), F.pow(F.lit(2.0), F.lit(32) - length).cast("bigint"))
    low = base - base % size
    high = low + size - 1
    blocks = [(10 << 24, 24), ((172 << 24) + (16 << 16), 20), ((192 << 24) + (168 << 16), 16)]
    inside = reduce(lambda a, b: a | b, [(low >= start) & (high <= start + (1 << bits) - 1) for start, bits in blocks])
    return F.coalesce(target.rlike(_CIDR) & inside, F.lit(False))
