import pytest
from pyspark.sql import functions as F

from hearthwatch.functions import ip as ipf
from hearthwatch.functions import payload, text, timing, vectors


def values(spark, items, expr, typ="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i INT, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_json_numbers(spark):
    got = values(spark, [None, "7", "12.5", "13.5", "12.7", "-12.5", "x", "3000000000", "1e3", ""], payload.to_long)
    assert got == [None, 7, 12, 14, 13, -12, None, 3000000000, 1000, None]
    assert values(spark, ["3000000000", "443", "443.0"], payload.to_int) == [None, 443, 443]


def test_json_text_handles_dotted_keys_and_null(spark):
    raw = ['{"id.orig_h":"1.2.3.4","a":{"b":5}}', '{"id.orig_h":null}', "{}"]
    assert values(spark, raw, lambda c: payload.json_text(c, "id.orig_h")) == ["1.2.3.4", None, None]
    assert values(spark, raw, lambda c: payload.json_text(c, "a", "b")) == ["5", None, None]


def test_event_time(spark, now):
    stamps = ["2024-01-01T00:00:00+0000", "2024-01-01T00:00:00Z", "2024-01-01T02:00:00.250+0200", "soon", None]
    got = values(spark, stamps, lambda c: payload.event_time(c, F.lit(now)).cast("string"))
    assert got == ["2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00.25"] + ["2024-01-31 00:00:00"] * 2
    assert values(spark, ["1704067200.987"], lambda c: payload.epoch_seconds(c).cast("string")) == ["2024-01-01 00:00:00"]


def test_ip_to_long(spark):
    ips = ["0.0.0.0", "1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "10.foo", "", None, "fe80::1"]
    want = [0, 16909060, 4294967295] + [None] * 7
    assert values(spark, ips, ipf.ip_to_long) == want
    ipf.register_ip_to_long(spark)
    assert values(spark, ips, lambda c: F.expr("ip_to_long(v)")) == want


INSIDE = ["192.168.1.5", "10.0.0.1", "172.16.0.9", "172.20.0.1", "172.29.1.1", "172.31.255.255"]
OUTSIDE = ["8.8.8.8", "1.1.1.1", "172.15.0.1", "172.32.0.1", "172.2.1.1", "fe80::1", "999.1.1.1", ""]


def test_private_tests_agree_on_plain_addresses(spark):
    assert values(spark, INSIDE, ipf.is_private) == [True] * len(INSIDE)
    assert values(spark, OUTSIDE, ipf.is_private) == [False] * len(OUTSIDE)
    assert values(spark, INSIDE, ipf.is_private_host) == [True] * len(INSIDE)
    assert values(spark, [*OUTSIDE, None], ipf.is_private_host) == [False] * (len(OUTSIDE) + 1)
    assert values(spark, ["172.16", "172.016.1.1", "172.200.1.1", "10.1::2"], ipf.is_private_host) == [True, True, False, False]


def test_external_boundaries(spark):
    kept = ["8.8.8.8", "225.0.0.1", "238.1.1.1", "127.0.0.1", "169.254.1.1", "172.32.0.1"]
    dropped = ["224.0.0.1", "239.1.1.1", "255.255.255.255", "0.0.0.0", "ff02::1", "172.25.3.4", "10.1.1.1"]
    assert values(spark, kept, ipf.is_external) == [True] * len(kept)
    assert values(spark, dropped, ipf.is_external) == [False] * len(dropped)
    assert values(spark, [None], ipf.is_external) == [None]


def test_narrow_tests(spark):
    ips = ["192.168.1.1", "10.1.1.1", "172.16.1.1", "172.17.1.1", "fe80::1", "8.8.8.8"]
    assert values(spark, ips, ipf.is_home_lan) == [True, False, False, False, False, False]
    assert values(spark, ips, ipf.is_lan_or_ten) == [True, True, False, False, False, False]
    assert values(spark, ips, ipf.is_map_internal) == [True, True, True, False, False, False]
    assert values(spark, ips, ipf.is_outside_source) == [False, False, False, False, False, True]


@pytest.mark.parametrize("target,ok", [
    ("192.168.1.0/24", True), ("10.0.0.0/8", True), ("10.0.0.0/7", False), ("172.16.0.0/12", True),
    ("172.16.0.0/11", False), ("192.168.1.7", True), ("8.8.8.8", False), ("192.168.0.0/33", False), ("host", False),
    ("", False), (None, False), ("10.1.2.3/8", True), ("0.0.0.0/0", False), ("192.168.1.0/x", False),
])
def test_scan_scope(spark, target, ok):
    assert values(spark, [target], ipf.scan_target_in_scope) == [ok]


def test_text_helpers(spark):
    assert values(spark, ["de:ad:be:ef:ca:fe", "", None], text.mac_prefix) == ["DEADBE", "", None]
    assert values(spark, ["de:ad:9", None], lambda c: text.masked_mac(c, False)) == ["**:**:*", "N/*"]
    assert values(spark, ["aa", None], lambda c: text.masked_mac(c, True)) == ["aa", None]
    assert values(spark, [1, 2, 3, 4, None], text.severity_label, "INT") == ["High", "Medium", "Low", "Unknown", "Unknown"]
    assert values(spark, [["b", "a"], [], None], text.sorted_list, "ARRAY<STRING>") == ["a, b", None, None]


def test_look_back_is_open_at_the_start_and_closed_at_the_end(spark, now):
    stamps = ["2024-01-30 23:55:00", "2024-01-30 23:55:01", "2024-01-31 00:00:00", "2024-01-31 00:00:01"]
    got = values(spark, stamps, lambda c: timing.within(c.cast("timestamp"), now, "5 minutes"))
    assert got == [False, True, True, False]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(0.8) and got[2:] == [None, None]
