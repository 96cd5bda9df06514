"""Joins, folds, upkeep and search against brute force."""

import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import NOW, ago
from pyspark.sql import functions as F

from hearthwatch import schemas
from hearthwatch.config import Settings
from hearthwatch.operators import baselines, cooldown, correlate, enrich, maintenance, rules, similarity


def ip_text(n):
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def test_range_join_equals_naive_join(spark):
    rnd = random.Random(1)
    cuts = sorted(rnd.sample(range(2**32), 80))
    ranges = [(a, b - 1 - (i % 3), f"{i:02d}") for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
    ranges += [(5 * 65536 + 10, 5 * 65536 + 10, "ON"), (3 * 65536 - 2, 3 * 65536 + 2, "XB")]
    ips = [rnd.randrange(2**32) for _ in range(300)] + [e for a, b, _ in ranges for e in (a, b, a - 1, b + 1) if 0 <= e < 2**32]
    df = spark.createDataFrame([(ip_text(n),) for n in sorted(set(ips))] + [(None,), ("bad",)], "ip STRING")
    got = sorted((r.ip or "", r.country or "") for r in enrich.with_country(df, spark.createDataFrame(ranges, schemas.IP_RANGES)).collect())
    want = []
    for n in sorted(set(ips)):
        hits = [c for a, b, c in ranges if a <= n <= b]
        want += [(ip_text(n), c) for c in (hits or [""])]
    assert got == sorted(want + [("", ""), ("bad", "")])


def test_replayed_baseline_equals_fold(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for d in range(6):
        series = [[rnd.random() * 1e6, float(rnd.randrange(50)), float(rnd.randrange(9))] for _ in range(1 + d * 7)]
        state = series[0]
        for x in series[1:]:
            state = [0.3 * a + 0.7 * e for a, e in zip(x, state)]
        want[f"192.168.0.{d}"] = (state, len(series))
        rows += [(f"192.168.0.{d}", NOW + timedelta(minutes=5 * i), *x) for i, x in enumerate(series)]
    rnd.shuffle(rows)
    windows = spark.createDataFrame(rows, "ip STRING, window_start TIMESTAMP, bytes_5min DOUBLE, conns_5min DOUBLE, dest_ips DOUBLE")
    for r in baselines.replayed_baselines(windows).collect():
        state, n = want[r.ip]
        assert r.samples == n
        assert [r.avg_bytes_5min, r.avg_conns_5min, r.avg_dest_ips] == pytest.approx(state, rel=1e-9)


def test_baseline_update_seeds_blends_and_leaves_idle_rows(spark, now):
    state = spark.createDataFrame([("a", "old", 100.0, 10.0, 1.0, 4, ago(hours=1)), ("idle", "v", 1.0, 1.0, 1.0, 2, ago(hours=2))],
                                  schemas.BASELINES)
    current = spark.createDataFrame([("a", 200.0, 20.0, 3.0), ("new", 5.0, 1.0, 1.0)],
                                    "ip STRING, bytes_5min DOUBLE, conns_5min DOUBLE, dest_ips DOUBLE")
    devices = spark.createDataFrame([("a", "vendor")], "ip STRING, manufacturer STRING")
    got = {r.ip: r for r in baselines.updated_baselines(state, current, devices, now).collect()}
    assert got["a"].avg_bytes_5min == pytest.approx(130.0) and got["a"].samples == 5 and got["a"].manufacturer == "vendor"
    assert got["new"].avg_bytes_5min == 5.0 and got["new"].samples == 1 and got["new"].manufacturer is None
    assert got["idle"].samples == 2 and got["idle"].manufacturer == "v" and got["idle"].avg_conns_5min == 1.0
    assert got["a"].updated_at != got["idle"].updated_at


def greedy(minutes, wait=60):
    kept = []
    for m in sorted(set(minutes)):
        if not kept or m - kept[-1] >= wait:
            kept.append(m)
    return kept


def test_cooldown_replay(spark):
    rnd = random.Random(3)
    series = {"fixed": [0, 10, 30, 59, 60, 100, 125], **{f"k{i}": [rnd.randrange(3000) for _ in range(150)] for i in range(4)}}
    rows = [("t", k, NOW + timedelta(minutes=m)) for k, ms in series.items() for m in ms]
    got = cooldown.replayed_cooldown(spark.createDataFrame(rows, "anomaly_type STRING, dedup_key STRING, detected_at TIMESTAMP"), 60, "1 minute")
    found = {}
    for r in got.collect():
        found.setdefault(r.dedup_key, []).append(round((r.detected_at.astimezone(NOW.tzinfo) - NOW).total_seconds() / 60))
    assert {k: sorted(v) for k, v in found.items()} == {k: greedy(ms) for k, ms in series.items()}
    assert sorted(found["fixed"]) == [0, 60, 125]


@pytest.mark.parametrize("minutes,kept", [(59, 0), (60, 1), (61, 1)])
def test_cooldown_edges(spark, now, minutes, kept):
    history = spark.createDataFrame([(1, ago(minutes=minutes), "t", "k", "", "", "")], schemas.ANOMALIES)
    one = spark.createDataFrame([("k",)], "dedup_key STRING")
    assert cooldown.throttled_by_key(one, history, "t", 60, now).count() == kept
    assert cooldown.throttled_by_type(one, history, "t", 60, now).count() == kept
    assert cooldown.throttled_by_key(one, history, "other", 60, now).count() == 1


def test_alert_flow_join(spark, now):
    alerts = spark.createDataFrame(
        [(ago(minutes=1), "s1", 1, "a", "b", "1:x"), (ago(minutes=2), "s2", 1, "a", "b", None), (ago(minutes=3), "s3", 1, "a", "b", "1:y")],
        "timestamp TIMESTAMP, signature STRING, severity INT, src_ip STRING, dest_ip STRING, community_id STRING")
    conn = spark.createDataFrame([("1:x", "1.0", 1, 1, "SF"), ("1:x", "2.0", 1, 1, "S0"), (None, "3.0", 1, 1, "SF")],
                                 "community_id STRING, duration STRING, orig_bytes BIGINT, resp_bytes BIGINT, conn_state STRING")
    full = sorted((r.alert_signature, r.zeek_duration or "") for r in correlate.alerts_with_flows(alerts, conn).collect())
    assert full == [("s1", "1.0"), ("s1", "2.0"), ("s2", ""), ("s3", "")]
    newest = [(r.alert_signature, r.zeek_duration) for r in correlate.newest_alerts_with_flows(alerts, conn, 3).collect()]
    assert newest == [("s1", "1.0"), ("s1", "2.0"), ("s2", None)]


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_keyed_upkeep(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, v INT")
    new = spark.createDataFrame([("b", 20), ("c", 30)], "k STRING, v INT")
    assert pairs(maintenance.upsert(table, new, "k")) == [("a", 1), ("b", 20), ("c", 30)]
    assert pairs(maintenance.insert_missing(table, new, "k")) == [("a", 1), ("b", 2), ("c", 30)]
    assert pairs(maintenance.delete_keys(table, new, "k")) == [("a", 1)]
    assert pairs(maintenance.last_by_key(table.union(new), F.col("v"), "k")) == [("a", 1), ("b", 20), ("c", 30)]


def test_retention(spark, now):
    df = spark.createDataFrame([(1, ago(hours=72)), (2, ago(hours=72, seconds=1)), (3, now)], "i INT, timestamp TIMESTAMP")
    assert [r.i for r in maintenance.unexpired(df, now, 72).orderBy("i").collect()] == [1, 3]


def test_a_synced_document_has_one_queue_id(spark):
    docs = ['{"sqlite_id":99,"a":1,"sqlite_id":5}', '{ "sqlite_id" : 3 }', '{"a":{"sqlite_id":1}}', '{}', "text"]
    queue = spark.createDataFrame([(i + 10, None, "t", "quick", d) for i, d in enumerate(docs)], "id BIGINT, scanned_at TIMESTAMP, target STRING, scan_type STRING, results STRING")
    none = spark.createDataFrame([], "scan_type STRING, results STRING")
    got = {r.id: r.results for r in maintenance.unsynced_scans(queue, none).collect()}
    import json

    assert [json.loads(got[i])["sqlite_id"] for i in range(10, 15)] == [10, 11, 12, 13, 14]
    assert all(json.loads(got[i], object_pairs_hook=list).count(("sqlite_id", i)) == 1 for i in range(10, 14))
    assert sum(k == "sqlite_id" for k, _ in json.loads(got[10], object_pairs_hook=list)) == 1


def test_replace_by_file_is_idempotent(spark):
    cols = "source_file STRING, raw STRING"
    events = spark.createDataFrame([("f1", "old"), ("f2", "x"), ("gone", "y")], cols)
    incoming = spark.createDataFrame([("f1", "new"), ("f1", "newer"), ("f2", "x"), ("f3", "z")], cols)
    files = spark.createDataFrame([("f1", 2.0), ("f2", 1.0), ("f3", 1.0)], "source_file STRING, modified_at DOUBLE")
    ledger = spark.createDataFrame([("f1", 1.0), ("f2", 1.0), ("gone", 1.0)], "source_file STRING, modified_at DOUBLE")
    changed = maintenance.changed_files(files, ledger)
    once = maintenance.replace_by_file(events, incoming, changed)
    want = [("f1", "new"), ("f1", "newer"), ("f2", "x"), ("f3", "z"), ("gone", "y")]
    assert pairs(once) == want and pairs(maintenance.replace_by_file(once, incoming, changed)) == want
    after = maintenance.upsert(ledger, files, "source_file")
    assert maintenance.changed_files(files, after).count() == 0


def test_unsynced_scans(spark, now):
    queue = spark.createDataFrame([(1, "a", '{"x":1}'), (2, "b", "oops"), (3, "c", "{}"), (4, "d", None), (5, "e", "[1]")],
                                  "id BIGINT, target STRING, results STRING").selectExpr("id", "current_timestamp() scanned_at", "target", "'q' scan_type", "results")
    done = spark.createDataFrame([("quick", '{"sqlite_id":1}'), ("scheduled_service", '{"sqlite_id":99}')], "scan_type STRING, results STRING")
    got = {r.id: r.results for r in maintenance.unsynced_scans(queue, done).collect()}
    assert got == {2: '{"raw":"oops","sqlite_id":2}', 3: '{"sqlite_id":3}', 4: '{"raw":null,"sqlite_id":4}', 5: '{"raw":"[1]","sqlite_id":5}'}


def test_ledger(spark, now):
    anomalies = spark.createDataFrame([(1, ago(minutes=1)), (1, ago(minutes=2)), (2, ago(minutes=1))], "id BIGINT, detected_at TIMESTAMP")
    ledger = spark.createDataFrame([(1, ago(minutes=1), now, True)], schemas.PROCESSED)
    todo = maintenance.unprocessed(anomalies, ledger)
    assert todo.count() == 2
    after = maintenance.mark_processed(ledger, todo.withColumn("delivered", F.lit(False)), now)
    assert maintenance.unprocessed(anomalies, after).count() == 0 and after.count() == 3


RULES = [
    'alert tcp any any -> any any (msg:"ET SCAN test"; classtype:network-scan; sid:1; metadata:a  b,\tc; rev:1;)',
    '# alert tcp any any (msg:"off"; sid:2;)', "", "   ", 'alert ip (msg:"no sid";)', "alert ip (sid:3;)",
    'alert ip (msg:"half \\"quoted\\" text"; sid:4;)', 'alert ip (msg:"odd class"; classtype:my-own; sid: 5 ;)',
    'alert ip (msg:"long"; sid:6; metadata:' + "x" * 300 + ";)", 'alert ip (msg:"again"; sid:1;)',
]


def test_rules(spark):
    lines = spark.createDataFrame(list(enumerate(RULES)), "position INT, value STRING")
    parsed = rules.parsed_rules(lines)
    got = {r.position: r for r in parsed.collect()}
    assert sorted(got) == [0, 7, 8, 9]
    assert got[0].chunk_text == ("Suricata rule: ET SCAN test. Category: Detection of a network scan — port scanning or "
                                 "host discovery. Metadata: a b, c.")
    assert got[7].chunk_text == "Suricata rule: odd class. Category: my-own."
    assert got[8].chunk_text == "Suricata rule: long. Metadata: " + "x" * 300 + "."
    assert len({r.position: r for r in rules.parsed_rules(lines, 200).collect()}[8].chunk_text) == len(got[8].chunk_text) - 100
    latest = {r.sid: r.msg for r in rules.latest_rules(parsed).collect()}
    assert latest == {1: "again", 5: "odd class", 6: "long"}


def test_index_staleness(spark, now):
    lines = spark.createDataFrame([("x", now)], "value STRING, modified_at TIMESTAMP")
    empty = spark.createDataFrame([], "key STRING, value STRING")
    assert rules.stale_index(lines, empty).first().stale
    done = rules.index_meta(lines, "2024-01-31 00:00:00")
    assert not rules.stale_index(lines, done).first().stale


@pytest.fixture
def corpus(spark):
    rnd = np.random.default_rng(4)
    vectors = rnd.normal(size=(400, 8)).astype(np.float32)
    vectors[7] = 0
    vectors[50:90] = vectors[50]  # many exact copies
    rows = [(i, f"m{i}", "" if i % 2 else "c", "t", vectors[i].tolist() if i != 11 else None) for i in range(400)]
    return spark.createDataFrame(rows, f"{schemas.RULES}, embedding ARRAY<FLOAT>").repartition(5), vectors


def brute(vectors, q, k):
    v = vectors.astype(np.float64)
    with np.errstate(invalid="ignore"):
        s = v @ q / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))
    order = sorted((i for i in range(len(v)) if i not in (7, 11)), key=lambda i: (-round(s[i], 12), i))
    return order[:k]


def test_nearest_equals_brute_force(spark, corpus, monkeypatch):
    df, vectors = corpus
    wanted = [3, 50, 120, 300]
    queries = spark.createDataFrame([(i, vectors[i].astype(float).tolist()) for i in wanted] + [(999, None), (998, [0.0] * 8)],
                                    "query_id BIGINT, vector ARRAY<DOUBLE>")
    for block, part in ((2048, 1 << 15), (2, 50)):
        monkeypatch.setattr(similarity, "QUERY_BLOCK", block)
        monkeypatch.setattr(similarity, "CORPUS_PART", part)
        got = {}
        for r in similarity.nearest(df, queries, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.sid)
        assert got == {i: brute(vectors, vectors[i].astype(float), 5) for i in wanted}
    top = similarity.search_rules(df, queries, 1000).filter("query_id = 3").count()
    assert top == 398


def test_widths_do_not_mix(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "sid BIGINT, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [1.0])], "query_id BIGINT, vector ARRAY<DOUBLE>")
    got = {(r.query_id, r.sid, r.rank) for r in similarity.nearest(corpus, queries, 5).collect()}
    assert got == {(1, 1, 1), (1, 3, 2), (2, 2, 1)}


def test_no_queries(spark, corpus):
    empty = spark.createDataFrame([], "query_id STRING, vector ARRAY<DOUBLE>")
    assert similarity.nearest(corpus[0], empty, 3).count() == 0


def test_embedding_hook(spark):
    rows = spark.createDataFrame([(i, "m", "c", "bad" if i == 3 else "text") for i in range(6)], schemas.RULES).coalesce(1)

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[1.0, 2.0] for _ in texts]

    embedded = similarity.with_embeddings(rows, embed, 2).collect()
    got = {r.sid: r.embedding for r in embedded}
    assert {r.sid: r.embedding_error for r in embedded if r.embedding_error} == {2: "RuntimeError: down", 3: "RuntimeError: down"}
    assert got[0] == [1.0, 2.0] and got[2] is None and got[3] is None and got[4] == [1.0, 2.0]
    assert len(similarity.with_term_vectors(rows, 16).first().embedding) == 16


def test_recent_stats_counts_distinct(spark, now):
    rows = [("192.168.0.1", d, 5, None, ago(minutes=1)) for d in ("a", "a", "b")] + [("10.0.0.1", "a", 5, 5, ago(minutes=1))]
    conn = spark.createDataFrame(rows, "orig_h STRING, resp_h STRING, orig_bytes BIGINT, resp_bytes BIGINT, timestamp TIMESTAMP")
    assert [tuple(r) for r in baselines.recent_stats(conn, now, Settings()).collect()] == [("192.168.0.1", 15.0, 3.0, 2.0)]
