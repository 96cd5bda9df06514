"""Streams over files against the batch result."""

import json
import uuid
from datetime import timedelta

from conftest import NOW
from pyspark.sql import functions as F

from hearthwatch.streaming import jobs, live


def fed(spark, tmp_path, frames):
    """A stream over one file per frame, read one file per trigger in order."""
    source = tmp_path / f"in-{uuid.uuid4().hex}"
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(str(source))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def drain(spark, tmp_path, stream):
    out = tmp_path / f"out-{uuid.uuid4().hex}"
    jobs.append_to_table(stream, str(out / "t"), str(out / "c")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(out / "t"))


CONN = "timestamp TIMESTAMP, orig_h STRING, resp_h STRING, orig_bytes BIGINT, resp_bytes BIGINT"


def conns(spark, start, n):
    return spark.createDataFrame(
        [(NOW + timedelta(seconds=start + 20 * i), f"192.168.0.{i % 3}", f"9.9.9.{i % 5}", i, 1) for i in range(n)], CONN)


def test_new_addresses_report_once(spark, tmp_path):
    rows = [spark.createDataFrame([(ip,) for ip in ips], "ip STRING") for ips in (["10.0.0.1", "8.8.8.8", "10.0.0.2"], ["10.0.0.1", "10.0.0.3"])]
    known = spark.createDataFrame([("10.0.0.2",)], "ip STRING")
    got = drain(spark, tmp_path, live.new_addresses(fed(spark, tmp_path, rows), known))
    assert sorted(r.ip for r in got.collect()) == ["10.0.0.1", "10.0.0.3"]


def test_sightings(spark, now):
    lines = [('{"id.orig_h":"10.0.0.1"}', "/l/zeek-a/conn.log"), ('{"id.orig_h":"10.0.0.9"}', "/l/zeek-a/dns.log"), ("junk", "/l/zeek/conn.log"),
             ('{"event_type":"dns","src_ip":"10.0.0.2"}', "/l/suricata/eve.json"), ('{"event_type":"stats","src_ip":"10.0.0.3"}', "/l/suricata/eve.json")]
    df = spark.createDataFrame([(*r, now) for r in lines], "value STRING, source_file STRING, modified_at TIMESTAMP")
    assert sorted(r.ip for r in live.sightings(df).collect()) == ["10.0.0.1", "10.0.0.2"]


def test_trailing_stats_equal_batch(spark, tmp_path):
    frames = [conns(spark, 0, 60), conns(spark, 1200, 60), conns(spark, 7200, 3)]
    got = drain(spark, tmp_path, live.trailing_stats(fed(spark, tmp_path, frames)))
    every = frames[0].union(frames[1]).union(frames[2])
    newest = every.agg(F.max("timestamp")).first()[0]
    want = every.groupBy(F.window("timestamp", "5 minutes", "1 minute").alias("w"), F.col("orig_h").alias("ip")).agg(
        F.sum(F.col("orig_bytes") + F.col("resp_bytes")).cast("double").alias("bytes_5min"), F.count("*").cast("double").alias("conns_5min"),
        F.count_distinct("resp_h").cast("double").alias("dest_ips")).filter(F.col("w.end") <= F.lit(newest - timedelta(minutes=10))).select(
        "ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "bytes_5min", "conns_5min", "dest_ips")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50


def test_late_rows_are_ignored_after_the_watermark(spark, tmp_path):
    # a batch drops what is older than the watermark the batch before it ran with
    frames = [conns(spark, s, n) for s, n in ((0, 10), (7200, 3), (7300, 3), (60, 10), (14400, 1))]
    got = drain(spark, tmp_path, live.timeline(fed(spark, tmp_path, frames), "orig_h"))
    assert got.filter(F.col("time") < F.lit(NOW + timedelta(hours=1))).agg(F.sum("count")).first()[0] == 10


def test_running_baselines_fold_over_batches(spark, tmp_path):
    schema = "ip STRING, window_start TIMESTAMP, bytes_5min DOUBLE, conns_5min DOUBLE, dest_ips DOUBLE"
    values = [10.0, 20.0, 5.0, 40.0]
    frames = [spark.createDataFrame([("a", NOW + timedelta(minutes=5 * i), v, 1.0, 1.0)], schema) for i, v in enumerate(values)]
    frames.insert(3, frames[1])  # a replayed window changes no average, and is counted
    got = drain(spark, tmp_path, live.running_baselines(fed(spark, tmp_path, frames))).orderBy("samples").collect()
    want, e = [], None
    for v in values:
        e = v if e is None else 0.3 * v + 0.7 * e
        want.append(round(e, 9))
    assert [round(r.avg_bytes_5min, 9) for r in got] == want and [r.samples for r in got] == [1, 2, 3, 4]
    assert [r.late for r in got] == [0, 0, 0, 1]


def test_cooldown_across_batches(spark, tmp_path):
    schema = "anomaly_type STRING, dedup_key STRING, detected_at TIMESTAMP, hits BIGINT"
    minutes = [0, 10, 30, 59, 60, 100, 125]
    frames = [spark.createDataFrame([("t", "k", NOW + timedelta(minutes=m), 1)], schema) for m in minutes]
    got = drain(spark, tmp_path, live.throttled(fed(spark, tmp_path, frames), 60))
    assert sorted(int((r.detected_at.astimezone(NOW.tzinfo) - NOW).total_seconds() / 60) for r in got.collect()) == [0, 60, 125]


def test_alert_flow_stream_emits_unmatched_after_the_watermark(spark, tmp_path):
    alerts = [(NOW, "s1", 1, "a", "b", "1:x"), (NOW, "s2", 1, "a", "b", "1:none"), (NOW + timedelta(hours=9), "s3", 1, "a", "b", None)]
    flows = [(NOW + timedelta(minutes=5), "1:x", "1.0", "SF"), (NOW + timedelta(hours=9), "1:y", "1.0", "SF")]
    a = spark.createDataFrame(alerts, "timestamp TIMESTAMP, signature STRING, severity INT, src_ip STRING, dest_ip STRING, community_id STRING")
    c = spark.createDataFrame(flows, "timestamp TIMESTAMP, community_id STRING, duration STRING, conn_state STRING")
    got = drain(spark, tmp_path, live.alerts_with_flows(fed(spark, tmp_path, [a]), fed(spark, tmp_path, [c])))
    assert sorted((r.signature, r.duration) for r in got.collect()) == [("s1", "1.0"), ("s2", None)]


def test_ingest_reads_each_closed_file_once(spark, tmp_path):
    folder = tmp_path / "staged/zeek/conn"
    folder.mkdir(parents=True)
    (folder / "2024-01-30-01.ndjson").write_text(json.dumps({"timestamp": "2024-01-30T01:00:00Z"}) + "\nbroken{\n")
    run = lambda: jobs.ingest(spark, str(tmp_path / "staged"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    (folder / "2024-01-30-02.ndjson").write_text(json.dumps({"timestamp": "2024-01-30T02:00:00Z"}) + "\n")
    run()
    run()
    table = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r.event_hour for r in table.collect()) == ["2024-01-30-01", "2024-01-30-02"]


def test_queue_has_independent_consumers(spark, tmp_path):
    queue = str(tmp_path / "q")
    spark.createDataFrame([(1,), (2,)], "id INT").write.parquet(queue)
    counts = {"a": 0, "b": 0}

    def taker(name):
        def take(df, batch_id):
            counts[name] += df.count()
        return take

    jobs.read_queue(spark, queue, "a", str(tmp_path / "c"), taker("a")).awaitTermination()
    spark.createDataFrame([(3,)], "id INT").write.mode("append").parquet(queue)
    for name in ("a", "b"):
        jobs.read_queue(spark, queue, name, str(tmp_path / "c"), taker(name)).awaitTermination()
    assert counts == {"a": 3, "b": 3}
