"""Files that grow, are rotated, cut off and replaced while a stream follows them."""

import os

import pytest

from hearthwatch.sources.tail import LogTailReader, tail_lines
from hearthwatch.streaming import jobs


class Follower:
    """A query that is stopped after each look and started again from its checkpoint."""

    def __init__(self, spark, root, base, **options):
        self.spark, self.root, self.base, self.options = spark, root, base, options
        self.seen = []

    def look(self):
        """Values and file names of the lines that are new since the last look."""
        lines = tail_lines(self.spark, str(self.root), **self.options)
        jobs.append_to_table(lines, f"{self.base}/table", f"{self.base}/checkpoint").awaitTermination()
        rows = [(r.value, os.path.basename(r.source_file)) for r in self.spark.read.schema(lines.schema).parquet(f"{self.base}/table").collect()]
        fresh = list(rows)
        for r in self.seen:
            fresh.remove(r)
        self.seen = rows
        return sorted(fresh)


def append(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a") as f:
        f.write(text)


def test_only_new_complete_lines(spark, tmp_path):
    log = tmp_path / "logs" / "zeek" / "conn.log"
    append(log, "old 1\nold 2\nhalf")
    follow = Follower(spark, tmp_path / "logs", tmp_path)
    assert follow.look() == []
    append(log, " done\n\n  new 1  \nnew 2\nopen")
    assert follow.look() == [("half done", "conn.log"), ("new 1", "conn.log"), ("new 2", "conn.log")]
    assert follow.look() == []
    append(log, " end\n")
    append(tmp_path / "logs" / "later.log", "a\nb\n")  # a file that comes later is read from its beginning
    assert follow.look() == [("a", "later.log"), ("b", "later.log"), ("open end", "conn.log")]


def test_rotation_truncation_and_replacement(spark, tmp_path):
    log = tmp_path / "logs" / "eve.json"
    append(log, "first of one\n")
    follow = Follower(spark, tmp_path / "logs", tmp_path, files="eve.json*", start_at="start")
    assert follow.look() == [("first of one", "eve.json")]
    append(log, "last of one\n")
    os.rename(log, tmp_path / "logs" / "eve.json.1")
    append(log, "first of two, which is longer than what was read of one\n")
    # what the rotated file still held comes under the name it had
    assert follow.look() == [("first of two, which is longer than what was read of one", "eve.json"), ("last of one", "eve.json")]
    log.write_text("cut\n")
    assert follow.look() == [("cut", "eve.json")]
    log.write_text("replaced by something that is longer\n")
    assert follow.look() == [("replaced by something that is longer", "eve.json")]
    os.remove(log)
    os.remove(tmp_path / "logs" / "eve.json.1")
    assert follow.look() == []
    append(log, "again\n")
    assert follow.look() == [("again", "eve.json")]


@pytest.mark.parametrize("chunk,most", [(7, 1 << 30), (64, 50), (1 << 20, 10)])
def test_pieces_of_any_size_give_each_line_once(spark, tmp_path, chunk, most):
    log = tmp_path / "logs" / "a.log"
    want = ["x" * (i * 13 % 90 + 1) + f"é{i}" for i in range(60)]
    append(log, "\n".join(want) + "\n")
    follow = Follower(spark, tmp_path / "logs", tmp_path, start_at="start", chunk_bytes=chunk, max_bytes_per_file=most)
    got = []
    for _ in range(80):  # a look takes at most `most` bytes, or one line
        fresh = follow.look() if most > 100 else None
        if fresh is None:
            break
        got += fresh
        if len(got) == len(want):
            break
    if most <= 100:
        reader = LogTailReader({"path": str(tmp_path / "logs"), "startat": "start", "chunkbytes": str(chunk), "maxbytesperfile": str(most)})
        start = reader.initialOffset()
        while (end := reader.latestOffset())["files"] != start["files"]:
            for piece in reader.partitions(start, end):
                got += [(v, "a.log") for batch in reader.read(piece) for v in batch.column("value").to_pylist()]
            start = end
    assert sorted(got) == sorted((w, "a.log") for w in want)


def test_a_file_that_is_gone_before_it_is_read(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\n")
    for fail in ("true", "false"):
        reader = LogTailReader({"path": str(tmp_path), "startat": "start", "failondataloss": fail})
        log.write_text("one\ntwo\n")
        start, end = reader.initialOffset(), reader.latestOffset()
        log.write_text("xx\n")
        [piece] = reader.partitions(start, end)
        if fail == "true":
            with pytest.raises(FileNotFoundError):
                list(reader.read(piece))
        else:
            assert list(reader.read(piece)) == []


def test_new_addresses_of_growing_logs(spark, tmp_path):
    conn, eve = tmp_path / "logs" / "zeek-wifi" / "conn.log", tmp_path / "logs" / "suricata" / "eve.json"
    append(conn, '{"id.orig_h": "192.168.40.9"}\n')
    append(eve, "")
    known = spark.createDataFrame([("192.168.40.1",)], "ip STRING")

    def look():
        query = jobs.watch_addresses(spark, str(tmp_path / "logs"), known, f"{tmp_path}/queue", f"{tmp_path}/checkpoint")
        query.awaitTermination()
        return sorted(r.ip for r in spark.read.schema("ip STRING, seen_at TIMESTAMP").parquet(f"{tmp_path}/queue").collect())

    assert look() == []
    append(conn, '{"id.orig_h": "192.168.40.1"}\n{"id.orig_h": "192.168.40.2"}\nno json\n{"id.orig_h": "8.8.8.8"}\n')
    append(eve, '{"event_type": "dns", "src_ip": "10.0.0.3"}\n{"event_type": "stats", "src_ip": "10.0.0.4"}\n{"event_type": "flow", "src_ip": "192.168.40.2"}\n')
    assert look() == ["10.0.0.3", "192.168.40.2"]
    append(conn, '{"id.orig_h": "192.168.40.2"}\n{"id.orig_h": "192.168.40.9"}\n')
    assert look() == ["10.0.0.3", "192.168.40.2", "192.168.40.9"]
