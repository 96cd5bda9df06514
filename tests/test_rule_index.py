"""Builds of the rule index, and what readers see meanwhile."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthwatch.operators import rule_index, similarity


def lines(spark, rules, minute):
    rows = [(f'alert ip any any -> any any (msg:"{msg}"; sid:{sid}; rev:1;)', i, f"2024-01-30 00:{minute:02}:00") for i, (sid, msg) in enumerate(rules)]
    return spark.createDataFrame(rows, "value STRING, position LONG, modified_at STRING").withColumn("modified_at", F.to_timestamp("modified_at"))


def embedder(tmp_path, name, fails=""):
    """Vectors (length, 1); texts it is asked for are written down, those with `fails` in them raise."""

    def embed(texts):
        import uuid

        (tmp_path / f"{name}-{uuid.uuid4().hex}.txt").write_text("".join(t + "\n" for t in texts))
        if fails and any(fails in t for t in texts):
            raise RuntimeError("no answer")
        return np.array([[len(t), 1.0] for t in texts])

    return embed


def asked(tmp_path, name):
    return sorted(t for p in tmp_path.glob(f"{name}-*.txt") for t in p.read_text().splitlines())


def test_only_new_texts_are_embedded_and_readers_see_whole_builds(spark, tmp_path):
    index = rule_index.IndexFolder(spark, str(tmp_path / "index"))
    assert index.current() == 0 and index.searchable().count() == 0
    first = lines(spark, [(1, "one"), (2, "two"), (3, "two"), (4, "four")], 1)
    assert rule_index.rebuild(index, first, embedder(tmp_path, "a")) == 1
    assert len(asked(tmp_path, "a")) == 3  # equal texts are asked for once
    assert index.searchable().count() == 4
    assert rule_index.rebuild(index, first, embedder(tmp_path, "b")) == 1 and asked(tmp_path, "b") == []  # not stale

    reader = index.searchable()
    second = lines(spark, [(1, "one"), (2, "changed"), (5, "two"), (6, "one")], 2)
    assert rule_index.rebuild(index, second, embedder(tmp_path, "c")) == 2
    assert asked(tmp_path, "c") == ["Suricata rule: changed."]
    assert {r.sid for r in reader.collect()} == {1, 2, 3, 4}  # a reader of the old build
    assert {r.sid: r.msg for r in index.searchable().collect()} == {1: "one", 2: "changed", 5: "two", 6: "one"}
    assert {r.key: r.value for r in index.meta().collect()} == {"rules_mtime": "2024-01-30 00:02:00", "rule_count": "4", "failed": "0", "model": "default"}

    queries = spark.createDataFrame([("q", [23.0, 1.0])], "query_id STRING, vector ARRAY<FLOAT>")
    assert similarity.search_rules(index.searchable(), queries, 1).first().sid == 2

    third = lines(spark, [(1, "one")], 3)
    assert rule_index.rebuild(index, third, embedder(tmp_path, "d")) == 3 and asked(tmp_path, "d") == []
    assert sorted(p.name.split("-")[1] for p in (tmp_path / "index").glob("build-*")) == ["2", "3"]
    assert rule_index.rebuild(index, lines(spark, [], 4), embedder(tmp_path, "e")) == 3  # nothing to read: the old one stays
    assert rule_index.rebuild(index, third, embedder(tmp_path, "f"), model="other") == 4 and len(asked(tmp_path, "f")) == 1


def test_failed_texts_are_asked_for_again(spark, tmp_path):
    index = rule_index.IndexFolder(spark, str(tmp_path / "index"))
    rules = lines(spark, [(1, "one"), (2, "two")], 1)
    assert rule_index.rebuild(index, rules, embedder(tmp_path, "a", "two"), batch=1) == 1
    assert {r.sid for r in index.searchable().collect()} == {1}
    assert "no answer" in index.rules().filter("sid = 2").first().embedding_error
    assert rule_index.rebuild(index, rules, embedder(tmp_path, "b"), batch=1) == 2
    assert asked(tmp_path, "b") == ["Suricata rule: two."] and index.searchable().count() == 2
    assert rule_index.rebuild(index, rules, embedder(tmp_path, "c")) == 2 and asked(tmp_path, "c") == []


def test_a_broken_build_and_a_second_builder_change_nothing(spark, tmp_path):
    index = rule_index.IndexFolder(spark, str(tmp_path / "index"))
    rule_index.rebuild(index, lines(spark, [(1, "one")], 1), embedder(tmp_path, "a"))
    half = tmp_path / "index" / "build-2-half" / "rules"
    half.mkdir(parents=True)
    assert index.current() == 1 and index.searchable().count() == 1
    with pytest.raises(FileExistsError):
        index.put_in_force("build-1-other", 1)
    assert rule_index.rebuild(index, lines(spark, [(2, "two")], 2), embedder(tmp_path, "b")) == 2
    assert not half.exists() and [r.sid for r in index.searchable().collect()] == [2]
