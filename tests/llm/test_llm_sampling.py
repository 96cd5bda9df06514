"""Sharding and source mixing."""

import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import SCHEMA, frame, rows, split
from pyspark.sql import functions as F

from hearthwatch.llm import mixing, sharding


def jump(key, shards):
    """The published algorithm, on unsigned 64-bit integers."""
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 200])
def test_jump_equals_the_published_algorithm(spark, shards):
    keys = [0, 1, -1, 5, 2**63 - 1, -(2**63), 123456789012345, *range(10, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    got = {r.key: (r.s.shard, r.s.grown) for r in df.select("key", sharding.jump_shards(F.col("key"), shards).alias("s")).collect()}
    assert got == {k: (jump(k, shards), jump(k, shards + 1)) for k in keys}


def test_many_jumps_are_followed_to_their_end(spark, monkeypatch):
    monkeypatch.setattr(sharding, "USUAL_JUMPS", 2)
    df = spark.range(300).select("id", sharding.jump_shards(F.col("id"), 60).alias("s"))
    assert all((r.s.shard, r.s.grown) == (jump(r.id, 60), jump(r.id, 61)) for r in df.collect())


def test_shards(spark):
    got = sharding.sharded(frame(spark).repartition(5), 16).collect()
    assert len(got) == len(rows())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(-1 if i is None else i, 16), jump(-1 if i is None else i, 17)) for i, t, *_ in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.jump_shards(F.lit(1), 0)


def test_only_the_needed_share_moves(spark):
    df = spark.range(20000).select(sharding.jump_shards(F.col("id") * 7919, 16).alias("s"))
    n = {r[0]: r[1] for r in df.groupBy("s.shard").count().collect()}
    moved = df.where("s.shard <> s.grown").count()
    assert max(n.values()) < 1.2 * 20000 / 16 and abs(moved - 20000 / 17) < 200


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= set(over)


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 1, "d": 2, None: 500}, {"a": 0, "b": 7}, {None: 5}, {"a": 0}, {"x": 3, "y": 3, "z": 4000, "zz": 1},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(spark):
    df = frame(spark)
    got = mixing.mixed_sources(df).collect()
    assert len(got) == len(rows())
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows():
        sizes[s] += len(split(t))
    want = plain_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert int(r.target // r.source_size if r.source_size else 0) <= r.copies + 1e-9
    again = mixing.mixed_sources(df.repartition(3)).collect()
    assert Counter(got) == Counter(again)
    assert mixing.mixed_sources(frame(spark, [])).count() == 0


def test_mix_comes_near_its_targets(spark):
    data = [(i, " ".join(["w"] * (5 + i * 37 % 90)), "en", "s%d" % (i % 5 if i % 3 else 0), 1) for i in range(3000)] + [(9999, "w " * 3000, "en", "s1", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    taken, target = defaultdict(int), {}
    for r in mixing.mixed_sources(df).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < max(0.01 * target[s], 100) for s in target)


def test_rows_without_ids_are_drawn_on_their_own(spark):
    """A source of NULL ids, one of a single repeated id and one of equal rows: each meets its target, long and short alike."""
    data = [(None, " ".join(["w"] * (5 + i * 37 % 90)) + f" x{i}", "en", "a", 1) for i in range(1500)]
    data += [(7, " ".join(["w"] * (5 + i * 37 % 90)) + f" x{i}", "en", "b", 1) for i in range(1500)]
    data += [(8, "the same words in every row", "en", "c", 1)] * 1000 + [(i, "w " * 40, "en", "d", 1) for i in range(9, 900)]
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = mixing.mixed_sources(df).collect()
    assert len(got) == len(data)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(target[s] - 100 < taken[s] <= target[s] for s in target), (taken, target)
    assert Counter(mixing.mixed_sources(df.repartition(3)).collect()) == Counter(got)


def test_long_documents_are_drawn_in_proportion(spark):
    """Inclusion follows size, up to certainty: of a rest of a third of a source, and with a document that is a fifth of it."""
    data = [(i, "w " * (20, 40, 80)[i % 3], "en", "a", 1) for i in range(6000)] + [(i, "w " * 700, "en", "b", 1) for i in range(6000, 6300)]
    data += [(9000, "w " * 20000, "en", "a", 1)]
    got = [r for r in mixing.mixed_sources(spark.createDataFrame(data, SCHEMA)).collect() if r.source == "a"]
    base = min(r.copies for r in got)
    rest = got[0].target - base * got[0].source_size
    assert 0 < rest < got[0].source_size and sum(r.p * r.size for r in got) == pytest.approx(rest)
    [big] = [r for r in got if r.size == 20000]
    assert big.p == 1 and big.copies == base + 1
    for size in (20, 40, 80):
        own = [r for r in got if r.size == size]
        p, had = own[0].p, sum(r.copies - base for r in own) / len(own)
        assert abs(had - p) < 4 * (p * (1 - p) / len(own)) ** 0.5 + 0.002
    by = {r.size: r.p for r in got}
    assert by[40] == pytest.approx(2 * by[20]) and by[80] == pytest.approx(min(1, 4 * by[20]))


def test_mixture_repeats_documents(spark):
    df = frame(spark)
    copies = Counter()
    for r in mixing.mixed_sources(df).collect():
        copies[r.doc_id] += r.copies if r.size else 0
    out = mixing.mixture(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == +copies
