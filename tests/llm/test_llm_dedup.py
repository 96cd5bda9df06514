"""Exact, near and substring dedup against plain versions."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import LOWER, SCHEMA, covered, frame, rows, shingle_set, smallest_reachable

from hearthwatch.llm import exact, near, repeats
from hearthwatch.llm.components import components


def test_exact_groups(spark):
    got = exact.exact_duplicates(frame(spark)).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    assert len(got) == len(rows())
    kept = Counter()
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_filter_keeps_columns_and_one_row(spark):
    df = frame(spark)
    out = exact.without_copies(df)
    assert out.columns == df.columns
    assert out.count() == len({(t or "").translate(LOWER) for _, t, *_ in rows()})


def test_empty_tables(spark):
    df = frame(spark, [])
    for f in (exact.exact_duplicates, exact.without_copies, near.near_duplicates, near.one_of_each, repeats.without_repeats):
        assert f(df).count() == 0


def test_cuckoo_inserts_deletes_and_grows():
    index = exact.CuckooIndex(buckets=2)
    keys = [hashlib.sha256(b"%d" % i).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, (i,))
    assert index.size == 3000 and all(index.get(k) == (i,) for i, k in enumerate(keys))
    for k in keys[::2]:
        assert index.remove(k) is not None and index.remove(k) is None
    assert index.size == 1500 and len(index.items()) == 1500
    assert all((index.get(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    # same fingerprint and bucket, another key: a filter hit that the stored key refutes
    other = keys[1][:10] + bytes(22)
    assert index.get(other) is None
    index.insert(other, (-1,))
    assert index.get(other) == (-1,) and index.get(keys[1]) == (1,)


def test_exact_index_in_pieces_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(exact, "LIVE_KEYS", 3)
    rows_ = spark.createDataFrame([(i, bytes([i % 7]), i) for i in range(200)], "doc_id long, digest binary, row long")
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in exact.copy_groups(rows_).collect()}
    assert got == {bytes([k]): (max(i for i in range(200) if i % 7 == k), sum(i % 7 == k for i in range(200))) for k in range(7)}


def near_wanted(data, percent=85):
    """(id, size of the set, component id) of every row, with rows as nodes; and how many rows stay."""
    ids, sets = [i for i, *_ in data], [shingle_set(t) for _, t, *_ in data]
    links = [(a, b) for a in range(len(data)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    reach = smallest_reachable(range(len(data)), links)
    least = {}
    for k, i in enumerate(ids):
        least[reach[k]] = min((x for x in (least.get(reach[k]), i) if x is not None), default=None)
    return sorted(((i, len(s), least[reach[k]]) for k, (i, s) in enumerate(zip(ids, sets))), key=str), len(least)


def near_got(rows_):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows_), key=str), sum(r.kept for r in rows_)


def test_near_components(spark):
    got = near.near_duplicates(frame(spark)).collect()
    assert near_got(got) == near_wanted(rows())
    assert all(r.doc_id == r.component_id for r in got if r.kept)


def test_near_copies_without_ids_and_with_repeated_ids(spark):
    """Rows are linked whatever their ids are; of each group exactly one row stays."""
    base = [f"w{i}" for i in range(80)]

    def copy(k):
        return " ".join([*base[:k], f"x{k}", *base[k + 1 :]])

    data = [(None, copy(0), "en", "a", 1), (None, copy(79), "en", "a", 1), (7, copy(1), "en", "a", 1), (7, copy(78), "en", "b", 1)]
    other = [(None, " ".join(f"y{i}" for i in range(60)), "en", "a", 1), (None, " ".join(f"y{i}" for i in range(59)), "en", "a", 1)]
    same_id = [(9, "one two three four five six", "en", "a", 1), (9, "quite another text than the one of that id", "en", "a", 1)]
    for part, left in ((data, 1), (other, 1), (same_id, 2), (data * 2 + other * 2 + same_id, 4)):
        df = frame(spark, part)
        got = near.near_duplicates(df).collect()
        assert near_got(got) == near_wanted(part) and sum(r.kept for r in got) == left
        out = near.one_of_each(df)
        assert out.count() == left and out.columns == df.columns
    assert {r.component_id for r in near.near_duplicates(frame(spark, data)).collect()} == {7}
    assert {r.component_id for r in near.near_duplicates(frame(spark, other)).collect()} == {None}


@pytest.mark.parametrize("bound, most", [("BLOCK", 4), ("BLOCK_SHINGLES", 200)])
def test_near_family_of_edits_in_small_blocks(spark, monkeypatch, bound, most):
    """Chains of edits, some links of which only hold between copies; small blocks make large buckets and groups many parts."""
    monkeypatch.setattr(near, bound, most)
    import random

    rnd, base, data = random.Random(5), [f"w{i}" for i in range(80)], []
    for i in range(60):
        w = list(base) if i % 3 else list(data[-1][1].split()) if data else list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(80)] = f"e{rnd.randrange(1000)}"
        data.append((i, " ".join(w), "en", "a", 1))
    got = near.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert near_got(got) == near_wanted(data)


def test_near_filter(spark):
    df = frame(spark)
    out = near.one_of_each(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 1 in ids and not {2, 4, 12, 14} & set(ids) and {5, 8, 9, 10} <= set(ids)


def test_estimates_follow_similarity():
    rnd = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.85, 0.95):
        errors = []
        for _ in range(40):
            n = int(rnd.integers(20, 900))
            u = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
            both = int(n * share)
            a, b = u[: both + (n - both) // 2], np.concatenate([u[:both], u[both + (n - both) // 2 :]])
            x, y = near.registers(np.unique(a)), near.registers(np.unique(b))
            c = near.chance_matches(np.array([len(a)]))[0]
            errors.append(((x == y).mean() - c) / (1 - c) - both / n)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


def test_band_recall_at_the_threshold():
    rnd, hits = np.random.default_rng(2), 0
    for _ in range(300):
        n = int(rnd.integers(7, 400))
        u = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        extra = (n * 15) // 100
        a, b = u, u[: n - extra]
        keys = near.band_keys(np.stack([near.registers(np.unique(a)), near.registers(np.unique(b))]))
        hits += bool((keys[0] == keys[1]).any())
    assert hits == 300


def test_shared_counts():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 300, rnd.integers(1, 200)).astype(np.uint64)) for _ in range(9)]
    got = near.shared_counts(sets)
    for i in range(9):
        for j in range(9):
            if i != j:
                assert got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


def test_components_of_paths_stars_and_none(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(500, 400), (400, 450), (7, 7), (5, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {100: 100} | {i: 100 for i in range(101, 160)} | {500: 400, 400: 400, 450: 400}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def check_repeats(spark, data, length, df=None):
    got = Counter(tuple(r) for r in repeats.without_repeats(frame(spark, data) if df is None else df, length).collect())
    want = Counter()
    for (i, *_), (b, mark) in zip(data, covered([t for _, t, *_ in data], length)):
        left = bytes(c for c, m in zip(b, mark) if not m)
        runs = sum(1 for k in range(len(mark)) if mark[k] and (not k or not mark[k - 1]))
        want[i, len(b), sum(mark), runs, hashlib.sha256(left).hexdigest()] += 1
    assert got == want


def test_repeats(spark):
    data = [r for r in rows() if len(r[1] or "") < 30000]
    check_repeats(spark, data, 200)


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats_of_pasted_passages(spark, monkeypatch, hot):
    """Passages of every length around the threshold in contexts that overlap, also with all buckets dealt out."""
    monkeypatch.setattr(repeats, "HOT", hot)
    import random

    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh éñ") for _ in range(n))
    source = noise(3000)
    data = []
    for i in range(40):
        a = rnd.randrange(2600)
        piece = source[a : a + rnd.choice([90, 150, 185, 199, 200, 201, 230, 300])]
        data.append((i, noise(rnd.randrange(150)) + piece + noise(rnd.randrange(150)), "en", "a", 1))
    data += [(90, "ab" * 300, "en", "a", 1), (91, "q" + "ab" * 99 + "c", "en", "a", 1), (92, source, "en", "a", 1)]
    check_repeats(spark, data, 200)


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats_are_told_from_strings_of_equal_hashes(spark, monkeypatch, hot):
    """Strings whose polynomial hashes are equal, alone and inside longer texts."""
    monkeypatch.setattr(repeats, "HOT", hot)
    import random

    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefgh éñ") for _ in range(n))
    change = [-2, -4, -6, 5, 6, 3, 0, -2, 2, 0, 3, 0, 1, -1, 0, -2, -5, -2]  # no change of the hash modulo 2 ** 64
    data = []
    for i in range(60):
        same, tail = "".join(rnd.choice("abcdefgh ") for _ in range(182)), [rnd.randrange(60, 110) for _ in change]
        pair = [same + "".join(map(chr, tail)), same + "".join(chr(a + b) for a, b in zip(tail, change))]
        around = [("", ""), (noise(40), noise(30)), (noise(3), "")][i % 3]
        data += [(10 * i + j, around[0] * j + text + around[1], "en", "a", 1) for j, text in enumerate(pair)]
        if i % 2:
            data.append((10 * i + 2, "z" + pair[0] + "y", "en", "a", 1))
    check_repeats(spark, data, 200)


def test_repeats_of_texts_with_one_id_and_equal_crcs(spark):
    import random
    import zlib

    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefgh éñ") for _ in range(n))
    passage = noise(230)
    known: tuple[dict, dict] = {}, {}
    for texts, head in zip(known, (passage + noise(70), noise(90) + passage)):
        for end in (str(rnd.random()) for _ in range(1 << 18)):
            texts[zlib.crc32(end.encode(), zlib.crc32(head.encode()))] = head + end
    crc = next(c for c in known[0] if c in known[1])
    check_repeats(spark, [(i, texts[crc], "en", "a", 1) for texts in known for i in (1, None)], 200)


def python_steps(plan):
    """The most Python functions of a physical plan that run in one stage, one upon the other."""
    path, most = [], 0
    for line in plan.splitlines():
        name = line.lstrip(" :+-")
        depth = len(line) - len(name)
        path = [(d, n) for d, n in path if d < depth]
        path.append((depth, name))
        run = 0
        for _, n in reversed(path):
            if n.startswith(("Exchange", "BroadcastExchange")):
                break
            run += n.startswith(("MapInArrow", "ArrowEvalPython"))
        most = max(most, run)
    return most


@pytest.mark.parametrize("texts", [False, True])
def test_repeats_use_one_python_worker_a_task(spark, monkeypatch, texts):
    """In each stage, a second function would keep as many workers again in every executor."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    keep = repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df: plan(df) or keep(df))
    data = [(1, "x" * 10 + "0123456789" * 40, "", "", 1), (2, "y" + "0123456789" * 21, "", "", 1), (3, "short", "", "", 1)]
    plan(repeats.without_repeats(frame(spark, data), texts=texts))
    assert sum("MapInArrow" in p for p in plans) >= 4
    assert [python_steps(p) for p in plans if python_steps(p) > 1] == []


def test_kept_bytes(spark):
    text = "x" * 10 + "0123456789" * 40
    df = spark.createDataFrame([(1, text, "", "", 1), (2, "y" + "0123456789" * 21, "", "", 1)], SCHEMA)
    kept = {r.doc_id: bytes(r.kept) for r in repeats.without_repeats(df, texts=True).collect()}
    assert kept == {1: b"x" * 10, 2: b"y"}


def test_bands_follow_the_threshold():
    assert near.bands_of(85) == (near.BANDS, near.ROWS)
    for percent in (50, 80, 85, 95):
        bands, wide = near.bands_of(percent)
        assert bands * wide <= near.REGISTERS and (1 - (percent / 100) ** wide) ** bands <= near.MISSED
    with pytest.raises(ValueError):
        near.bands_of(0)


def test_pairs_far_below_the_usual_threshold_meet(spark):
    data = []
    for i in range(60):  # pairs that share just over half of their shingles
        common = [f"c{i}x{k}" for k in range(120)]
        data += [(2 * i, " ".join(common + [f"a{i}x{k}" for k in range(50)]), "en", "a", 1), (2 * i + 1, " ".join(common + [f"b{i}x{k}" for k in range(50)]), "en", "a", 1)]
    got = near.near_duplicates(spark.createDataFrame(data, SCHEMA), 50).where("kept").count()
    assert got == 60
