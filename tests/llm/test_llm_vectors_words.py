"""Spelling variants, whitening and token files against plain versions."""

import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from llm_cases import frame, rows

import corpus_pipeline
from hearthwatch.llm import spelling, token_files, whitening

SF = "/root/testdata/sf0.001"
TOKENIZER = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")


def plain_words(data):
    n = Counter()
    for doc_id, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def plain_variants(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    best = {a: min(bs, key=lambda b: (-words[b], b)) for a, bs in near.items() if bs}
    form = {a: b for a, b in best.items() if words[b] >= 5 * words[a]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def spelled(spark, data):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    return {tuple(r) for r in spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdeÉé"), (3, "aÿ")])
def test_variants_of_few_letters(spark, seed, letters):
    """Few letters: repeated grams, many near words, chains."""
    rnd = np.random.default_rng(seed)
    base = ["".join(rnd.choice(list(letters), 6 + i % 4)) for i in range(60)]
    words = base + [w[:i] + w[i + 1 :] for w in base for i in (0, 3, len(w) - 1)] + [w[:2] + letters[0] + w[3:] for w in base]
    data = [(i, " ".join([w.upper() if i % 3 == 0 else w] * int(rnd.choice([1, 3, 5, 30, 200]))) + "; x") for i, w in enumerate(words)]
    want = plain_variants(plain_words(data))
    assert spelled(spark, data) == want
    assert any(f for _, f, *_ in want) and len({r for _, f, r, *_ in want if f and r != f}) >= 0


def test_variants_follow_forms_to_the_last(spark):
    counts = {"aaaaaabc": 3200, "aaaaaabb": 640, "aaaaaaab": 128, "aaaaaaaa": 25, "aaaaaaax": 5}
    data = [(None, " ".join([w] * n)) for w, n in counts.items()]
    want = plain_variants(plain_words(data))
    assert spelled(spark, data) == want
    assert {r for w, _, r, *_ in want if w == "aaaaaaax"} == {"aaaaaabc"}


def test_variants_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert {tuple(r) for r in spelling.spelling_variants(docs).collect()} == plain_variants(plain_words(data))
    data = [(r[0], r[1]) for r in rows()]
    assert {tuple(r) for r in spelling.spelling_variants(frame(spark)).collect()} == plain_variants(plain_words(data))
    assert spelling.spelling_variants(frame(spark, [])).count() == 0


def test_pivots_are_the_rarest_disjoint_grams():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        word = "".join(rnd.choice(list("abc"), int(rnd.integers(6, 12))))
        frequency = {x + y: int(rnd.integers(1, 9)) for x in "abc" for y in "abc"}
        prefix, *_ = spelling.gram_prefix(word, frequency)
        a, b = spelling.pivots(prefix)
        cheapest = min(x[0] + y[0] for x in prefix for y in prefix if x[2] + 2 <= y[2])
        assert a[2] + 2 <= b[2] and a[0] + b[0] == cheapest and len(prefix) >= 3


VECTORS = "vec_id long, embedding array<float>, label int"


def plain_fit(vectors):
    x = sorted({tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    return n, sums, [[Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]


def test_scatter_gives_exact_products():
    rnd = np.random.default_rng(3)
    for rows_, width, top in ((1, 3, 5), (64, 4, 1), (130, 5, 1000), (700, 3, 1 << 40), (65, 2, 1 << 20)):
        x = rnd.integers(-top, top + 1, (rows_, width))
        x[:, 0] = 7  # a dimension without planes
        shift, sums, products = whitening.scatter(x)
        d = (x - shift).astype(object)
        want = d.T @ d
        assert list(sums) == list(d.sum(axis=0))
        assert all(products[i, j] == want[i, j] for i in range(width) for j in range(i, width))


def test_whitening_of_awkward_vectors(spark):
    rnd = np.random.default_rng(1)
    good = [rnd.normal(0, 0.4, 5).astype(np.float32).tolist() for _ in range(90)]
    good += good[:20] + [[300.25, -4000.5, 0.0, 1.0, 2.0]]
    bad = [None, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [0.0, float("inf"), 0.0, 0.0, 0.0]]
    data = [(i, v, 0) for i, v in enumerate(good)] + [(900 + i, v, 0) for i, v in enumerate(bad)] + [(None, good[3], 1), (7, good[3], 1)]
    got = whitening.whitened(spark.createDataFrame(data, VECTORS).repartition(3)).collect()
    n, sums, v = plain_fit(good)
    assert Counter(r.vec_id for r in got) == Counter({i: 5 * (1 + (i == 7)) for i in [*range(len(good)), None]})
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    values, vectors = np.linalg.eigh(np.array(v, float))
    for r in got:
        x = [int(np.floor(64 * c)) + 1_000_000 for c in (good[3] if r.vec_id is None else good[r.vec_id])] if r.vec_id != 7 else None
        if x is None:
            continue
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        k = len(values) - r.component
        assert abs(r.explained - values[k] / np.trace(np.array(v, float))) < 1e-9
        y = float(np.dot([float(a - Fraction(s, n)) for a, s in zip(x, sums)], vectors[:, k]) / np.sqrt(values[k]))
        assert abs(abs(r.whitened) - abs(y)) < 1e-6 * max(1.0, abs(y))


def test_whitening_of_other_shapes(spark):
    mixed = [(1, [1.0, 2.0], 0), (2, [1.0, 5.0], 0), (3, [], 0), (4, [1.0, 2.0, 4.0], 0), (5, [2.0, 2.0, 4.0], 0), (6, [1.0, 2.0], 0)]
    got = whitening.whitened(spark.createDataFrame(mixed, VECTORS)).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in got) == [(1, 1, 2), (2, 1, 2), (4, 1, 2), (5, 1, 2), (6, 1, 2)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in got)
    same = [(i, [0.5, 0.25], 0) for i in range(4)]
    assert whitening.whitened(spark.createDataFrame(same, VECTORS)).count() == 0
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0


def test_whitening_of_embeddings(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = {r.vec_id: r.embedding for r in vectors.collect()}
    n, sums, v = plain_fit(data.values())
    values, _ = np.linalg.eigh(np.array(v, float))
    got = whitening.whitened(vectors).collect()
    assert len(got) == 16 * len(data) and got[0].identity_error < 1e-9
    for r in got[:: 97]:
        x = [int(np.floor(64 * c)) + 1_000_000 for c in data[r.vec_id]]
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums)) and r.n == n
        assert abs(r.explained / (values[-r.component] / values.sum()) - 1) < 1e-9


def plain_tokens(data):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for doc_id, text in data:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = [
    "a  b", " lead", "trail ", "   ", "\n x", "x\n y \n\n z", "tab\t \tend", "don't can't we'll  'tis", "a  b  c　 d", "\x1c \x1f e \x85 f",
    "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>", "日本 語 ​ x", "é ́ x", "1 234,56 --- ...", "  ᠎ x", "😀 😀😀  😀",
]


def test_token_files_of_odd_texts(spark, tmp_path):
    rnd = np.random.default_rng(7)
    atoms = [" ", " ", "  ", "\n", "\t", " ", "\x1d", "a", "Bc", "é", "1", "23", ".", "'s", "'", "　", "😀", "<|endoftext|>", "日"]
    texts = ODD + ["".join(rnd.choice(atoms, int(rnd.integers(0, 14)))) for _ in range(600)]
    data = [(3 * i - 50, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    token_files.write_token_files(docs, TOKENIZER, str(tmp_path / "t"))
    stored = token_files.read_token_files(spark, str(tmp_path / "t"))
    want = plain_tokens(data)
    assert sorted(map(tuple, token_files.token_file_rows(stored).collect())) == sorted(want)
    assert {r.doc_id: r.n for r in token_files.documents_of(stored, [-50, 4, 100]).selectExpr("doc_id", "size(ids) AS n").collect()} == {
        d: n for d, _, n, _ in want if d in (-50, 4, 100)}
    cut = sorted(map(tuple, token_files.token_range(stored, 100, 160).collect()), key=lambda r: r[1])
    assert sum(len(ids) for *_, ids in cut) == 60 and cut[0][1] == 100


def test_token_files_ask_the_library_for_many_parts_at_once():
    import random

    import pyarrow as pa

    rnd = random.Random(5)
    bits = [" ", "  ", "\n", "\n\n", "\t", "Wörter", "it's", "12", "...", "漢字", "\u00a0", "\x85", "<|endoftext|>", "ª", "ɐɐ", "foo.\nBar", "\r\n", "(x)", ""]
    texts = [None, "", " ", *("".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(600))]
    encoder = token_files.ChunkEncoder(TOKENIZER)
    whole, calls = encoder.whole, []
    encoder.whole = lambda group: calls.append(len(group)) or whole(group)
    sizes, data = encoder.encode(pa.array(texts, pa.string()))
    ids = np.split(np.frombuffer(data, "<u4"), np.cumsum(sizes)[:-1])
    want = encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in ids] == [[*x.ids, token_files.END] for x in want]
    assert len(calls) < 60  # not one for each text


def test_token_files_spend_no_python_on_each_part():
    import sys

    import pyarrow as pa

    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}{mark}" for i in range(2000) for mark in ("", ",", ".\nNext", "...")]
    encoder, calls = token_files.ChunkEncoder(TOKENIZER), []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        sizes, data = encoder.encode(pa.array([" ".join(words)]))
    finally:
        sys.setprofile(None)
    want = encoder.library.encode(" ".join(words), add_special_tokens=False).ids
    assert np.frombuffer(data, "<u4").tolist() == [*want, token_files.END] and sizes.tolist() == [len(want) + 1]
    assert len(calls) < len(words) / 4


def test_token_files_keep_a_bounded_number_of_strings(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "PARTS", 50)
    encoder = token_files.ChunkEncoder(TOKENIZER)
    for k in range(0, 900, 30):
        texts = [f"w{i} often {'l' * (i % 90)}ong, w{i // 2}.  x" for i in range(k, k + 30)]
        sizes, data = encoder.encode(pa.array(texts))
        want = [i for x in encoder.library.encode_batch(texts, add_special_tokens=False) for i in (*x.ids, token_files.END)]
        assert np.frombuffer(data, "<u4").tolist() == want and sizes.sum() == len(want)
        known = encoder.known
        assert len(known.keys) == len(known.ids) == len(known.last) <= 50 and " often" in known.keys.to_pylist()
        assert max(len(x.encode()) for x in known.keys.to_pylist()) <= token_files.PART_LENGTH


def test_token_files_of_awkward_rows(spark):
    got = list(map(tuple, token_files.stored_tokens(frame(spark), TOKENIZER).collect()))
    data = [(r[0], r[1]) for r in rows()]
    assert sorted((d is not None, d, n, c) for d, _, n, c in got if d is not None) == sorted((True, d, n, c) for d, _, n, c in plain_tokens(data) if d is not None)
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in by_start] == [sum(r[2] for r in by_start[:i]) for i in range(len(got))]
    ids = [r[0] for r in by_start]
    assert ids[:3] == [None] * 3 and ids[3:] == sorted(ids[3:])
    assert token_files.stored_tokens(frame(spark, []), TOKENIZER).count() == 0


def test_token_files_pass_over_other_documents(spark, tmp_path):
    docs = spark.createDataFrame([(2 * i, f"text number {i}") for i in range(4000)], "doc_id long, text string")
    token_files.write_token_files(docs, TOKENIZER, str(tmp_path / "t"))
    stored = token_files.read_token_files(spark, str(tmp_path / "t"))
    plan = token_files.documents_of(stored, [10])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(doc_id,10)]" in plan or "PushedFilters: [In(doc_id, [10])" in plan or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,10)]" in plan
    import pyarrow.orc as orc

    files = list((tmp_path / "t").glob("*.orc"))
    assert files and all(orc.ORCFile(f).nstripes >= 1 and str(orc.ORCFile(f).compression).lower().endswith("zstd") for f in files)
    starts = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, token_files.stored_tokens(starts, TOKENIZER).collect())) == sorted(
        plain_tokens(sorted((r.doc_id, r.text) for r in starts.collect())))
