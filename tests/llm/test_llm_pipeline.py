"""The pipeline against a plain version of its stages, and the registered queries."""

import hashlib
import os
from collections import Counter, defaultdict

import duckdb
import pytest
from llm_cases import LOWER, frame, shingle_set, smallest_reachable

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from hearthwatch.llm import language, mixing
from hearthwatch.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    ok = [r.doc_id for r in language.identified(language.documents_evidence(docs), "doc_id").where("accepted").collect()]
    groups = defaultdict(list)
    for i in ok:
        groups[rows[i].text.translate(LOWER)].append(i)
    ids = [max(g) for g in groups.values()]
    sets = {i: shingle_set(rows[i].text) for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.NEAR * len(sets[a] | sets[b])]
    reach = smallest_reachable(ids, links)
    ids = [i for i in ids if reach[i] == i]
    left = spark.createDataFrame([rows[i] for i in ids], docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mixed_sources(left).collect() if r.size}
    t = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, c in copies.items():
        e = t.encode(rows[i].text, add_special_tokens=False).ids
        want[i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()] += c
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and len(got) > 50


def test_stages_take_awkward_rows(spark):
    docs = frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= 3 * docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_names():
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe_encoding"]


@pytest.mark.parametrize("name", sorted(set(ORACLE) - {"op2_sharding"}) + ["op2_sharding"])
def test_query_equals_sql(spark, name):
    from tools.check_oracle import rows_of

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries()[name](spark, SF)
    result = db.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_stages_on_two_tables_in_one_session(spark):
    """A result stays readable whatever other stages run in between; what nothing reads any more is deleted."""
    from hearthwatch.llm import base

    docs = frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    results = [corpus_pipeline.STAGES[k][1](spark, docs, SF).select("doc_id", "text") for k in (1, 3)]
    want = [Counter(r.collect()) for r in results]
    other = corpus_pipeline.STAGES[1][1](spark, docs.where("doc_id > 5"), SF)
    corpus_pipeline.STAGES[3][1](spark, docs.where("doc_id < 5"), SF).count()
    assert [Counter(r.collect()) for r in results] == want and other.count()
    held = set(base._STORED)
    del results, other
    base.drop_unreachable(spark)
    gone = held - set(base._STORED)
    assert gone and not any(os.path.exists(path.removeprefix("file:")) for path in gone)


def test_near_stage_links_from_four_fifths(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    for changed, left in ((9, 1), (13, 2)):  # 91 of 109 shared, then 87 of 113
        data = [(1, " ".join(words), "en", "a", 1), (2, " ".join(words[:-changed] + [f"x{i}" for i in range(changed)]), "en", "a", 1)]
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        assert corpus_pipeline.near_dedup(spark, docs, SF).count() == left
