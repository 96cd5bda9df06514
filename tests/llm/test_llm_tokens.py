"""Token counts and BPE against the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import frame, rows

from hearthwatch.llm import bpe, pieces

P = pytest.importorskip("public_tokenizers")
ALPHABET = "aAbéÉΣσİı'sStTlLmMdD<|>startofex 012\t\n\x0b\x1c\x85\xa0́▁ﬁ中文😀!?-\x00ǅ"


def weird(n):
    rnd = random.Random(1)
    out = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return out + ["<|endoftext|> a<|startoftext|>b <|endoftext|", "  a   b ", "\n\n a\n", " ", "▁", "a ▁ b", " ▁▁ ", "<s> x</s>", "a" * 3000]


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def library(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)


def test_codec_equals_library(words):
    texts = weird(2000)
    assert bpe.ChunkCodec(P.path("word_bpe_49k.json")).run(texts) == [library(words, t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_codec_on_any_text(text):
    from tokenizers import Tokenizer

    assert bpe.codec(P.path("word_bpe_49k.json")).run([text]) == [library(Tokenizer.from_file(P.path("word_bpe_49k.json")), text)]


def test_trie_equals_merging():
    merges = bpe.Merges({}, ["a b", "ab c", "b c</w>", "a bc</w>", "c c", "cc c</w>", "ab ab", "b a", "ba b</w>"])
    merges.made |= dict.fromkeys(x + e for x in "abc" for e in ("", bpe.END))
    merges.longest = 10
    rnd = random.Random(2)
    some = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(600)}
    got = bpe.encode_words(some, merges)
    assert got == {w: merges.apply([*w[:-1], w[-1] + bpe.END]) for w in some}


def test_forgetting_changes_nothing(words, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS", 5)
    c = bpe.ChunkCodec(P.path("word_bpe_49k.json"))
    for text in weird(60):
        assert c.run([text]) == [library(words, text)]


def test_encoded(spark, words):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(frame(spark), P.path("word_bpe_49k.json")).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == Counter((i, n, sha(ids), sha(text)) for i, n, ids, text in ((i, *library(words, t)) for i, t, *_ in rows()))
    assert bpe.encoded(frame(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_ids_and_texts(spark, words):
    got = bpe.encoded(spark.createDataFrame([(1, "Hello world")], "doc_id long, text string"), P.path("word_bpe_49k.json"), texts=True).first()
    assert list(got.ids) == words.encode("Hello world", add_special_tokens=False).ids and got.decoded == words.decode(list(got.ids), skip_special_tokens=False)


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_pre_tokens_are_independent(processor):
    sp, lines = pieces._model(P.path("piece_bpe_32k.model"))
    for text in weird(2000):
        assert sum(pieces._count(sp, pieces.pre_tokens(text, lines))) == len(processor.encode(text))
        assert sum(pieces._count(sp, pieces.pre_tokens(text, False))) == len(processor.encode(text))


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_token_counts(spark, processor, head):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in pieces.token_counts(frame(spark), P.path("piece_bpe_32k.model"), head=head).collect())
    assert got == Counter((i, len((t or "").encode()), n, n > 4096) for i, t, *_ in rows() for n in [len(processor.encode(t or ""))])
    if not head:
        assert pieces.token_counts(frame(spark, []), P.path("piece_bpe_32k.model")).count() == 0
