"""The corpus pipeline: language ID, exact dedup, near dedup, source mixing, then encoding. Each stage reads what the one
before it has written."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthwatch.llm import bpe, exact, language, mixing, near
from hearthwatch.llm.base import drop_unreachable, stored, table

NEAR = 80  # percent of similarity that links two documents in the stage; the query op3 has 85


def _fresh(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that first deletes the tables that earlier ones stored and no frame reads any more."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_unreachable(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose fused language is accepted: text, declared language and the source's prior.

    Documents without words in them go; a NULL `lang` or `source` is no evidence. Repeated rows fare alike. Texts are scored whole.
    """
    return language.accepted(docs, F.lower("lang"), F.col("source"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased), the one of the largest id.

    A NULL text equals an empty one; rows without an id come last, and of rows that tie one stays. Whole texts count.
    """
    return exact.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked from a similarity of 0.80 on, the document of the smallest id.

    Exactly one row of a group stays, also where ids are NULL or repeated; documents without words all stay. Whole texts
    are compared.
    """
    return near.one_of_each(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    NULL sources are one source; documents without words are never taken; rows with NULL or repeated ids are drawn on
    their own. Reruns agree.
    """
    return mixing.mixture(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with their digests, and the digest of what they decode to. A NULL text is empty; every row
    gets one of its own, repeated ones too.
    """
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", _fresh(language_id)), ("exact_dedup", _fresh(exact_dedup)), ("near_dedup", _fresh(near_dedup)),
    ("mix_sources", _fresh(mix_sources)), ("bpe_encoding", _fresh(bpe_encoding)),
]

#: Estimates, trained likelihoods and encodings are beyond SQL; tests/llm/test_llm_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. All stages take empty tables and leave further columns, of whatever name, as they are; the
    last one returns its own columns only. A stage's table goes when the next one but one begins."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
