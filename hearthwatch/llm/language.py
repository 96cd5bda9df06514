"""Language ID by Bayesian fusion: likelihoods of the text, the language that markup declares, and priors of hosts that
are smoothed by those of their address suffix and these by the whole table's."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthwatch.llm.base import SPACES, byte_slices, stored

SAMPLE = 4000  # labelled texts that the trigram model is fitted on, shared evenly by the languages
EACH = 100  # texts that a language may have at least, however many languages share the sample
LETTERS = 1 << 14  # characters of a sampled text that are read
CELLS = 1 << 15  # hashed byte trigrams
SMOOTHING = 20.0  # rows that a prior of the next wider level counts for
TEMPER = 0.25  # trigrams overlap and repeat each other, so each counts for so much of an independent one
DECLARED_FLOOR = 1.0  # rows added to each cell of the table of declared against found languages

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[np.flatnonzero(SPACES)] = 32
_FOLD[33:65] = 33  # digits and marks say nothing
_FOLD[[91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 33


def trigrams(data: np.ndarray) -> np.ndarray:
    """Cells of the byte trigrams, A-Z folded, white space and marks made one each."""
    x = _FOLD[data].astype(np.uint32)
    return ((x[:-2] * 0x9E3779B1 + x[1:-1] * 0x85EBCA6B + x[2:] * 0xC2B2AE35) >> np.uint32(17)).astype(np.int32)


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # (CELLS, languages): log-likelihood of each trigram

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) summed log-likelihoods, and the number of trigrams of each text."""
        out, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            data = np.frombuffer(t.encode(), np.uint8)
            if len(data) >= 3 and (_FOLD[data] > 33).any():
                at = trigrams(data)
                out[i] = np.bincount(at, minlength=CELLS) @ self.table if len(at) > CELLS else self.table[at].sum(0)
                n[i] = len(at)
        return out, n


def fit_text_model(rows: Iterable[tuple[str, str]], languages: list[str]) -> TextModel:
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((CELLS, len(languages)))
    for lang, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) >= 3:
            counts[:, place[lang]] += np.bincount(trigrams(data), minlength=CELLS)
    counts += 0.5
    return TextModel(languages, np.log(counts / counts.sum(0)))


def labelled_sample(rows: DataFrame, sample: int = SAMPLE) -> TextModel | None:
    """A model of all languages that any text declares, on texts of each: those of least hash, an even share of `sample`
    but EACH at least, and the first LETTERS characters of each text. The driver reads them one after the other; its
    memory grows with the number of languages only. Where equal texts differ in language, each counts once."""
    told = rows.where("declared IS NOT NULL AND text IS NOT NULL").select("declared", "text", F.xxhash64("text").alias("h"))
    sizes = {r["declared"]: r["n"] for r in told.groupBy("declared").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return None
    share = max(sample // len(sizes), EACH)
    # hashes are even, so a cut at twice the share holds the least ones of each language and little more
    cuts = [(d, int(2.0**64 * 2 * share / n) - (1 << 63)) for d, n in sizes.items() if n > 4 * share]
    if cuts:
        cuts = F.broadcast(rows.sparkSession.createDataFrame(cuts, "declared string, cut long"))
        told = told.join(cuts, "declared", "left").where("cut IS NULL OR h <= cut").drop("cut")
    some = told.groupBy("declared", "h").agg(F.first(F.substring("text", 1, LETTERS)).alias("text"))
    order = Window.partitionBy("declared").orderBy("h")
    least = some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= share).select("declared", "text")
    return fit_text_model(((r["declared"], r["text"]) for r in least.toLocalIterator()), sorted(sizes))


def html_declared(html: Column) -> Column:
    """Language of the markup's lang attribute, without its region; NULL if there is none."""
    lang = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(lang != "", lang)


def html_text(html: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(plain, r"<[^>]*>", " ")


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def host_suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def _best(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches):
        ll, n = model.score([t or "" for t in batch.column("text").to_pylist()])
        best = pa.array(ll.argmax(1).astype(np.int32), mask=n == 0)
        yield pa.record_batch([*(batch.column(c) for c in ("host", "suffix", "declared")), best], ["host", "suffix", "declared", "best"])


def evidence(rows: DataFrame, model: TextModel, smoothing: float = SMOOTHING) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(host, prior) for each host, log P(declared | language) and the table's own prior, all from the text's best language of all rows.

    Counts by host are folded before the shuffle; a host's prior leans on its suffix's, and that on the table's.
    """
    spark, size = rows.sparkSession, len(model.languages)
    shared = spark.sparkContext.broadcast(model)
    best = rows.select("host", "suffix", "declared", "text").mapInArrow(lambda b: _best(b, shared.value), "host string, suffix string, declared string, best int")
    counts = stored(best.where("best IS NOT NULL").groupBy("host", "suffix", "declared", "best").agg(F.count(F.lit(1)).alias("n")))
    each = [F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0)).cast("double") for i in range(size)]
    told = {(r["declared"], r["best"]): r["n"] for r in counts.where(F.col("declared").isin(model.languages)).groupBy("declared", "best").agg(F.sum("n").alias("n")).collect()}
    # at most languages ** 2 cells; other declared languages are no evidence
    table = np.array([[told.get((d, i), 0) + DECLARED_FLOOR for d in model.languages] for i in range(size)])
    all_ = counts.agg(*[F.coalesce(e, F.lit(0.0)).alias(f"c{i}") for i, e in enumerate(each)]).first()
    whole = (np.array(all_) + 1.0) / (sum(all_) + size)

    def smoothed(own: Column, wider: Column) -> Column:
        n = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, wider, lambda c, p: (c + F.lit(smoothing) * p) / (n + F.lit(smoothing)))

    suffixes = counts.groupBy("suffix").agg(F.array(*each).alias("c")).select("suffix", smoothed(F.col("c"), F.array(*[F.lit(float(p)) for p in whole])).alias("wider"))
    hosts = counts.where("host IS NOT NULL").groupBy("host", "suffix").agg(F.array(*each).alias("c"))
    joined = hosts.join(stored(suffixes), "suffix", "left")
    wide = F.coalesce("wider", F.array(*[F.lit(float(p)) for p in whole]))
    priors = stored(joined.select("host", smoothed(F.col("c"), wide).alias("prior")))
    return priors, np.log(table / table.sum(1, keepdims=True)), whole


def fused(batches: Iterable[pa.RecordBatch], model: TextModel, declared: np.ndarray, whole: np.ndarray, least: float) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray, list, np.ndarray]]:
    """Of each slice: the slice, best language, its probability, the text's own language, and whether it is accepted."""
    place = {l: i for i, l in enumerate(model.languages)}
    floor = -np.log(CELLS)
    for batch in byte_slices(batches):
        ll, n = model.score([t or "" for t in batch.column("text").to_pylist()])
        prior = np.array([p if p is not None else whole for p in batch.column("prior").to_pylist()]).reshape(len(n), -1)
        post = TEMPER * ll + np.log(prior)
        at = np.array([place.get(d, -1) for d in batch.column("declared").to_pylist()])
        post[at >= 0] += declared[:, at[at >= 0]].T
        post -= post.max(1, keepdims=True)
        p = np.exp(post) / np.exp(post).sum(1, keepdims=True)
        best = p.argmax(1)
        # a text without letters, or one less likely than evenly drawn trigrams, is in no known language
        known = (n > 0) & (ll[np.arange(len(n)), best] >= floor * np.maximum(n, 1))
        language = [model.languages[b] if k else None for b, k in zip(best, known)]
        own = [model.languages[b] if k else None for b, k in zip(ll.argmax(1), known)]
        yield batch, language, p.max(1), own, known & (p.max(1) >= least)


def _with_evidence(rows: DataFrame, sample: int):
    model = labelled_sample(rows, sample)
    if model is None:
        return None
    priors, declared, whole = evidence(rows, model)
    parts = rows.sparkSession.sparkContext.broadcast((model, declared, whole))
    return rows.join(priors, "host", "left"), parts


def identified(rows: DataFrame, id_column: str, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """(id_column, language, probability, text_language, declared, accepted) of rows (id_column, text, declared, host, suffix).

    A language is accepted if its probability is `least` or more and the text is likelier than chance. A NULL, empty
    or letterless text has no language and is not accepted. A NULL or unknown declared language, host or suffix is no
    evidence. If no row declares a language nothing is known: language NULL, not accepted. Repeated rows and NULL ids
    keep one row each; an empty table gives none.
    """
    schema = f"`{id_column}` long, language string, probability double, text_language string, declared string, accepted boolean"
    rows = rows.select(F.col(id_column).cast("long").alias(id_column), "text", "declared", "host", "suffix")
    found = _with_evidence(rows, sample)
    if found is None:
        return rows.select(id_column, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"),
                           F.lit(None).cast("string").alias("text_language"), "declared", F.lit(False).alias("accepted"))
    rows, parts = found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, language, p, own, ok in fused(batches, *parts.value, least):
            p = pa.array(p, mask=np.array([x is None for x in language], bool))
            yield pa.record_batch([batch.column(id_column), pa.array(language, pa.string()), p, pa.array(own, pa.string()), batch.column("declared"), pa.array(ok)],
                                  [id_column, "language", "probability", "text_language", "declared", "accepted"])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, declared: Column, host: Column, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The documents whose language is accepted, with their own columns only; see `identified`. If no document declares
    a language there is no model, and all documents stay."""
    columns, fields = docs.columns, docs.schema
    rest = [c for c in columns if c != "text"]
    rows = docs.select("text", F.struct(*rest).alias("rest"), declared.alias("declared"), host.alias("host"), F.lit(None).cast("string").alias("suffix"))
    found = _with_evidence(rows, sample)
    if found is None:
        return docs
    rows, parts = found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, *_, ok in fused(batches, *parts.value, least):
            yield batch.select(["text", "rest"]).filter(pa.array(ok))

    kept = rows.select("text", "rest", "declared", "prior").mapInArrow(run, rows.select("text", "rest").schema)
    return kept.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in columns])


def documents_evidence(docs: DataFrame) -> DataFrame:
    """Documents as rows for `identified`: what they declare is `lang`, and their source stands for a host."""
    return docs.select("doc_id", "text", F.lower("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))


def pages_evidence(pages: DataFrame) -> DataFrame:
    """Web pages as rows for `identified`: markup language, host and suffix of the address."""
    host = url_host(F.col("url"))
    return pages.select("page_id", html_text(F.col("html")).alias("text"), html_declared(F.col("html")).alias("declared"), host.alias("host"), host_suffix(host).alias("suffix"))
