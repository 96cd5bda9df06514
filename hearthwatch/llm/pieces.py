"""Token counts by pre-token: pieces are counted once for each distinct pre-token, joined to the pre-token frequencies
of the documents and summed; no ids are made."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthwatch.llm.base import byte_slices, stored, texts_of

SPACE = "▁"  # fixed value: the library writes a space as this character
HEAD = 1 << 18  # most frequent pre-tokens that travel as a broadcast map
HEAD_LENGTH = 32  # characters of such a pre-token at most: the map is below 16 MB whatever the corpus
PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

_MODELS: dict[str, tuple] = {}


def _model(path: str) -> tuple:
    """The library's processor, and whether line ends part pre-tokens too; once a worker."""
    if path not in _MODELS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(SPACE in p.strip(SPACE) or (p.strip(SPACE) and p.endswith(SPACE)) for p in pieces):
            raise ValueError("a piece of this model spans two words: pre-tokens are not independent")
        _MODELS[path] = sp, not any("\n" in p for p in pieces)
    return _MODELS[path]


def pre_tokens(text: str, lines: bool) -> list[str]:
    """Parts of a text that no piece can span: a run of spaces with the word behind it, and line ends where no piece
    has one. The leading space is the one that the library puts in front."""
    if not text:
        return []
    text = SPACE + text.replace(" ", SPACE)
    if not lines:
        return PRE_TOKEN.findall(text)
    out = []
    for i, line in enumerate(text.split("\n")):
        if i:
            out.append("\n")
        out += PRE_TOKEN.findall(line)
    return out


def _count(sp, words: list[str]) -> list[int]:
    """Pieces of each pre-token. The library puts a space in front, so the pre-token's own first one is left out. A
    pre-token without one, or of one space only, is counted behind a line end, which is a piece of its own."""
    shape = [w[0] == SPACE and w != SPACE for w in words]
    n = [len(x) for x in sp.encode([w[1:] if s else "\n" + w for w, s in zip(words, shape)], num_threads=1)]
    before = len(sp.encode("\n"))
    return [k if s else k - before for k, s in zip(n, shape)]


def _vocabulary(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lines = _model(path)
        for batch in byte_slices(batches, limit=16 << 20):
            seen: Counter = Counter()
            for text in texts_of(batch):
                seen.update(pre_tokens(text, lines))
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return run


def _sizes(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = _model(path)
        for batch in byte_slices(batches, "word"):
            words = batch.column("word").to_pylist()
            yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array(_count(sp, words), pa.int32())], ["word", "n", "pieces"])

    return run


def _frequencies(path: str, head):
    """Of each document one row with what the head map gives, and one for each other distinct pre-token."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _, lines = _model(path)
        known = head.value
        row = TaskContext.get().partitionId() << 40
        for batch in byte_slices(batches):
            rows, ids, sizes, words, counts = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                total, rest = 0, []
                for w, n in Counter(pre_tokens(text, lines)).items():
                    k = known.get(w)
                    if k is None:
                        rest.append((w, n))
                    else:
                        total += k * n
                rows += [row] * (len(rest) + 1)
                ids += [doc_id] + [None] * len(rest)
                sizes += [len(text.encode())] + [None] * len(rest)
                words += [None] + [w for w, _ in rest]
                counts += [total] + [n for _, n in rest]
                row += 1
            yield pa.record_batch(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.string()), pa.array(counts, pa.int64())],
                ["row", "doc_id", "n_bytes", "word", "n"],
            )

    return run


def _head(sizes: DataFrame, head: int) -> dict[str, int]:
    """Pieces of at most `head` frequent short pre-tokens: those of the highest classes of frequency that fit whole.

    The classes are sixteenths of a power of two, a thousand at most, so finding the cut needs no ordering of words.
    """
    short = sizes.where(F.length("word") <= HEAD_LENGTH).withColumn("level", F.floor(F.log2("n") * 16))
    least, total = None, 0
    for level, n in sorted(map(tuple, short.groupBy("level").count().collect()), reverse=True):
        total += n
        if total > head:
            break
        least = level
    if least is None:
        return {}
    return {r["word"]: r["pieces"] for r in short.where(F.col("level") >= least).select("word", "pieces").toLocalIterator()}


def token_counts(docs: DataFrame, model: str, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """Tokens of every document: (doc_id, n_bytes, n_tokens, over_limit).

    `model` is the path of a piece model, the same on every machine. Up to `head` frequent pre-tokens travel as a
    map of bounded size; all others meet their counts in a join on the pre-token. A document's rows are tied by a
    number of their own, so repeated and NULL ids keep one row each. A NULL text is empty: no tokens. An empty table
    gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = docs.select("text").mapInArrow(_vocabulary(model), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sizes = stored(words.mapInArrow(_sizes(model), "word string, n long, pieces int"))
    known = docs.sparkSession.sparkContext.broadcast(_head(sizes, head))
    rows = docs.mapInArrow(_frequencies(model, known), "row long, doc_id long, n_bytes long, word string, n long")
    rows = stored(rows)
    rest = rows.where("word IS NOT NULL").join(sizes.select("word", "pieces"), "word").select("row", F.expr("n * pieces AS n"))
    base = rows.where("word IS NULL").select("row", "doc_id", "n_bytes", "n")
    tokens = rest.groupBy("row").agg(F.sum("n").alias("more"))
    return base.join(tokens, "row", "left").select(
        "doc_id", "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
