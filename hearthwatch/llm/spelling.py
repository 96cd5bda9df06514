"""Spelling variants: words one edit apart, found by pivotal grams.

Of each word's rarest bigrams (its gram prefix) two that share no letter are its pivots. One edit leaves at least one of
two disjoint grams as it is, so of two near words, the pivots of one meet the gram prefix of the other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthwatch.llm.base import byte_slices, stored, texts_of

# fixed values: letters of a run, the modulus that marks a run, and what counts as a word
RUN = re.compile("[A-Za-zÀ-ÿ]{6,}")
MARK, LENGTH, LEAST, TIMES = 199, 6, 5, 5
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
ALPHABET = 26 + 64  # letters that are left after lower-casing
KEPT = 1 << 18  # distinct words that a task counts before it hands them on


def _word(doc_id: int | None, run: str) -> str:
    """The run, without one letter if the checksum of document and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % MARK:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task; shorter runs than LENGTH cannot become words."""

    def packed(seen: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for part in byte_slices([batch]):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                for run, n in Counter(RUN.findall(text)).items():
                    word = _word(doc_id, run.lower() if run.isascii() else run.translate(LOWER))
                    if len(word) >= LENGTH:
                        seen[word] += n
            if len(seen) >= KEPT:
                yield packed(seen)
                seen.clear()
    yield packed(seen)


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n) of the words that occur `least` times or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least)


def gram_frequencies(words: DataFrame) -> dict[str, int]:
    """Words' bigrams and how often each occurs. There are at most ALPHABET ** 2 = 8,100 of them."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    return {r["gram"]: r["count"] for r in grams.groupBy("gram").count().collect()}


def gram_prefix(word: str, frequency: dict[str, int]) -> tuple[list[tuple[int, str, int]], int, str]:
    """The rarest positional grams (frequency, gram, position), and the last gram's place in the order of rareness.

    Three grams are enough, since one edit spoils two at most; other places of the last one are in it too, so that the
    prefix holds every gram of the word up to that place.
    """
    grams = sorted((frequency[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
    last = grams[min(2, len(grams) - 1)][:2]
    return [g for g in grams if g[:2] <= last], *last


def pivots(prefix: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The two grams of a prefix that share no letter and are rarest together.

    Over positions from left to right, `best[k]` is the cheapest choice of k disjoint grams among those that end
    before the present one begins.
    """
    by_place = sorted(prefix, key=lambda g: g[2])
    nothing: tuple[int, tuple] = (0, ())
    choices: list[list[tuple[int, tuple] | None]] = []  # choices[i][k]: the cheapest k grams among the first i
    choices.append([nothing, None, None])
    for i, gram in enumerate(by_place):
        free = i  # grams that end before this one begins
        while free and by_place[free - 1][2] + 2 > gram[2]:
            free -= 1
        row = [nothing]
        for k in (1, 2):
            without, before = choices[i][k], choices[free][k - 1]
            with_it = before and (before[0] + gram[0], (*before[1], gram))
            row.append(min((c for c in (without, with_it) if c), default=None))
        choices.append(row)
    return list(choices[-1][2][1])


def _keys(frequency):
    """Of each word its keys in the index: `pivot` rows ask, the others are asked.

    With one edit, what is on one side of an unharmed gram is unharmed too. So a key is the gram with all that is left
    of it, which fixes its position from the front, or with all that is right of it, which fixes it from the end; and
    the length of the word that is sought, one less or more or the same.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequency.value
        for batch in batches:
            rows = []
            for word in batch.column("word").to_pylist():
                prefix, often, gram = gram_prefix(word, known)
                size = len(word)
                for is_pivot, grams, lengths in ((False, prefix, (size,)), (True, pivots(prefix), (size - 1, size, size + 1))):
                    for _, _, at in grams:
                        for length in lengths:
                            rows.append((word, is_pivot, "<" + word[: at + 2], length, often, gram))
                            rows.append((word, is_pivot, ">" + word[at:], length, often, gram))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.string()]
            names = ["word", "is_pivot", "key", "length", "often", "last_gram"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): every two words that differ by exactly one inserted, deleted or replaced code point, both ways.

    The word whose last prefix gram is the rarer one asks with its pivots (either may, if it is the same): whichever
    pivot is unharmed comes no later in the order of rareness, so it is in the other's prefix.
    """
    frequency = words.sparkSession.sparkContext.broadcast(gram_frequencies(words))  # at most 8,100 entries
    keys = stored(words.select("word").mapInArrow(
        _keys(frequency), "word string, is_pivot boolean, key string, length int, often long, last_gram string"))
    asking = keys.filter("is_pivot").select("key", "length", F.col("word").alias("a"), F.col("often").alias("often_a"), F.col("last_gram").alias("last_a"))
    asked = keys.filter("NOT is_pivot").select("key", "length", F.col("word").alias("b"), F.col("often").alias("often_b"), F.col("last_gram").alias("last_b"))
    met = asking.join(asked, ["key", "length"]).filter(
        "a <> b AND (often_a < often_b OR often_a = often_b AND last_a <= last_b) AND levenshtein(a, b, 1) = 1")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following `form` from a word ends.

    Each round lets a word jump as far as its aim has come, so the way doubles; since a form is at least TIMES as
    frequent as its word, no way is longer than the logarithm of the largest count.
    """
    way = stored(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(way.join(further, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        way = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return way


def spelling_variants(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Words and the more frequent spelling they are variants of: (word, form, root, n, n_near, form_n).

    Whole texts are read; a NULL text has no words, and a NULL id stands as an empty string in the checksum. Words occur
    `least` times or more. A word's form is the most frequent of its near words (the first in code-point order of
    equally frequent ones) if that one is `times` as frequent at least, else NULL. Repeated rows count each time; an
    empty table gives no rows; other columns are not read. A word is at most as long as the longest run of letters.
    """
    words = stored(word_counts(docs, least))
    counts = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = near_words(words).join(counts, "b").groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best"))
    is_form = -F.col("best.less") >= F.lit(times) * F.col("n")
    forms = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.b")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n")))
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
