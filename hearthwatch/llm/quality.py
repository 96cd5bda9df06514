"""Quality rules: base limits on document statistics, then gradient-boosted trees with monotonic constraints, flattened
into numpy node arrays and scored a slice of documents at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthwatch.llm.base import SPACES, byte_slices, mixed, span_hashes, word_spans

SAMPLE = 4000  # labelled documents that the trees are fitted on, at most
LEAST_WORDS, MOST_REPEATED = 50, 50  # fixed values: words, and percent of words in repeated windows
SYMBOLS = b"#*$%&|<>"  # fixed value

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "other_marks", "distinct_words", "words_a_line")
#: +1: the score may only rise with the feature, -1: only fall
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1}

_SYMBOL, _UPPER, _DIGIT, _LETTER = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True


def statistics(text: str) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of the trees."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = word_spans(data)
    n = len(starts)
    spaces = int(SPACES[data].sum())
    chars = int(((data & 0xC0) != 0x80).sum()) - spaces
    symbols = int(_SYMBOL[data].sum())
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup_lines = len(lines) - len(set(lines))
    words = span_hashes(data, starts, ends)
    repeat = 0
    if n >= 3:
        w = mixed(mixed(words[:-2] * np.uint64(3) + words[1:-1]) * np.uint64(5) + words[2:])
        _, inverse, count = np.unique(w, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= again
        repeat = int(inside.sum())
    distinct = len(np.unique(words))
    size, marks = max(1, len(data)), int((~(_LETTER | _DIGIT | SPACES | _SYMBOL))[data].sum())
    return [n, chars, symbols, dup_lines, repeat], [
        float(np.log1p(n)), chars / max(1, n), symbols / max(1, chars), dup_lines / max(1, len(lines)), repeat / max(1, n),
        float(_UPPER[data].sum()) / size, float(_DIGIT[data].sum()) / size, marks / size, distinct / max(1, n), n / max(1, len(lines)),
    ]


@dataclass
class Trees:
    """All nodes of all trees side by side. A leaf points at itself, so every tree is walked `depth` steps at once."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for each row of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15,
              least: int = 8, ridge: float = 1.0, bins: int = 64) -> Trees:
    """Boosted trees for log-odds of y, by histograms of gradients.

    A split on a constrained feature counts only if its two values are in order, and the values below it are kept on
    their sides of the middle between them: so every tree, and their sum, is monotonic in that feature.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # x <= edge k: bin k at most
    rate_of_good = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate_of_good / (1 - rate_of_good)))
    score = np.full(len(y), start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def node() -> int:
        for column, empty in ((feature, 0), (threshold, np.inf), (left, len(left)), (right, len(left)), (value, 0.0)):
            column.append(empty)
        return len(feature) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        at = node()
        left[at] = right[at] = at
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f in range(x.shape[1]) if level < depth and len(rows) >= 2 * least else ():
            b = binned[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, len(edges[f]) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            for k in np.flatnonzero((nl >= least) & (len(rows) - nl >= least)):
                a, c = leaf(gl[k], hl[k], low, high), leaf(g - gl[k], h - hl[k], low, high)
                if monotone[f] * (c - a) < 0:
                    continue
                gain = gl[k] ** 2 / (hl[k] + ridge) + (g - gl[k]) ** 2 / (h - hl[k] + ridge) - g**2 / (h + ridge)
                if gain > best[0]:
                    best = (gain, f, k, a, c)
        _, f, k, a, c = best
        if f < 0:
            value[at] = rate * leaf(g, h, low, high)
            score[rows] += value[at]
            return at
        feature[at], threshold[at], middle = f, edges[f][k], (a + c) / 2
        below = binned[rows, f] <= k
        up = monotone[f]
        left[at] = grow(rows[below], level + 1, middle if up < 0 else low, middle if up > 0 else high)
        right[at] = grow(rows[~below], level + 1, middle if up > 0 else low, middle if up < 0 else high)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    return Trees(*(np.array(c) for c in (feature, threshold, left, right, value, roots)), depth, start)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches):
        rows = [statistics(t or "")[1] for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees from at most `sample` labelled documents, those of least hash of the id; None if one class is missing.

    Labels without an id or a quality, and labels of absent documents, are left out; of repeated ones the least counts.
    """
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(some, "doc_id").mapInArrow(_features, "doc_id long, quality int, x array<double>")
    rows = sorted({r["doc_id"]: r for r in texts.limit(2 * sample).collect()}.items())
    if len({r["quality"] for _, r in rows}) < 2:
        return None
    x, y = np.array([r["x"] for _, r in rows]), np.array([float(r["quality"]) for _, r in rows])
    return fit_trees(x, y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def quality_verdicts(docs: DataFrame, labels: DataFrame, cut: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of every document.

    A document with under 50 words, or over half of its words in repeated windows of three, fails the base limits and
    goes; another one stays if the trees give it a probability of good quality of `cut` at least. Without labels of
    both classes there are no trees: the score is NULL and the base limits decide. A NULL text has no words. Repeated
    rows and NULL ids keep one row each; an empty table gives none; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trees = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            both = [statistics(t or "") for t in batch.column("text").to_pylist()]
            counts = np.array([b[0] for b in both])
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            score = None
            kept = ~failed
            if trees.value is not None:
                score = 1 / (1 + np.exp(-trees.value.scores(np.array([b[1] for b in both]))))
                kept = kept & (score >= cut)
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(kept),
                 pa.nulls(len(both), pa.float64()) if score is None else pa.array(score)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
