"""Whitening of embeddings by exact cross-products: bit planes of each dimension are packed into words across rows, and
popcounts of ANDed planes, weighted by their places, add up to the sums of products."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthwatch.llm.base import stored

SCALE, OFFSET = 64, 1_000_000  # fixed values: x = floor(SCALE * c) + OFFSET
ROWS = 1 << 15  # rows whose planes are packed at once
CELLS = 1 << 22  # entries of such a block at most, so that wide vectors come in fewer rows
MOST = 1 << 40  # products of larger numbers could leave the 123 bits in which they are added up
LONG = 2**63 - 1


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows of one vector length, as a matrix, at most ROWS rows and CELLS entries each (a longer vector comes
    alone); vectors of no length are left out."""
    lists = batch.column(column)
    widths = np.diff(lists.offsets.to_numpy())
    start = 0
    while start < len(widths):
        width = int(widths[start])
        other = np.flatnonzero(widths[start:] != width)
        most = min(ROWS, max(1, CELLS // max(width, 1)))
        n = min(most, int(other[0]) if len(other) else len(widths) - start)
        if width:
            part = batch.slice(start, n)
            values = part.column(column).flatten()
            yield part, values.to_numpy(zero_copy_only=False).reshape(n, width)
        start += n


def _whole_numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, x) of the rows whose vector is finite."""
    for batch in batches:
        known = batch.filter(batch.column("embedding").is_valid())
        # a NULL entry reads as NaN, which is not finite
        for part, c in _blocks(known, "embedding"):
            c = c.astype(np.float64)
            scaled = np.floor(c * SCALE)
            good = np.isfinite(scaled).all(axis=1)
            if (np.abs(scaled[good]) > MOST).any():
                raise ValueError(f"an entry beyond {MOST // SCALE} is too large for exact sums")
            x = scaled[good].astype(np.int64) + OFFSET
            ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.record_batch(
                [part.column("vec_id").filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["vec_id", "x"]
            )


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shift, sums, products) of the rows of an integer matrix: for d = x - shift, the sums of d[i] and, for i <= j, of
    d[i] * d[j] over the rows.

    Each dimension is shifted to its least value here; plane p of dimension i holds bit p of d[i] of all rows, 64 rows
    a word. Two planes meet in popcount(a & b) rows, which counts 2 ** (p + q) each.
    """
    shift, width = x.min(axis=0), x.shape[1]
    d = (x - shift).astype(np.uint64)
    bits = [int(most).bit_length() for most in d.max(axis=0)]
    # sums of `rows` products of numbers of so many bits fit a long, or else are kept as Python's integers
    whole = np.int64 if 2 * max(bits) + len(x).bit_length() < 63 else object
    sums, products = np.zeros(width, whole), np.zeros((width, width), whole)
    if not any(bits):
        return shift, sums, products
    padded = np.zeros(-len(d) % 64 + len(d), np.uint8)
    planes = []
    for i, n in enumerate(bits):
        for p in range(n):
            padded[: len(d)] = (d[:, i] >> np.uint64(p)) & np.uint64(1)
            planes.append(np.packbits(padded).view(np.uint64))
    words, owner = np.array(planes), np.repeat(np.arange(width), bits)
    place = np.concatenate([np.arange(n) for n in bits])
    weight = np.array([1 << int(p) for p in place], whole)
    first = np.searchsorted(owner, np.arange(width))  # where the planes of a dimension begin
    for a, (i, p) in enumerate(zip(owner.tolist(), place.tolist())):
        met = np.bitwise_count(words[a] & words[a:]).sum(axis=1, dtype=np.int64).astype(whole) * weight[a:]
        sums[i] += met[0]
        own = bits[i] - p
        # planes of one dimension meet as (p, q) and as (q, p)
        products[i, i] += (met[0] + 2 * met[1:own].sum()) * weight[a]
        if own < len(met):
            others = np.unique(owner[a + own :])
            products[i, others] += np.add.reduceat(met[own:], first[others] - a - own) * weight[a]
    return shift, sums, products


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, i, j, total) of a task: sums of x[i] * x[j] for i <= j, sums of x[i] as j = -1, the rows as i = j = -1."""
    n, first, second = {}, {}, {}
    for batch in batches:
        for _, x in _blocks(batch, "x"):
            width, rows = x.shape[1], len(x)
            shift, sums, products = (part.astype(object) for part in scatter(x))
            n[width] = n.get(width, 0) + rows
            first[width] = first.get(width, 0) + sums + rows * shift
            # (d + a)(e + b) = de + ae + bd + ab, summed
            upper = products + np.outer(shift, sums) + np.outer(sums, shift) + rows * np.outer(shift, shift)
            second[width] = second.get(width, 0) + upper
    for width, rows in n.items():
        i, j = np.triu_indices(width)
        ones = np.full(width, -1)
        totals = [rows, *first[width], *second[width][i, j]]
        places = (np.concatenate([[-1], np.arange(width), i]), np.concatenate([[-1], ones, j]))
        # sums go as two parts of 60 bits, each of which Spark adds up as a decimal
        yield pa.record_batch(
            [pa.array(np.full(len(totals), width), pa.int32()), pa.array(places[0], pa.int32()), pa.array(places[1], pa.int32()),
             pa.array([int(t) >> 60 for t in totals], pa.int64()), pa.array([int(t) & ((1 << 60) - 1) for t in totals], pa.int64())],
            ["width", "i", "j", "high", "low"],
        )


class Whitening:
    """What is fitted on vectors of one length: rows n, sums S, and the components of the covariance.

    `factor[:, k]` is component k over the root of its eigenvalue. Components that the eigenvalues' rounding cannot tell
    from zero are left out, as nothing can be divided by their root.
    """

    def __init__(self, n: int, sums: list[int], products: dict[tuple[int, int], int], most: int) -> None:
        width = len(sums)
        self.n = n
        self.means, self.rests = (np.array(part, np.int64) for part in zip(*(divmod(t, n) for t in sums)))
        covariance = np.empty((width, width))
        for (i, j), total in products.items():
            # centred as integers; the division of integers rounds once
            covariance[i, j] = covariance[j, i] = (n * total - sums[i] * sums[j]) / (n * n)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1][:most]
        least = np.finfo(float).eps * width * max(values[-1], 0.0)
        order = [k for k in order.tolist() if values[k] > least]
        # of the two signs, the one that makes the largest entry positive
        signs = np.array([np.sign(vectors[np.argmax(np.abs(vectors[:, k])), k]) for k in order])
        self.factor = vectors[:, order] * (signs / np.sqrt(values[order]))
        self.explained = values[order] / np.trace(covariance)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S / n, and n * x - S, which is right as far as a long holds it (overflow wraps)."""
        distance = x - self.means
        exact = np.int64(self.n) * distance - self.rests
        near = np.abs(distance) < LONG // 2 // self.n
        return np.where(near, exact / self.n, distance - self.rests / self.n), exact

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x)[0] @ self.factor


def _fits(distinct: DataFrame, most: int) -> dict[int, Whitening]:
    """The fit of each vector length; the driver gets d * (d + 3) / 2 + 1 sums of a length d, however many rows."""
    totals = distinct.mapInArrow(_sums, "width int, i int, j int, high long, low long").groupBy("width", "i", "j").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in totals.collect():
        found.setdefault(r["width"], {})[r["i"], r["j"]] = (int(r["high"]) << 60) + int(r["low"])
    return {
        width: Whitening(t[-1, -1], [t[i, -1] for i in range(width)], {k: v for k, v in t.items() if k[1] >= 0}, most)
        for width, t in found.items()
    }


def _moments(fits):
    """(width, i, j, total): sums of whitened[i] * whitened[j] over a task's rows, of whitened[i] as j = -1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, second = fits.value, {}, {}
        for batch in batches:
            for _, x in _blocks(batch, "x"):
                fit, width = known[x.shape[1]], x.shape[1]
                y = fit.whitened(x)
                first[width] = first.get(width, 0) + y.sum(axis=0)
                second[width] = second.get(width, 0) + y.T @ y
        for width, s in first.items():
            k = len(s)
            i, j = np.indices((k, k))
            yield pa.record_batch(
                [pa.array(np.full(k + k * k, width), pa.int32()), pa.array(np.concatenate([np.arange(k), i.ravel()]), pa.int32()),
                 pa.array(np.concatenate([np.full(k, -1), j.ravel()]), pa.int32()), pa.array(np.concatenate([s, second[width].ravel()]))],
                ["width", "i", "j", "total"],
            )

    return run


def _identity_errors(distinct: DataFrame, fits, known: dict[int, Whitening]) -> dict[int, float]:
    """How far the covariance of the whitened fit list is from the identity, measured on the rows."""
    sums = distinct.mapInArrow(_moments(fits), "width int, i int, j int, total double").groupBy("width", "i", "j").agg(F.sum("total").alias("total"))
    found = {width: np.zeros((fit.factor.shape[1] + 1,) * 2) for width, fit in known.items()}
    for r in sums.collect():
        found[r["width"]][r["i"], r["j"]] = r["total"] / known[r["width"]].n
    return {
        width: float(np.abs(m[:-1, :-1] - np.outer(m[:-1, -1], m[:-1, -1]) - np.eye(len(m) - 1)).max(initial=0.0)) for width, m in found.items()
    }


def _components(fits, errors: dict[int, float]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = fits.value
        for batch in _whole_numbers(batches):
            for part, x in _blocks(batch, "x"):
                fit = known[x.shape[1]]
                k = fit.factor.shape[1]
                centred, exact = fit.centred(x)
                deviation = (exact * exact).sum(axis=1)
                too_large = ((centred * fit.n) ** 2).sum(axis=1) > LONG
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.record_batch(
                    [part.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                     pa.array(np.full(len(rows), fit.n)), pa.array(deviation[rows], mask=too_large[rows]),
                     pa.array((centred @ fit.factor).ravel()), pa.array(np.tile(fit.explained, len(x))),
                     pa.array(np.full(len(rows), errors[x.shape[1]]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whitened(vectors: DataFrame, most: int = 16) -> DataFrame:
    """Whitened embeddings: (vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector
    and component up to `most`.

    Entries become integers (see SCALE and OFFSET), the fit is on the distinct integer vectors, and all sums are exact
    integers until the covariance is divided. Rows whose vector is NULL or holds a NULL or an entry that is not finite
    are dropped. Vectors of different lengths are different spaces: those of each length are whitened among themselves,
    and a vector without entries has no components. Components of no variance (all vectors equal, or fewer of them than
    dimensions) are left out; so a table of one distinct vector gives no rows, nor does an empty one. Ties of
    eigenvalues are in the solver's order, the same for all rows. Repeated rows and NULL ids each keep their rows. A
    deviation beyond a long is NULL; an entry beyond 2**34 raises. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = rows.select(F.lit(None).cast("long").alias("vec_id"), "embedding").mapInArrow(_whole_numbers, "vec_id long, x array<long>")
    distinct = stored(whole.select("x").distinct())
    known = _fits(distinct, most)
    fits = vectors.sparkSession.sparkContext.broadcast(known)  # d * most numbers for a length d
    errors = _identity_errors(distinct, fits, known)
    return rows.mapInArrow(
        _components(fits, errors),
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
