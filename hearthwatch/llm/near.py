"""MinHash near-dedup with HyperMinHash registers: bands of compressed registers find candidates, estimates corrected
for collisions thin them out, and full shingle sets confirm every link."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthwatch.llm.base import ROW, byte_slices, mixed, span_hashes, stored, word_spans
from hearthwatch.llm.components import components

SHINGLE = 5
BANDS, ROWS = 36, 6  # at 85 percent; other thresholds have their own
REGISTERS = BANDS * ROWS
MISSED = 4e-8  # part of the pairs at the threshold that share no band, at most
MANTISSA = 10  # bits kept behind the leading-zero count: registers are 16 bits
SPREAD = 5.5  # standard errors by which an estimate may lie below the threshold and still be verified
BLOCK = 1024  # documents of a bucket or candidate group that are compared at a time
BLOCK_SHINGLES = 1 << 20  # shingles of the documents of a candidate group that are compared at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text; with fewer words, of all words as one."""
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    words = span_hashes(data, starts, ends)
    k = min(SHINGLE, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(0x9DDFEA08EB382D69) + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash: the least value of each bucket as its leading-zero count and the MANTISSA bits behind the first one.

    Buckets that no hash falls into borrow from one that has, in an order fixed by the bucket: so small sets have
    full registers too, and two registers are still equal with the probability of the sets' similarity.
    """
    bucket = ((mixed(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    value = mixed(hashes + np.uint64(0xE7037ED1A0B428DB))
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    np.minimum.at(least, bucket.astype(np.intp), value)
    filled = np.zeros(REGISTERS, bool)
    filled[bucket.astype(np.intp)] = True
    empty, tries = np.flatnonzero(~filled), np.uint64(1)
    while len(empty):
        lender = (mixed(empty.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + tries) % np.uint64(REGISTERS)).astype(np.intp)
        found = filled[lender]
        least[empty[found]] = least[lender[found]]
        empty, tries = empty[~found], tries + np.uint64(1)
    _, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint64)
    rest = np.where(zeros < 63, least << (zeros + np.uint64(1)), np.uint64(0))
    return ((zeros << np.uint64(MANTISSA)) | (rest >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def bands_of(percent: int) -> tuple[int, int]:
    """(bands, rows of each) for a threshold: as many rows as leave no more than MISSED of the pairs at it without a band
    in common; 36 x 6 at 85 percent, 43 x 5 at 80."""
    for rows in range(REGISTERS, 0, -1):
        bands = REGISTERS // rows
        if 0 < percent <= 100 and (1 - (percent / 100) ** rows) ** bands <= MISSED:
            return bands, rows
    raise ValueError(f"{REGISTERS} registers have no bands for a threshold of {percent} percent")


def band_keys(regs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of a (documents, REGISTERS) matrix."""
    parts = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(regs), bands))
    for i in range(rows):
        key = mixed(key * np.uint64(0x9DDFEA08EB382D69) + parts[:, :, i])
    return key.view(np.int64)


def chance_matches(sizes: np.ndarray) -> np.ndarray:
    """Probability that a register of a set of each size equals one of an unrelated set of the same size: the sum over
    leading-zero counts and mantissas of the squared probability of that register."""
    k = np.maximum(sizes / REGISTERS, 1.0)[:, None]
    width = 2.0 ** -np.arange(1, 65)[None, :]
    middle = 1.5 * width
    density = k * np.exp((k - 1) * np.log1p(-middle))
    return (density**2 * width**2 * 2.0**-MANTISSA).sum(1)


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches):
        h1, h2, n, regs = [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text or "")
            n.append(len(s))
            order = np.arange(1, len(s) + 1, dtype=np.uint64)
            h1.append(int(np.bitwise_xor.reduce(mixed(s + order)).view(np.int64)) if len(s) else 0)
            h2.append(int(mixed(s * np.uint64(3) + order).sum().view(np.int64)) if len(s) else 0)
            regs.append(registers(s).tobytes() if len(s) else None)
        own = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch(
            [*(batch.column(c) for c in own), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(regs, pa.binary())],
            [*own, "h1", "h2", "n", "regs"],
        )


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _banded(bands: int, rows: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column("regs")), bands, rows)
                yield pa.record_batch([pa.array(np.repeat(batch.column("rep").to_numpy(), bands)), pa.array(keys.ravel())], ["rep", "key"])

    return run


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of one group after the other, from batches sorted by `keys`; a group is as large as two blocks at most."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            if kept:
                same = all(kept[-1].column(k)[0].as_py() == batch.column(k)[0].as_py() for k in keys)
                if not same:
                    yield pa.Table.from_batches(kept)
                    kept = []
                elif len(change):
                    kept.append(batch.slice(0, change[0]))
                    yield pa.Table.from_batches(kept)
                    kept, batch = [], batch.slice(change[0])
                    continue
            edges = [0, *change.tolist()]
            for a, b in zip(edges, edges[1:]):
                yield pa.Table.from_batches([batch.slice(a, b - a)])
            kept.append(batch.slice(edges[-1]))
            break
    if kept:
        yield pa.Table.from_batches(kept)


def _least(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n members the first one that it is connected to."""
    first = np.arange(n)
    links = [np.stack(p) for p in pairs]
    a, b = np.concatenate(links, axis=1) if links else (np.empty(0, int), np.empty(0, int))
    while True:
        low = np.minimum(first[a], first[b])
        old = first.copy()
        np.minimum.at(first, a, low)
        np.minimum.at(first, b, low)
        first = np.minimum(first, first[first])
        if np.array_equal(old, first):
            return first


def _edges(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = ids[first] != ids
    return ids[other], ids[first][other]


def _similar_sketches(threshold: float) -> Callable:
    """Of each block of a bucket: who is connected by estimates that may belong to the threshold."""
    margin = SPREAD * np.sqrt(threshold * (1 - threshold) / REGISTERS)

    def linked(regs: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        chance = chance_matches(n)
        for i in range(len(n) - 1):
            equal = (regs[i + 1 :] == regs[i]).mean(1)
            c = np.minimum(chance[i], chance[i + 1 :])
            near = (equal - c) / (1 - c) >= threshold - margin
            small, large = np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
            hit = np.flatnonzero(near & (small >= threshold * large)) + i + 1
            if len(hit):
                yield np.full(len(hit), i), hit

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for group in _runs(batches, ["key", "part"]):
            ids = group.column("rep").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            first = _least(len(ids), linked(_matrix(group.column("regs"))[order], group.column("n").to_numpy()[order]))
            u, v = _edges(ids, first)
            us.append(u)
            vs.append(v)
            if len(us) > 4096:
                yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                us, vs = us[:1], vs[:1]
        yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections within a block, by a matrix of documents and the shingles that two or more have."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        total += m @ m.T  # counts below 2 ** 24 are exact
    return total.astype(np.int64)


def _confirmed(percent: int) -> Callable:
    """Of each block of a candidate group: who is connected by links that hold on the full shingle sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["key", "part"]):
            ids = group.column("rep").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, texts = ids[order], group.column("text")
            sets = [shingles(texts[int(i)].as_py() or "") for i in order]
            n = np.array([len(s) for s in sets])
            both = shared_counts(sets)
            links = np.nonzero(np.triu((100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0), 1))
            u, v = _edges(ids, _least(len(ids), [links]))
            if len(u):
                yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def in_blocks(rows: DataFrame, key: str, size: int, weight: str | None = None, most: int = 1) -> DataFrame:
    """Rows with (key, part), such that any two rows of a key meet in some part and none has over about 2 * size rows,
    nor rows of a `weight` of over about 2 * most together, but for single rows that weigh more.

    A key within these bounds is one part. A larger one is cut into blocks, dealt by `rep`, and each pair of
    blocks is a part of its own: all comparisons are made, by as many tasks as it takes.
    """
    load = F.greatest(F.count(F.lit(1)) / size, (F.sum(weight) if weight else F.lit(0)) / most)
    blocks = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), load.alias("_load")).where("_n > 1")
    blocks = stored(blocks.select(key, F.when(F.col("_load") > 2, F.least(F.ceil("_load"), F.col("_n"))).otherwise(1).alias("_k")))
    rows = rows.join(blocks, key)
    own = F.pmod(F.xxhash64("rep"), F.col("_k"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1), lambda o: F.least(own, o) * F.col("_k") + F.greatest(own, o))
    single = rows.where("_k = 1").withColumn("part", F.lit(0).cast("long"))
    many = rows.where("_k > 1").withColumn("part", F.explode(parts))
    return single.unionByName(many).drop("_k")


def near_duplicates(docs: DataFrame, percent: int = 85, row: str | None = None) -> DataFrame:
    """Every document with its component: (doc_id, n_shingles, component_id, kept), and the long column `row` if named.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct five-word shingles
    (A-Z lower-cased). Equal sets are one class and go on as one row. Classes that share a band of registers meet in
    a bucket; those whose estimate allows it form candidate groups; within a group full sets decide every pair. Large
    buckets and groups are compared block against block, so none is gathered in a task and no pair is left out; blocks
    are bounded by documents and, where sets are compared, by shingles. Bands follow `percent`; a threshold too low for
    any (below 8 percent) is an error.

    Rows are told apart by `row`, which has to be a written column of distinct numbers; without it the texts are written
    once under numbers of their own. So rows without a doc_id, and rows that share one, are linked like all others.
    component_id is the least doc_id of a component, NULL if none of its rows has one. Of each component exactly one row
    is kept: of least doc_id, and of least number among those that share it or have none.

    A NULL text is empty; documents without words have an empty set, are linked with nothing and kept. Very long texts
    are read in slices of bounded bytes. An empty table gives no rows; other columns are not read.
    """
    bands = bands_of(percent)
    extra = [row] if row else []
    if not row:
        row = ROW
        docs = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias(ROW)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(row).alias("row"))
    rows = stored(docs.mapInArrow(_sketches, "doc_id long, row long, h1 long, h2 long, n long, regs binary"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = stored(rows.where("n > 0").groupBy("h1", "h2").agg(
        F.min("row").alias("rep"), F.min(first).alias("head"), F.first("n").alias("n"), F.first("regs").alias("regs"),
    ))
    nodes = classes.select("rep", "n", "regs")
    keyed = nodes.select("rep", "regs").mapInArrow(_banded(*bands), "rep long, key long")
    met = in_blocks(keyed, "key", BLOCK).join(nodes, "rep")
    met = met.repartition("key", "part").sortWithinPartitions("key", "part")
    candidates = components(met.mapInArrow(_similar_sketches(percent / 100), "u long, v long").distinct())
    groups = candidates.select(F.col("component").alias("key"), F.col("node").alias("rep")).join(nodes.select("rep", "n"), "rep")
    texts = docs.select(F.col("row").alias("rep"), "text")
    met = in_blocks(groups, "key", BLOCK, "n", BLOCK_SHINGLES).drop("n").join(texts, "rep")
    met = met.repartition("key", "part").sortWithinPartitions("key", "part")
    links = components(met.mapInArrow(_confirmed(percent), "u long, v long").distinct())
    labels = classes.select("h1", "h2", "rep", "head").join(links.withColumnRenamed("node", "rep"), "rep", "left")
    labels = labels.withColumn("component", F.coalesce("component", "rep"))
    heads = labels.groupBy("component").agg(F.min("head").alias("least"))
    labels = labels.select("h1", "h2", "component").join(heads, "component").select("h1", "h2", "least")
    kept, of = (F.col("row") == F.col("least.row")).alias("kept"), F.col("least.doc_id").alias("component_id")
    some = rows.where("n > 0").drop("regs").join(labels, ["h1", "h2"]).select("doc_id", "row", "n", of, kept)
    none = rows.where("n = 0").select("doc_id", "row", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept", *[F.col("row").alias(r) for r in extra])


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents that `near_duplicates` keeps, one of each component whatever ids they have, with their own columns
    only; documents without words all stay. Its docstring states what becomes of NULLs, ties and long texts."""
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()))
    gone = near_duplicates(rows, percent, ROW).where("NOT kept").select(ROW)
    return rows.join(gone, ROW, "left_anti").drop(ROW)
