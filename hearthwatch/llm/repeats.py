"""Removal of repeated byte strings by minimizer fingerprints, in place of bucket-pointer refinement of a suffix array.

Positions are sampled where a q-gram is the least of its surroundings, so equal strings have their samples at equal
places. A sample's bucket is named by a hash of the string that every window of it contains; names of 2d bytes are
hashed from two names of d bytes. Buckets are split by a digest of the bytes of a sample's windows. A bucket with one
member leaves; what is left is compared window by window. Suffixes are not ordered. Polynomial hashes, whose equal values
can be made at will, only propose: strings are taken for equal by BLAKE2 digests of their bytes.

No stage hands rows from one Python function to another: each would hold a worker of its own in every running task, and
Spark keeps the workers. Joins between two such functions are therefore never broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthwatch.llm.base import byte_slices, mixed, span_hashes, stored

LENGTH = 200  # bytes of a repeated string at least
GRAM = 16  # bytes of the first names
HOT = 2048  # classes of a bucket that are compared in one task; windows of larger ones are dealt out by their names
BITS = 1 << 26  # bits of the maps that keep most unrepeated keys from being shuffled (8 MB); wrong hits do no harm
SLICE = 1 << 18

_U = np.uint64
_HIGH = _U(0xFFFFFFFF00000000)


def gram_names(data: np.ndarray) -> np.ndarray:
    """Names of the GRAM bytes from each position on: doubled from 1 to 8 bytes exactly, then by pairs of names."""
    x = data.astype(_U)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << _U(8 * width))
    return mixed(x[:-8] * _U(0x9DDFEA08EB382D69) + (x[8:] ^ (x[8:] >> _U(29))) * _U(0xC2B2AE3D27D4EB4F))


def deeper(names: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Names of `depth` bytes (a power of two times GRAM) at some positions, each a pair of names at later offsets."""
    if depth == GRAM:
        return names[at]
    return mixed(deeper(names, at, depth // 2) * _U(0x9DDFEA08EB382D69) + deeper(names, at + depth // 2, depth // 2))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each `width` successive ones."""
    low, have = keys, 1
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    return np.minimum(low[: len(low) - (width - have)], low[width - have :]) if have < width else low


def samples(data: np.ndarray, ends: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, sample, bucket name) of runs of windows that have the same sample.

    A window is `length` bytes inside one document; its sample is the leftmost least GRAM in its first part, and so
    depends on the window alone. The bucket name covers the bytes that all windows with this sample contain.
    """
    inner = GRAM << ((length // 3 // GRAM).bit_length() - 1)  # 64 of 200 bytes
    width = length - inner + 1
    names = gram_names(data)
    order = (names & _HIGH) | np.arange(len(names), dtype=_U)
    low = _least(order, width)
    p = np.flatnonzero(np.arange(length, len(low) + length) <= np.repeat(ends, lengths)[: len(low)])
    if not len(p):
        return (np.empty(0, int),) * 3 + (np.empty(0, _U),)
    at = (low[p] & ~_HIGH).astype(np.int64)
    change = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = p[np.r_[0, change]], p[np.r_[change - 1, len(p) - 1]]
    at = at[np.r_[0, change]]
    return first, last, at, deeper(names, at, inner)


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a BLAKE2 digest of each data[start:end]."""
    view, out = memoryview(data), [np.empty((0, 2), _U)]
    for i in range(0, len(starts), 1 << 14):
        spans = zip(starts[i : i + (1 << 14)].tolist(), ends[i : i + (1 << 14)].tolist())
        out.append(np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in spans]), _U).reshape(-1, 2))
    return np.concatenate(out)


def _sampled(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray, np.ndarray, tuple]]:
    """Of each slice of texts: the slice, its bytes, each sample's row in it, each row's start, and the samples."""
    for batch in byte_slices(batches, limit=SLICE):
        texts = batch.column("text").to_pylist()
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        if len(data) < length:
            continue
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths)
        found = samples(data, ends, lengths, length)
        yield batch, joined, np.searchsorted(ends, found[0], "right"), ends - lengths, found


def _bit(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) % _U(BITS)).astype(np.int64)


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _bit(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bucket_names(length: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, found in _sampled(batches, length):
            yield pa.record_batch([pa.array(found[3].view(np.int64))], ["k"])

    return run


def _kept_samples(length: int, bits) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, rows, starts, found in _sampled(batches, length):
            some = np.flatnonzero(_marked(bits.value, found[3].view(np.int64)))
            first, last, at, bucket = (x[some] for x in found)
            # covers all bytes of this run's windows and their place around the sample
            shape = ((at - first) << 16 | (last - first)).astype(_U)
            refined = mixed(digests(data, first, last + length)[:, 0] * _U(0x9DDFEA08EB382D69) + shape)
            start = starts[rows[some]]
            columns = [batch.column(c).take(pa.array(rows[some])) for c in ("doc", "sha")]
            columns += [pa.array((x - start).astype(np.int32)) for x in (first, last, at)]
            columns += [pa.array(x.view(np.int64)) for x in (bucket, refined)]
            yield pa.record_batch(columns, ["doc", "sha", "first", "last", "at", "k", "o"])

    return run


def _map_of(keys: DataFrame) -> np.ndarray:
    """A bit map of fixed size for the long column `key`, built by aggregation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit(batch.column(0).to_numpy()))
            word, inverse = np.unique(at >> 6, return_inverse=True)
            value = np.zeros(len(word), _U)
            np.bitwise_or.at(value, inverse, _U(1) << (at & 63).astype(_U))
            yield pa.record_batch([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    words = keys.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    out = np.zeros(BITS // 64, _U)
    for batch in [words.toArrow()]:
        out[batch.column("word").to_numpy()] = batch.column("value").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _outer_bytes(length: int) -> Callable:
    """The bytes around the samples of each document that stand for a class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            doc, sha, k, n, first, last, at, outer = [], [], [], [], [], [], [], []
            for d, c, data, probes in zip(*[batch.column(x).to_pylist() for x in ("doc", "sha", "text", "probes")]):
                for p in probes:
                    doc.append(d)
                    sha.append(c)
                    k.append(p["k"])
                    n.append(p["n"])
                    first.append(p["first"])
                    last.append(p["last"])
                    at.append(p["at"])
                    outer.append(data[p["first"] : p["last"] + length])
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(sha, pa.int64()), pa.array(k, pa.int64()), pa.array(n, pa.int64())]
                + [pa.array(x, pa.int32()) for x in (first, last, at)] + [pa.array(outer, pa.binary())],
                ["doc", "sha", "k", "n", "first", "last", "at", "outer"],
            )

    return run


def _windows(batch) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the rows, and of all their windows the start in these bytes, the row and the place in its document."""
    first, last = (batch.column(c).to_numpy() for c in ("first", "last"))
    outer = batch.column("outer").to_pylist()
    starts = np.cumsum([0, *map(len, outer)])[:-1]
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return b"".join(outer), starts[row] + step, row, first[row] + step


def _spans(batch, row: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows to spans: runs of successive ones of a row become one."""
    change = np.flatnonzero((row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)) + 1 if len(row) else np.empty(0, int)
    a = np.r_[0, change] if len(row) else change
    b = np.r_[change - 1, len(row) - 1] if len(row) else change
    rows = pa.array(row[a])
    return pa.record_batch(
        [pc.take(batch.column("doc").combine_chunks(), rows), pc.take(batch.column("sha").combine_chunks(), rows),
         pa.array(place[a].astype(np.int32)), pa.array((place[b] + length).astype(np.int32))],
        ["doc", "sha", "start", "end"],
    )


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of about `rows` rows, from batches sorted by `key`, that never part the rows of a key."""
    kept: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        cut = 0
        if total >= rows or total + len(values) > rows:
            last = kept[-1].column(key)[-1].as_py() if kept else None
            starts = np.flatnonzero(values[1:] != values[:-1]) + 1
            if last is not None and values[0] != last:
                starts = np.r_[0, starts]
            for s in starts.tolist():
                if total + s - cut >= rows:
                    kept.append(batch.slice(cut, s - cut))
                    yield pa.Table.from_batches([b for b in kept if b.num_rows] or kept)
                    kept, total, cut = [], 0, s
        kept.append(batch.slice(cut))
        total += batch.num_rows - cut
    if kept:
        yield pa.Table.from_batches(kept)


def _compared(length: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "k"):
            data, begin, row, place = _windows(group)
            n = group.column("n").to_numpy()[row]
            _, inverse = np.unique(span_hashes(np.frombuffer(data, np.uint8), begin, begin + length), return_inverse=True)
            one = n == 1  # classes with more members are marked as a whole
            some = np.flatnonzero((np.bincount(inverse, weights=n)[inverse] >= 2) & (np.bincount(inverse, weights=one)[inverse] > 0))
            found = digests(data, begin[some], begin[some] + length)
            order = np.lexsort(found.T)
            same = np.empty(len(order), np.int64)
            same[order] = np.cumsum(np.r_[False, (found[order[1:]] != found[order[:-1]]).any(axis=1)][: len(order)])
            some = some[(np.bincount(same, weights=n[some])[same] >= 2) & one[some]]
            yield _spans(group, row[some], place[some], length)

    return run


def _dealt(length: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "outer", SLICE):
            data, begin, row, place = _windows(batch)
            name = digests(data, begin, begin + length).view(np.int64)
            rows = pa.array(row)
            yield pa.record_batch(
                [*(batch.column(c).take(rows) for c in ("doc", "sha", "n")), pa.array(place.astype(np.int32)), *map(pa.array, name.T)],
                ["doc", "sha", "n", "place", "name", "name2"],
            )

    return run


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many were covered, and in how many runs."""
    left, removed, runs, at = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            runs += 1
            left.append(data[at:a])
            removed += b - a
            at = end = b
        elif b > end:
            removed += b - end
            at = end = b
    left.append(data[at:])
    return b"".join(left), removed, runs


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterable[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches):
        rows = []
        spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
        for data, s in zip(batch.column("text").to_pylist(), spans):
            left, removed, runs = without_spans(data, [(x["start"], x["end"]) for x in s or []])
            rows.append((len(data), removed, runs, hashlib.sha256(left).hexdigest(), left))
        columns = [batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())]
        if texts:
            columns.append(pa.array([r[4] for r in rows], pa.binary()))
        yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, sha, start, end): byte spans of `length` bytes or more, over which every window starts elsewhere too."""
    spark = docs.sparkSession
    names = docs.select("text").mapInArrow(_bucket_names(length), "k long").groupBy("k").count().where("count > 1")
    bits = spark.sparkContext.broadcast(_map_of(names.select("k")))
    kept = stored(docs.mapInArrow(_kept_samples(length, bits), "doc long, sha long, first int, last int, at int, k long, o long"))
    one = [F.first(c).alias(c) for c in ("doc", "sha", "first", "last", "at")]  # of one row, whichever comes first
    classes = stored(kept.groupBy("k", "o").agg(F.count(F.lit(1)).alias("n"), *one))
    whole = kept.join(classes.where("n > 1").select("k", "o"), ["k", "o"], "left_semi").select("doc", "sha", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    shared = stored(classes.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    probes = classes.join(shared, "k").groupBy("doc", "sha").agg(F.collect_list(F.struct("k", "n", "first", "last", "at")).alias("probes"))
    probes = stored(probes)
    bits = spark.sparkContext.broadcast(_map_of(probes.select("doc")))
    outer = _only(docs, bits).join(probes.hint("merge"), ["doc", "sha"]).select("doc", "sha", "text", "probes").mapInArrow(
        _outer_bytes(length), "doc long, sha long, k long, n long, first int, last int, at int, outer binary")
    outer = stored(outer)
    hot = shared.where(F.col("m") > HOT)
    # by another expression than the join: an equal partitioning would be left out, and the join may then part a bucket
    cool = outer.join(hot, "k", "left_anti").repartition(F.xxhash64("k")).sortWithinPartitions("k")
    spans = whole.unionByName(cool.mapInArrow(_compared(length), "doc long, sha long, start int, end int"))
    if not hot.isEmpty():
        dealt = stored(outer.join(hot, "k", "left_semi").mapInArrow(_dealt(length), "doc long, sha long, n long, place int, name long, name2 long"))
        twice = stored(dealt.groupBy("name", "name2").agg(F.sum("n").alias("n")).where("n > 1").select("name", "name2"))
        spans = spans.unionByName(dealt.where("n = 1").join(twice, ["name", "name2"]).select("doc", "sha", F.col("place").alias("start"), (F.col("place") + length).alias("end")))
    return spans


def _inside(batches: Iterable[pa.RecordBatch], bits, inside: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(_marked(bits.value, batch.column("doc").to_numpy()) == inside))


def _only(docs: DataFrame, bits) -> DataFrame:
    return docs.mapInArrow(lambda b: _inside(b, bits, True), docs.schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """Every document less all bytes that lie in a string of `length` bytes which starts anywhere else too, in the
    same document or another: (doc_id, n_bytes, n_removed, n_spans, kept_sha256), with `texts` the bytes kept as well.

    Strings are judged on the input and never reach over two documents; a NULL or shorter text loses nothing. Repeated
    rows are documents of their own, and so lose what they share. Rows with equal id and text have equal results,
    which is why a document is known by its id and 64 bits that follow from the SHA-256 of its text (a NULL id by a hash
    of the text). An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("doc"), F.xxhash64(F.sha2(text, 256)).alias("sha"),
    )
    spans = stored(repeated_spans(docs.select("text", "doc", "sha"), length))
    spans = stored(spans.groupBy("doc", "sha").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    bits = docs.sparkSession.sparkContext.broadcast(_map_of(spans.select("doc")))
    schema = _OUT + (", kept binary" if texts else "")
    clean = docs.drop("sha").mapInArrow(lambda b: _cut(_inside(b, bits, False), texts), schema)
    return clean.unionByName(_only(docs, bits).join(spans.hint("merge"), ["doc", "sha"], "left").mapInArrow(lambda b: _cut(b, texts), schema))
