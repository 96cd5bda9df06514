"""Exact dedup with a cuckoo-filter index: live digests are inserted and deleted, hits are verified against the stored
keys of their bucket, and a table that overflows is rebuilt at twice the size from those keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthwatch.llm.base import ROW, lower_ascii, stored

SLOTS = 4  # entries a bucket, as usual for cuckoo filters: up to 95 % full
MOST_KICKS = 128


class CuckooIndex:
    """Fingerprints in two possible buckets each; every entry has its whole key and payload beside it.

    The filter answers "not here" from fingerprints alone. A hit compares whole keys, so false positives cost a
    comparison and never a wrong answer. Removing a key frees its slot.
    """

    def __init__(self, buckets: int = 256) -> None:
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.keys: list[list[bytes]] = [[] for _ in range(buckets)]
        self.payloads: list[list[tuple]] = [[] for _ in range(buckets)]
        self.size = 0

    @staticmethod
    def _fingerprint(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _first(self, key: bytes) -> int:
        return int.from_bytes(key[:8], "little") & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, key: bytes) -> tuple[int, int] | None:
        mark, at = self._fingerprint(key), self._first(key)
        for bucket in (at, self._other(at, mark)):
            if mark in self.prints[bucket] and key in self.keys[bucket]:  # filter hit, then the stored keys
                return bucket, self.keys[bucket].index(key)
        return None

    def get(self, key: bytes) -> tuple | None:
        at = self.find(key)
        return at and self.payloads[at[0]][at[1]]

    def remove(self, key: bytes) -> tuple | None:
        if (at := self.find(key)) is None:
            return None
        bucket, slot = at
        del self.prints[bucket][slot], self.keys[bucket][slot]
        self.size -= 1
        return self.payloads[bucket].pop(slot)

    def insert(self, key: bytes, payload: tuple) -> None:
        """A key that isn't live yet."""
        mark = self._fingerprint(key)
        bucket = self._first(key)
        if len(self.prints[bucket]) >= SLOTS:
            bucket = self._other(bucket, mark)
        for kick in range(MOST_KICKS):
            if len(self.prints[bucket]) < SLOTS:
                self._put(bucket, mark, key, payload)
                self.size += 1
                return
            slot = kick % SLOTS
            out = self.prints[bucket].pop(slot), self.keys[bucket].pop(slot), self.payloads[bucket].pop(slot)
            self._put(bucket, mark, key, payload)
            mark, key, payload = out
            bucket = self._other(bucket, mark)
        self._grow((key, payload))

    def _put(self, bucket: int, mark: int, key: bytes, payload: tuple) -> None:
        self.prints[bucket].append(mark)
        self.keys[bucket].append(key)
        self.payloads[bucket].append(payload)

    def _grow(self, homeless: tuple[bytes, tuple]) -> None:
        entries = [*self.items(), homeless]
        self._clear(2 * (self.mask + 1))
        for key, payload in entries:
            self.insert(key, payload)

    def items(self) -> list[tuple[bytes, tuple]]:
        return [e for keys, payloads in zip(self.keys, self.payloads) for e in zip(keys, payloads)]


GROUPS = "digest binary, keep_id long, keep_row long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
LIVE_KEYS = 1 << 18  # a map-side index is emptied at this size: its groups go on in pieces and meet in the next step


def _live(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Fold rows of GROUPS by digest; at most `most` live keys are held where that is above 0."""
    index = CuckooIndex()

    def out() -> pa.RecordBatch:
        entries = index.items()
        columns = zip(*[(k, *p) for k, p in entries]) if entries else [[]] * 4
        return pa.record_batch([pa.array(list(c), t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)

    for batch in batches:
        for digest, keep, row, n in zip(*[c.to_pylist() for c in batch.columns]):
            live = index.get(digest)
            if live is None:
                index.insert(digest, (keep, row, n))
            else:  # the old live entry goes, and the larger of the two comes back with both counts
                index.remove(digest)
                best = max((live[0] is not None, live[0] or 0, live[1]), (keep is not None, keep or 0, row))
                index.insert(digest, (best[1] if best[0] else None, best[2], live[2] + n))
        if most and index.size >= most:
            yield out()
            index = CuckooIndex()
    yield out()


def digests(docs: DataFrame, row: Column) -> DataFrame:
    """(doc_id, digest, row): SHA-256 of the text with A-Z lower-cased; a NULL text counts as empty."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        row.alias("row"),
    )


def copy_groups(rows: DataFrame) -> DataFrame:
    """One row for each distinct digest: (digest, keep_id, keep_row, group_size).

    Each input task folds its own copies first, so that a text which makes up a third of all rows reaches the
    second step as one row a task; the second step deals digests out by bucket and folds the rest.
    """
    start = rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    folded = start.mapInArrow(lambda batches: _live(batches, LIVE_KEYS), GROUPS)
    return folded.repartition("digest").mapInArrow(lambda batches: _live(batches, 0), GROUPS)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Every document with the row of its group that stays: the largest doc_id among equal texts.

    Texts are equal when identical after lower-casing A-Z. NULL and empty texts form one group. NULL ids are below
    all others. Of repeated rows with the same id and text exactly one stays (`kept`). An empty table gives no rows;
    other columns are not read.
    """
    rows = stored(digests(docs, F.monotonically_increasing_id()))
    return rows.join(copy_groups(rows), "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns only; the rows are as in `exact_duplicates`."""
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()))
    marks = stored(digests(rows, F.col(ROW)))
    gone = marks.join(copy_groups(marks).select("digest", "keep_row"), "digest").where("row <> keep_row").select(F.col("row").alias(ROW))
    return rows.join(gone, ROW, "left_anti").drop(ROW)
