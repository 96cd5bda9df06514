"""Helpers shared by the training-data operators: stored intermediates, byte-bounded slices, vectorised hashing."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthwatch.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: a word is a run of anything but these six white-space characters
SLICE_BYTES = 4 << 20
ROW = "__row_of_input"  # number of an input row where rows must be told apart; never in a result


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z only; `lower` would also fold other scripts."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_STORED: dict[str, object] = {}  # path of each stored table, and a weak reference of the JVM to its list of files


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_unreachable(spark: SparkSession) -> None:
    """Delete the stored tables that no frame can read any more.

    Every plan that reads a table holds its list of files. Once the JVM has collected that list, no frame, nor any made
    from it, is left that could read the table; as long as one is in use, the table stays.
    """
    gc.collect()
    spark._jvm.System.gc()
    for path, files in list(_STORED.items()):
        if files.get() is None:
            _STORED.pop(path, None)
            _delete(spark, path)


def stored(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, cut from its lineage, safe from lost executors.

    The returned frame is lazy and may be read at any time, so the files go when the driver's JVM ends, or with
    `drop_unreachable` once nothing can read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[path] = spark._jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation().location())
    return out


def byte_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together stay below `limit` bytes (a longer text comes alone), so that memory does not
    depend on how long the texts of an Arrow batch happen to be."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i below n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from one running polynomial: O(1) a span whatever its length."""
    up, down = _powers(base, len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=running[1:])
    return mixed((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes (the six separators are single bytes)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACES[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)
