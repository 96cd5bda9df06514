"""Keyed tables that are changed in place of a part: rows lie in hash buckets of their key, and a change rewrites the buckets
that it touches.

A change writes new copies of those buckets beside the old ones, then a numbered manifest that names the copy of every
bucket. The manifest is one file made in one step: readers see all of a change or nothing of it, and a change that
fails leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import delete_keys, insert_missing, upsert

BUCKET = "bucket"
KEPT = 2  # manifests whose buckets stay: the newest and the one before, which readers may still be at


class KeyedTable:
    """A table with one row for each key."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: tuple[str, ...], buckets: int = 64):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        known = self._manifest(self.version())
        self.buckets = known["buckets"] if known else buckets  # fixed when the first rows come in

    def _manifests(self) -> list[int]:
        at = self._hadoop.Path(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int:
        """Number of changes so far."""
        return max(self._manifests(), default=0)

    def _manifest(self, version: int) -> dict | None:
        if not version:
            return None
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version}.json").first()[0])

    def _rows(self, manifest: dict | None, touched: set[int] | None = None) -> DataFrame:
        copies = (manifest or {"copies": {}})["copies"]
        paths = [f"{self.root}/data/{copy}/{BUCKET}={b}" for b, copy in copies.items() if touched is None or int(b) in touched]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._manifest(self.version() if version is None else version))

    def _change(self, rows: DataFrame, merge) -> int:
        """Replace the buckets that `rows` touch by merge(their rows, rows); the version after."""
        version = self.version()
        manifest = self._manifest(version)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        copy = uuid.uuid4().hex
        # stored once, since it is read for its buckets and for its rows
        rows.withColumn(BUCKET, bucket).write.parquet(f"{self.root}/data/{copy}/incoming")
        incoming = self.spark.read.schema(rows.withColumn(BUCKET, bucket).schema).parquet(f"{self.root}/data/{copy}/incoming")
        touched = {r[BUCKET] for r in incoming.select(BUCKET).distinct().collect()}  # at most `buckets` numbers
        copies = dict(manifest["copies"]) if manifest else {}
        if touched:
            merged = merge(self._rows(manifest, touched), incoming.drop(BUCKET)).select(*self.schema.names).withColumn(BUCKET, bucket)
            merged.hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).parquet(f"{self.root}/data/{copy}")
            written = {s.getPath().getName() for s in self._files.listStatus(self._hadoop.Path(f"{self.root}/data/{copy}"))}
            for b in touched:
                copies.pop(str(b), None)
                if f"{BUCKET}={b}" in written:  # else the change left the bucket empty
                    copies[str(b)] = copy
        self._files.delete(self._hadoop.Path(f"{self.root}/data/{copy}/incoming"), True)
        self._put({"buckets": self.buckets, "copies": copies}, version + 1)
        self._drop_unnamed()
        return version + 1

    def _put(self, manifest: dict, version: int) -> None:
        """Fails if another writer has made this version; its change then stands, and this one is to be tried again."""
        out = self._files.create(self._hadoop.Path(f"{self.root}/manifests/{version}.json"), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def _drop_unnamed(self) -> None:
        """Delete the copies that only older manifests name."""
        versions = self._manifests()
        kept = {f"{c}/{BUCKET}={b}" for v in versions[-KEPT:] for b, c in self._manifest(v)["copies"].items()}
        for old in versions[:-KEPT]:
            for b, c in self._manifest(old)["copies"].items():
                if f"{c}/{BUCKET}={b}" not in kept:
                    self._files.delete(self._hadoop.Path(f"{self.root}/data/{c}/{BUCKET}={b}"), True)
            self._files.delete(self._hadoop.Path(f"{self.root}/manifests/{old}.json"), False)

    def upsert(self, rows: DataFrame) -> int:
        """Insert or replace. `rows` holds each key once."""
        return self._change(rows.select(*self.schema.names), lambda old, new: upsert(old, new, *self.keys))

    def insert_missing(self, rows: DataFrame) -> int:
        """Insert or ignore. `rows` holds each key once."""
        return self._change(rows.select(*self.schema.names), lambda old, new: insert_missing(old, new, *self.keys))

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows of these keys."""
        return self._change(keys.select(*self.keys), lambda old, gone: delete_keys(old, gone, *self.keys))
