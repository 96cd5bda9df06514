"""Stored tables of a running service: events, their typed tables and partial summaries, by day and batch.

A batch is what one ingest has read. It is parsed once and summed up once when it comes in; afterwards a cycle reads typed
columns of the days that it asks for, and folds partial summaries instead of events. Batches are only ever added: the
ledger names the batch that last read each file, and rows that an older batch read from that file are out of force.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.timing import DAY, back
from ..operators import inventory, silver
from ..operators.maintenance import current_rows, unexpired
from ..sources.tables import FLOW_ID

HOUR = "hour"
# partial summaries: typed table, builder
PARTS = {
    "sources": ("conn", inventory.source_profile),
    "leases": ("dhcp", inventory.lease_profile),
    "externals": ("conn", inventory.external_profile),
}
TABLES = ("events", *silver.BUILDERS, *PARTS)


def _together(write: Callable[[str], DataFrame], names: Iterable[str]) -> list[DataFrame]:
    """Independent small writes side by side: each is a Spark job of its own."""
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(write, names))


class EventStore:
    """Tables `<root>/<table>/event_date=…/batch=…` of all batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        empty = spark.createDataFrame([], schemas.EVENTS)
        self._schemas = {"events": silver.with_payload(empty).schema}
        for name, build in silver.BUILDERS.items():
            self._schemas[name] = build(empty, "source_file").schema
        for name in PARTS:
            self._schemas[name] = self._parts(name, spark.createDataFrame([], self._schemas[PARTS[name][0]])).schema

    # --- files ---

    def _sub_folders(self, path: str) -> list:
        at = self._hadoop.Path(path)
        self._files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath() for f in self._files.listStatus(at) if f.isDirectory()] if self._files.exists(at) else []

    def _partitions(self, table: str) -> list[tuple[str, int, object]]:
        """(day, batch, folder) of a table; a listing for each day kept, and none of files."""
        found = []
        for day in self._sub_folders(f"{self.root}/{table}"):
            if day.getName().startswith(f"{DAY}="):
                found += [(day.getName().split("=")[1], int(b.getName().split("=")[1]), b) for b in self._sub_folders(day.toString()) if "=" in b.getName()]
        return found

    def drop_batch(self, batch: int) -> None:
        """Take away what an earlier try of a batch has left."""
        for table in TABLES:
            for _, b, folder in self._partitions(table):
                if b == batch:
                    self._files.delete(folder, True)

    def keep_batches(self, batches: set[int]) -> None:
        """Delete the batches that no ledger names any more."""
        for table in TABLES:
            for _, batch, folder in self._partitions(table):
                if batch not in batches:
                    self._files.delete(folder, True)

    def drop_days_before(self, day: str) -> None:
        """Delete whole days."""
        for table in TABLES:
            for folder in self._sub_folders(f"{self.root}/{table}"):
                if folder.getName().startswith(f"{DAY}=") and folder.getName().split("=")[1] < day:
                    self._files.delete(folder, True)

    def days(self, table: str = "events") -> set[str]:
        return {day for day, *_ in self._partitions(table)}

    # --- writing ---

    def _write(self, table: str, batch: int, rows: DataFrame, time: str = "timestamp") -> DataFrame:
        """Add a batch's rows to a table; the rows as stored."""
        dated = rows.withColumn(DAY, F.to_date(time)).withColumn("batch", F.lit(batch))
        placed = dated.hint("rebalance", DAY).sortWithinPartitions(DAY, time)
        writer = placed.write.mode("append").partitionBy(DAY, "batch")
        if "community_id" in rows.columns:
            writer = writer.options(**FLOW_ID)
        writer.parquet(f"{self.root}/{table}")
        return self.read(table).filter(F.col("batch") == batch)

    def _parts(self, name: str, rows: DataFrame) -> DataFrame:
        return PARTS[name][1](rows, F.col("source_file"), F.date_trunc("hour", "timestamp").alias(HOUR))

    def write_batch(self, batch: int, events: DataFrame) -> None:
        """Store new events: parsed once, cut into the typed tables, which are then summed up by file and hour."""
        self.drop_batch(batch)
        stored = self._write("events", batch, silver.with_payload(events))
        typed = dict(zip(silver.BUILDERS, _together(
            lambda name: self._write(name, batch, silver.BUILDERS[name](stored, "source_file")), silver.BUILDERS)))
        _together(lambda name: self._write(name, batch, self._parts(name, typed[PARTS[name][0]]), HOUR), PARTS)

    def move_files(self, batch: int, ledger: DataFrame, as_of, hours: int) -> None:
        """Copy the rows in force and within retention of all files of `ledger` into one new batch, so that many small
        batches become one, and rows that are out of force or expired are left behind."""
        self.drop_batch(batch)
        def move(table: str) -> DataFrame:
            return self._write(table, batch, unexpired(current_rows(self.read(table), ledger).drop(DAY, "batch"), as_of, hours))

        moved = dict(zip(TABLES, _together(move, ("events", *silver.BUILDERS))))
        _together(lambda name: self._write(name, batch, self._parts(name, moved[PARTS[name][0]]), HOUR), PARTS)

    # --- reading ---

    def read(self, table: str) -> DataFrame:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in self._schemas[table].fields]
        ddl = ", ".join([*fields, f"{DAY} DATE", "batch INT"])
        if not self._sub_folders(f"{self.root}/{table}"):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{table}")

    def current(self, table: str, ledger: DataFrame, as_of, hours: int) -> DataFrame:
        """Rows of a table that are in force and within retention, with their day."""
        rows = self.read(table).filter(F.col(DAY) >= F.to_date(back(as_of, f"{hours} hours")))
        return unexpired(current_rows(rows, ledger), as_of, hours).drop("batch", "source_file")

    def events(self, ledger: DataFrame, as_of, hours: int) -> DataFrame:
        rows = self.read("events").filter(F.col(DAY) >= F.to_date(back(as_of, f"{hours} hours")))
        return unexpired(current_rows(rows, ledger), as_of, hours)

    def sensor_tables(self, ledger: DataFrame, as_of, hours: int, **summaries) -> silver.SensorTables:
        def reader(name):
            return lambda: self.current(name, ledger, as_of, hours)

        return silver.SensorTables(**{name: reader(name) for name in silver.BUILDERS}, **summaries)

    def profile(self, name: str, ledger: DataFrame, as_of, hours: int) -> DataFrame:
        """A partial summary of all rows in force and within retention, to be folded.

        Stored parts stand for the hours that are wholly within retention. Of the hour that retention cuts through, the
        typed rows are summed up again; they are of one day and sorted by time.
        """
        cut = back(as_of, f"{hours} hours")
        whole = current_rows(self.read(name).filter(F.col(DAY) >= F.to_date(cut)), ledger).filter(F.col(HOUR) >= cut)
        table, _ = PARTS[name]
        first = self.current(table, ledger, as_of, hours).filter((F.col(DAY) == F.to_date(cut)) & (F.col("timestamp") < _hour_after(cut)))
        boundary = self._parts(name, first.withColumn("source_file", F.lit(None).cast("string")))
        return whole.drop(DAY, "batch").unionByName(boundary)


def _hour_after(cut):
    """The first whole hour from `cut` on."""
    start = F.date_trunc("hour", cut)
    return F.when(start == cut, cut).otherwise(start + F.expr("INTERVAL 1 HOUR"))
