"""One full processing cycle over staged files: ingest, summaries, baselines, detectors.

Events and what is derived of single events are added by batch (`event_store`); the small tables live below one folder as
plain Parquet, one sub-folder per cycle. A cycle reads the previous cycle's tables and writes its own, so it can be repeated
after a failure and never overwrites what it reads. Raw text is parsed when it comes in, and never again: a cycle's cost
follows the new files, the look-backs of the detectors, and the partial summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Settings
from ..functions.timing import back, instant
from ..operators import baselines, detectors, enrich, inventory, maintenance, silver
from ..sources.event_files import list_files, read_lines, staged_events
from .event_store import EventStore

# tables of which a cycle writes its own version; the last one stays for a cycle that is run again
STORED = (
    "ledger", "changed", "fast", "known_fast", "drained", "devices", "external_ips", "external_clients", "totals", "found", "baselines",
    "known_devices", "anomalies",
)
EXTERNAL_TOTALS = "ip STRING, country STRING, total_conns BIGINT, total_bytes BIGINT, top_service STRING, top_dest_port INT"
EXTERNAL_CLIENTS = "ip STRING, client STRING, conns BIGINT, bytes BIGINT"
LEDGER = "source_file STRING, modified_at TIMESTAMP, batch INT"


class TableFolder:
    """Paths of the stored tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, name: str, cycle: int, schema: str) -> DataFrame:
        """A table as of a cycle; empty before the first one."""
        if cycle < 1:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/cycle={cycle}")

    def write(self, name: str, cycle: int, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}/cycle={cycle}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _sub_folders(self, name: str, key: str) -> tuple[object, dict[int, object]]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.listStatus(at) if files.exists(at) else []
        paths = [f.getPath() for f in found if f.getPath().getName().startswith(f"{key}=")]
        return files, {int(p.getName().split("=")[1]): p for p in paths}

    def keep_cycles(self, last: int, names: tuple[str, ...]) -> None:
        """Delete the tables of cycles before `last`, so that the folder doesn't grow with the number of cycles."""
        for name in names:
            files, paths = self._sub_folders(name, "cycle")
            for cycle, path in paths.items():
                if cycle < last:
                    files.delete(path, True)


def ingest(store: TableFolder, events: EventStore, staged: str, cycle: int, as_of, settings: Settings) -> DataFrame:
    """Store the new and changed files as a batch of their own and return the ledger of files in force.

    Files last written before the retention period hold expired events only: they are not read, and they leave the
    ledger. Days before the period are deleted whole, and so are batches that neither this ledger nor the one before
    names. Every `compact_every` cycles all files move into one batch, which leaves expired and replaced rows behind.
    """
    spark, hours = store.spark, settings.retention_hours
    cut = back(instant(as_of), f"{hours} hours")
    oldest_kept = F.col("modified_at") >= cut
    before = store.read("ledger", cycle - 1, LEDGER)
    ledger = before.filter(oldest_kept)
    listed = list_files(spark, staged).filter(oldest_kept)
    changed = store.write("changed", cycle, maintenance.changed_files(listed, ledger))
    oldest = changed.agg(F.min("modified_at")).first()[0]  # one value
    batch = 2 * cycle  # odd numbers are those of compaction
    if oldest is not None:
        lines = read_lines(spark, staged, since=oldest).join(changed.select("source_file"), "source_file", "left_semi")
        events.write_batch(batch, maintenance.unexpired(staged_events(lines, staged, instant(as_of)), as_of, hours))
    else:
        events.drop_batch(batch)
    ledger = maintenance.upsert(ledger, changed.withColumn("batch", F.lit(batch)), "source_file")
    if settings.compact_every and cycle % settings.compact_every == 0:
        stored = store.write("moved", cycle, ledger)
        events.move_files(batch + 1, stored, as_of, hours)
        ledger = stored.withColumn("batch", F.lit(batch + 1))
    ledger = store.write("ledger", cycle, ledger)
    # one number a cycle since the last compaction
    batches = {r["batch"] for r in ledger.select("batch").union(before.select("batch")).distinct().collect()}
    events.keep_batches(batches)
    events.drop_days_before(spark.range(1).select(F.to_date(cut).cast("string")).first()[0])
    return ledger


def run_cycle(spark: SparkSession, root: str, staged: str, cycle: int, as_of, vendors: DataFrame, ranges: DataFrame,
              settings: Settings = Settings(), queue: DataFrame | None = None) -> DataFrame:
    """Run cycle number `cycle` (1, 2, …) and return its new anomalies.

    `queue` holds rows of the live path (id, detected_at, ip, mac): those not drained yet are reported and their
    addresses registered, as are devices first seen in the last minutes, so that the summary does not report them again.
    """
    store, events = TableFolder(spark, root), EventStore(spark, root)
    last, hours = cycle - 1, settings.retention_hours
    ledger = ingest(store, events, staged, cycle, as_of, settings)
    def profile(name: str) -> DataFrame:
        return events.profile(name, ledger, as_of, hours)

    devices = store.write("devices", cycle, inventory.devices_of(profile("sources"), profile("leases"), vendors))
    external = profile("externals")
    located = enrich.with_country(inventory.external_totals(external), ranges)
    external_ips = store.write("external_ips", cycle, located.select(*[f.split()[0] for f in EXTERNAL_TOTALS.split(", ")]))
    clients = store.write("external_clients", cycle, inventory.external_clients(external))
    tables = events.sensor_tables(ledger, as_of, hours, devices=devices, external_ips=external_ips)
    totals = store.write("totals", cycle, baselines.source_totals(tables.conn, as_of, settings))

    known = store.read("known_devices", last, schemas.KNOWN_DEVICES)
    fast = detectors.first_sight(tables.conn, known, as_of, settings)
    taken = store.read("drained", last, "id BIGINT")
    if queue is not None:
        waiting = queue.join(known.select("ip"), "ip", "left_anti").dropDuplicates(["ip"])
        fast = fast.join(waiting.select(F.col("ip").alias("dedup_key")), "dedup_key", "left_anti")
        fast = detectors.stored_form(fast).unionByName(detectors.stored_form(detectors.drained(waiting, taken, as_of)))
        taken = taken.unionByName(queue.select("id")).distinct()
    else:
        fast = detectors.stored_form(fast)
    store.write("drained", cycle, taken)
    fast = store.write("fast", cycle, fast)
    known = store.write("known_fast", cycle, maintenance.register_devices(known, fast.select(F.col("dedup_key").alias("ip")), as_of))
    past = store.read("baselines", last, schemas.BASELINES)
    history = store.read("anomalies", last, schemas.ANOMALIES)
    found = detectors.detect_all(tables, known, past, history, as_of, settings, totals=totals, clients=clients)
    found = store.write("found", cycle, fast.unionByName(found))

    store.write("baselines", cycle, baselines.updated_baselines(past, baselines.stats_of(totals), devices, as_of, settings.ema_alpha))
    store.write("known_devices", cycle, maintenance.register_devices(known, devices, as_of))
    kept = maintenance.unexpired(history, as_of, hours, "detected_at")
    store.write("anomalies", cycle, kept.unionByName(found))
    store.keep_cycles(last, STORED + ("moved",))
    return found


def stored_tables(store: TableFolder, events: EventStore, cycle: int, as_of, settings: Settings = Settings()) -> silver.SensorTables:
    """The typed tables and summaries as of a cycle, for panels, reports and detectors.

    The summaries are read when they are asked for. External hosts come with their clients as a text, which is made for
    the rows that are shown.
    """
    ledger = store.read("ledger", cycle, LEDGER)

    def external_ips() -> DataFrame:
        totals = store.read("external_ips", cycle, EXTERNAL_TOTALS)
        return inventory.with_client_lists(totals, store.read("external_clients", cycle, EXTERNAL_CLIENTS))

    return events.sensor_tables(
        ledger, as_of, settings.retention_hours, devices=lambda: store.read("devices", cycle, schemas.DEVICES), external_ips=external_ips)
