"""Running streams: ingest, queues with several readers, periodic detector ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.event_files import staged_events, stream_hourly, stream_lines
from ..sources.tail import tail_lines
from . import live

SENSOR_LOGS = "zeek*/conn*.log*,suricata*/eve.json*"  # fixed value: the logs whose lines name sources


def ingest(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Closed hourly files below `root` to the hourly event table; picks up what is there, then stops.

    The file source reads a file once. A file that is still growing is followed by `sources.tail.tail_lines`, or
    replaced by `operators.maintenance.replace_by_file`.
    """
    events = staged_events(stream_lines(spark, root), root, F.current_timestamp())
    return stream_hourly(events, target, checkpoint).trigger(availableNow=True).start()


def append_to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-mode stream to a Parquet table (exactly once by the sink's own log)."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def watch_addresses(spark: SparkSession, root: str, known: DataFrame, queue: str, checkpoint: str, files: str = SENSOR_LOGS,
                    every: str | None = None) -> StreamingQuery:
    """The live path: follow the growing sensor logs below `root` and append private addresses that are neither in
    `known` nor reported before to the queue table (ip, seen_at).

    With `every` (say "1 second") the query keeps running; without, it takes what is there and stops.
    """
    fresh = live.new_addresses(live.sightings(tail_lines(spark, root, files)), known)
    stream = (
        fresh.writeStream.format("parquet").outputMode("append").option("path", queue).option("checkpointLocation", checkpoint)
    )
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def read_queue(spark: SparkSession, path: str, consumer: str, checkpoints: str,
               handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """One consumer of a queue table. Each consumer name has its own checkpoint, so readers are independent."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return (
        rows.writeStream.foreachBatch(handle).option("checkpointLocation", f"{checkpoints}/{consumer}")
        .trigger(availableNow=True).start()
    )


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that may be replayed: a batch overwrites its own folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def tick_each_batch(detect: Callable[[SparkSession, object], DataFrame], path: str,
                    time: str = "timestamp") -> Callable[[DataFrame, int], None]:
    """foreachBatch handler running the detectors once per batch, with the batch's newest event as the clock."""

    def run(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max(time)).first()[0]  # one value
        if newest is not None:
            found = detect(batch.sparkSession, newest)
            found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run
