"""Reading sensor logs: staged NDJSON files, raw sensor files, and the hourly sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import epoch_seconds, event_time, json_text

LINES = "value STRING, source_file STRING, modified_at TIMESTAMP"


def list_files(spark: SparkSession, path: str, pattern: str = "*.ndjson") -> DataFrame:
    """Files below `path` with their modification times; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )
    return files.select(F.col("path").alias("source_file"), F.col("modificationTime").alias("modified_at"))


def read_lines(spark: SparkSession, path: str | list[str], pattern: str = "*.ndjson", since=None) -> DataFrame:
    """Text lines below `path` with the file each came from and that file's modification time.

    `since` skips older files while the scan is planned.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    if since is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time") >= F.lit(since))
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def stream_lines(spark: SparkSession, path: str, pattern: str = "*.ndjson", max_files: int = 1000) -> DataFrame:
    """The same lines as a stream. A file is read once, when it appears: point it at closed hourly files."""
    lines = (
        spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files).text(path)
    )
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def _below(path: Column, root: str) -> Column:
    """Path below `root`, whatever scheme prefix the file system put in front."""
    tail = F.substring_index(path, root.split("://")[-1].rstrip("/") + "/", -1)
    return F.split(tail, "/")


def staged_events(lines: DataFrame, root: str, ingested_at) -> DataFrame:
    """Staged NDJSON lines to `events` rows.

    The first two directory levels name the tool and the log; a line that is not JSON is dropped.
    """
    parts = _below(F.col("source_file"), root)
    return (
        lines.filter(F.try_parse_json("value").isNotNull())
        .select(
            event_time(json_text(F.col("value"), "timestamp"), ingested_at).alias("timestamp"),
            F.coalesce(F.get(parts, F.lit(0)), F.lit("unknown")).alias("source_tool"),
            F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")).alias("log_type"),
            "source_file",
            F.col("value").alias("raw"),
        )
    )


def read_events(spark: SparkSession, root: str, ingested_at) -> DataFrame:
    return staged_events(read_lines(spark, root), root, ingested_at)


def keep_sensor_files(lines: DataFrame) -> DataFrame:
    """Keep the files the shipper follows: the EVE log and the Zeek logs, bar its own two bookkeeping logs."""
    path = F.col("source_file")
    eve = path.rlike(r"/suricata[^/]*/eve\.json$")
    zeek = path.rlike(r"/zeek[^/]*/[^/]*\.log$") & ~path.rlike(r"/zeek[^/]*/(packet_filter|reporter)[^/]*\.log$")
    return lines.filter(eve | zeek)


def normalised_events(lines: DataFrame, ingested_at) -> DataFrame:
    """Raw sensor lines to `events` rows: tool and log come from the file, Zeek epochs become timestamps."""
    path, raw = F.col("source_file"), F.col("value")
    is_eve = path.rlike(r"/suricata[^/]*/eve\.json$")
    zeek_log = F.regexp_replace(F.regexp_replace(path, r"^.*/zeek[^/]*/", ""), r"\..*$", "")
    zeek_time = F.coalesce(epoch_seconds(json_text(raw, "ts")), json_text(raw, "timestamp").try_cast("timestamp"))
    return (
        keep_sensor_files(lines)
        .filter(F.try_parse_json("value").isNotNull())
        .select(
            F.when(is_eve, event_time(json_text(raw, "timestamp"), ingested_at))
            .otherwise(F.coalesce(zeek_time, ingested_at)).alias("timestamp"),
            F.when(is_eve, "suricata").otherwise("zeek").alias("source_tool"),
            F.when(is_eve, "eve").otherwise(zeek_log).alias("log_type"),
            "source_file",
            raw.alias("raw"),
        )
    )


def with_event_hour(events: DataFrame) -> DataFrame:
    """Partition column of the hourly layout."""
    return events.withColumn("event_hour", F.date_format("timestamp", "yyyy-MM-dd-HH"))


def write_hourly(events: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Hourly layout `<tool>/<log>/<hour>`.

    The rebalance hint brings an hour's rows together so files stay few, and lets adaptive execution split
    an hour that is too big for one writer.
    """
    keys = ("source_tool", "log_type", "event_hour")
    with_event_hour(events).hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).format(fmt).save(path)


def stream_hourly(events: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", files: int = 4):
    """The hourly layout as a stream. A trigger writes an hour of a log to `files` files at most: its rows are brought
    together by as many keys, so that neither small files pile up nor one task gets a whole busy hour."""
    keys = ("source_tool", "log_type", "event_hour")
    spread = F.pmod(F.xxhash64("raw"), F.lit(files))
    return (
        with_event_hour(events).repartition(*keys, spread).writeStream.partitionBy(*keys)
        .format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    )
