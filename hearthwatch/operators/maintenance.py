"""Keyed-table upkeep as plain DataFrame expressions; the caller overwrites or appends the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import back, instant


def changed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are new or whose modification time differs from the ledger's."""
    current = files.select("source_file", "modified_at").distinct()
    return current.join(ledger.select("source_file", "modified_at"), ["source_file", "modified_at"], "left_anti")


def replace_by_file(events: DataFrame, incoming: DataFrame, changed: DataFrame) -> DataFrame:
    """Events after re-reading the changed files: their old rows go, their new rows come in."""
    names = changed.select("source_file").distinct()
    kept = events.join(names, "source_file", "left_anti")
    fresh = incoming.join(names, "source_file", "left_semi")
    return kept.unionByName(fresh.select(*kept.columns))


def current_rows(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of the append-only event table that are in force.

    Each ingest appends under its own `batch`; the ledger names the batch that last read a file, so rows an
    older batch read from that file are superseded without rewriting anything.
    """
    return events.join(ledger.select("source_file", "batch"), ["source_file", "batch"], "left_semi")


def upsert(table: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Insert or replace: incoming rows win. `incoming` holds each key once."""
    return incoming.unionByName(table.join(incoming.select(*keys), list(keys), "left_anti").select(*incoming.columns))


def insert_missing(table: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Insert or ignore: existing rows win. `incoming` holds each key once."""
    return table.unionByName(incoming.join(table.select(*keys), list(keys), "left_anti").select(*table.columns))


def last_by_key(rows: DataFrame, order: Column, *keys: str) -> DataFrame:
    """The last row per key by `order`, folded map-side."""
    return (
        rows.withColumn("_order", order).groupBy(*keys)
        .agg(F.max(F.struct("_order", *[c for c in rows.columns if c not in keys])).alias("_last"))
        .select(*keys, "_last.*").drop("_order").select(*rows.columns)
    )


def delete_keys(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return table.join(gone.select(*keys), list(keys), "left_anti")


def unexpired(table: DataFrame, as_of, hours: int, time: str = "timestamp") -> DataFrame:
    """Rows inside the retention period. Every stored row has a time, and the plain comparison reaches the scan."""
    return table.filter(F.col(time) >= back(as_of, f"{hours} hours"))


def register_devices(known: DataFrame, devices: DataFrame, as_of) -> DataFrame:
    """Known-device set after registering the inventory; first detection times are kept."""
    fresh = devices.select("ip", instant(as_of).alias("first_detected")).distinct()
    return insert_missing(known, fresh, "ip")


def _source_id(results: Column) -> Column:
    return F.get_json_object(results, "$.sqlite_id").try_cast("bigint")


def unsynced_scans(queue: DataFrame, scans: DataFrame) -> DataFrame:
    """Queued scan rows above the highest id already synced, with that id written into their document.

    A document that is not a JSON object is wrapped as `{"raw": …}`. Scheduled scans carry no queue id.
    """
    mark = (
        scans.filter(F.col("scan_type") != "scheduled_service")
        .agg(F.coalesce(F.max(_source_id(F.col("results"))), F.lit(0)).alias("mark"))
    )
    return queue.filter(F.col("id") > mark.scalar()).select(
        "id", "scanned_at", "target", "scan_type", _tagged(F.col("results"), F.col("id")).alias("results")
    )


def _tagged(results: Column, source_id: Column) -> Column:
    body = F.trim(results)
    is_object = F.try_parse_json(body).isNotNull() & body.startswith("{")
    empty = body.rlike(r"^\{\s*\}$")
    tag = F.concat(F.lit('"sqlite_id":'), source_id.cast("string"), F.lit("}"))
    # a document that has the key already is rebuilt without it, so that the new value is the only one
    others = F.map_filter(F.from_json(body, "map<string, variant>"), lambda k, _: k != "sqlite_id")
    rebuilt = F.regexp_replace(F.to_json(others), r"\}\s*$", "")
    rebuilt = F.concat(rebuilt, F.when(F.size(others) > 0, F.lit(",")).otherwise(F.lit("")), tag)
    opened = F.regexp_replace(body, r"\}\s*$", "")
    return (
        F.when(is_object & body.contains('"sqlite_id"'), rebuilt)
        .when(is_object & empty, F.concat(F.lit("{"), tag))
        .when(is_object, F.concat(opened, F.lit(","), tag))
        .otherwise(F.concat(F.regexp_replace(F.to_json(F.struct(results.alias("raw")), {"ignoreNullFields": "false"}),
                                             r"\}$", ","), tag))
    )


def unprocessed(anomalies: DataFrame, ledger: DataFrame) -> DataFrame:
    """Anomalies whose (id, detection time) is not in the ledger yet."""
    done = ledger.select(F.col("anomaly_id").alias("id"), "detected_at")
    return anomalies.join(done, ["id", "detected_at"], "left_anti")


def mark_processed(ledger: DataFrame, handled: DataFrame, as_of) -> DataFrame:
    """Ledger after a delivery round. Failed deliveries are recorded too, so each anomaly is tried once."""
    rows = handled.select(
        F.col("id").alias("anomaly_id"), "detected_at", instant(as_of).alias("processed_at"), "delivered"
    )
    return upsert(ledger, rows, "anomaly_id", "detected_at")
