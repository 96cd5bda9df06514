"""Alert throttling on an explicit key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import bucket, within


def cooling(anomalies: DataFrame, anomaly_type: str, minutes: int, as_of) -> DataFrame:
    """Keys of one anomaly type that are still cooling down at `as_of`."""
    return (
        anomalies.filter(F.col("anomaly_type") == anomaly_type)
        .filter(within(F.col("detected_at"), as_of, f"{minutes} minutes"))
        .select("dedup_key")
        .distinct()
    )


def throttled_by_key(candidates: DataFrame, anomalies: DataFrame, anomaly_type: str, minutes: int,
                     as_of) -> DataFrame:
    """Drop candidates whose `dedup_key` fired within the cooldown."""
    return candidates.join(cooling(anomalies, anomaly_type, minutes, as_of), "dedup_key", "left_anti")


def throttled_by_type(candidates: DataFrame, anomalies: DataFrame, anomaly_type: str, minutes: int,
                      as_of) -> DataFrame:
    """Drop all candidates when any anomaly of the type fired within the cooldown."""
    fired = cooling(anomalies, anomaly_type, minutes, as_of).agg(F.count("*").alias("n"))
    return candidates.filter(fired.scalar() == 0)


def replayed_cooldown(candidates: DataFrame, minutes: int, tick: str,
                      keys: tuple[str, ...] = ("anomaly_type", "dedup_key")) -> DataFrame:
    """Replay the throttle over history: which ticks fire, per key, when each waits for the last that fired.

    Candidates are first reduced to the distinct detection ticks of a key, map-side; a tick fires once however many
    hits it holds. The ticks are then sorted by key and time, and each task goes over its sorted ticks once, with one
    time in its memory: the sort may spill, and no key's ticks are gathered. A key that holds a NULL never waits, since
    it equals no other. Returns the fired ticks with the number of candidates of that tick.
    """
    ticks = (
        candidates.withColumn("detected_at", bucket(F.col("detected_at"), tick))
        .groupBy(*keys, "detected_at")
        .agg(F.count("*").alias("hits"))
    )
    ordered = ticks.repartition(*keys).sortWithinPartitions(*keys, "detected_at")
    return ordered.mapInArrow(_fire(keys, minutes * 60_000_000), ticks.schema)


def _fire(keys: tuple[str, ...], wait: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None  # the key of the last tick, and when it fired last
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            times = batch.column(batch.schema.get_field_index("detected_at")).cast(pa.int64()).to_numpy()
            change = np.zeros(len(times), bool)
            for column in columns:
                codes = column.dictionary_encode().indices.fill_null(-1).to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            starts = [0, *np.flatnonzero(change).tolist()]
            fired = []
            for start, stop in zip(starts, [*starts[1:], len(times)]):
                key = tuple(c[start].as_py() for c in columns)
                if None in key:
                    fired += range(start, stop)
                    continue
                if key != current:
                    current, last = key, None
                at = start if last is None else start + int(np.searchsorted(times[start:stop], last + wait))
                while at < stop:  # from one that fires straight to the next that may
                    fired.append(at)
                    last = int(times[at])
                    at = start + int(np.searchsorted(times[start:stop], last + wait))
            yield batch.take(pa.array(fired, pa.int64()))

    return run
