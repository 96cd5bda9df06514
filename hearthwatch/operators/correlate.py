"""Alerts joined with the connections that share their flow id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .enrich import spread_nulls

ALERT_SIDE = ["alert_time", "alert_signature", "severity", "src_ip", "dest_ip", "community_id"]
FLOW_SIDE = ["zeek_duration", "zeek_orig_bytes", "zeek_resp_bytes", "zeek_conn_state"]


def _alert_side(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.col("timestamp").alias("alert_time"), F.col("signature").alias("alert_signature"), "severity", "src_ip",
        "dest_ip", "community_id",
    )


def _flow_side(conn: DataFrame) -> DataFrame:
    return conn.filter("community_id IS NOT NULL").select(
        "community_id", F.col("duration").alias("zeek_duration"), F.col("orig_bytes").alias("zeek_orig_bytes"),
        F.col("resp_bytes").alias("zeek_resp_bytes"), F.col("conn_state").alias("zeek_conn_state"),
    )


def alerts_with_flows(alerts: DataFrame, conn: DataFrame) -> DataFrame:
    """Every alert with each of its flows; alerts without one stay, with empty flow columns.

    Written as an inner join plus the alerts left over. Unlike an outer join, the inner one lets Spark ship
    the alerts (the smaller side by far) to the connections, or split a hot flow id on either side. The second
    read of the connections only keeps distinct ids.
    """
    rows = _alert_side(alerts)
    flows = _flow_side(conn)
    matched = rows.join(flows, "community_id").select(*ALERT_SIDE, *FLOW_SIDE)
    ids = rows.select("community_id").filter("community_id IS NOT NULL").distinct()
    met = flows.select("community_id").join(ids, "community_id", "left_semi").distinct()
    # NULL ids match nothing; the second key scatters them
    loose = rows.withColumn("_spread", spread_nulls(F.col("community_id").isNull(), "alert_time", "src_ip", "dest_ip"))
    alone = loose.join(met.withColumn("_spread", F.lit(0)), ["community_id", "_spread"], "left_anti")
    return matched.unionByName(alone.select(*ALERT_SIDE), allowMissingColumns=True)


def newest_alerts_with_flows(alerts: DataFrame, conn: DataFrame, n: int) -> DataFrame:
    """The first n rows of `alerts_with_flows`, newest alert first.

    Each alert yields at least one row, so the n newest alerts suffice, and of a flow id's connections only
    the first n can be shown. Both cuts are exact, and the second happens before the shuffle, so a hot flow id
    costs no more than any other.

    The newest alerts are found first, by a job of its own. Their flow ids, n at most, are then constants of the scan of
    the connections: a stored table with Bloom filters on the id is read where one of them may be, not as a whole.
    """
    alert_order = [F.desc("alert_time"), *ALERT_SIDE[1:]]
    recent = _alert_side(alerts).orderBy(*alert_order).limit(n)
    ids = sorted({r[0] for r in recent.select("community_id").collect() if r[0] is not None})  # n values at most
    flows = _flow_side(conn).filter(F.col("community_id").isin(ids))
    place = F.row_number().over(W.partitionBy("community_id").orderBy(*FLOW_SIDE))
    first = flows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
    return (
        recent.join(first, "community_id", "left").select(*ALERT_SIDE, *FLOW_SIDE)
        .orderBy(*alert_order, *FLOW_SIDE).limit(n)
    )
