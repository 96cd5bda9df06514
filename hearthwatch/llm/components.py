"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthwatch.llm.base import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of links (u, v) with the least node that it can reach.

    Each round links every node to the least node beside it, from both sides in turn (the alternating star scheme),
    until every node is linked with its least node only. Each round's links are written out, and the driver sees two
    sums. The least neighbour is aggregated before the shuffle; what joins it back are two written tables, so that
    Spark can split a node with very many links.
    """
    links = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        # every larger neighbour goes to the least one
        far = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = far.groupBy("u").agg(F.min("v").alias("m"))
        far = stored(far.join(low, "u").where("m <> v OR v = m").select("u", "v", "m"))
        # each node goes to its least neighbour, and so do its other ones
        near = far.select("u", F.col("m").alias("v")).unionByName(far.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = stored(near.where("u <> v").distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen:
            break
        seen = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
