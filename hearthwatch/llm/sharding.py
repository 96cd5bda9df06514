"""Jump consistent hashing: a stable key goes to one of n shards without a ring table; one more shard takes only
the rows that move into it. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthwatch.llm.base import stored

# Fixed values of the published algorithm: multiplier and increment of its 64-bit generator, and 2 ** 31.
MULTIPLIER, INCREMENT, SCALE = 2862933555777941757, 1, float(1 << 31)

LIMB = 22  # the state is kept as limbs of 22, 22 and 20 bits, so that no product or sum overflows a long
MASK, TOP = (1 << LIMB) - 1, (1 << 20) - 1
M0, M1, M2 = MULTIPLIER & MASK, MULTIPLIER >> LIMB & MASK, MULTIPLIER >> 2 * LIMB
USUAL_JUMPS = 48  # a key makes ln(n) + 1 jumps on average; more than this for n up to 10 ** 6 in fewer than 1 of 10 ** 10 keys


def _fold(steps: Column, state: Column, shards: int) -> Column:
    def step(s: Column, _: Column) -> Column:
        r0 = s["k0"] * M0 + INCREMENT
        r1 = s["k0"] * M1 + s["k1"] * M0 + F.shiftright(r0, LIMB)
        r2 = s["k0"] * M2 + s["k1"] * M1 + s["k2"] * M0 + F.shiftright(r1, LIMB)
        return F.transform(F.array(F.struct(r0.bitwiseAND(MASK).alias("a"), r1.bitwiseAND(MASK).alias("b"), r2.bitwiseAND(TOP).alias("c"))), lambda r: F.struct(
            F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"),
            s["j"].alias("grown"),
            F.floor((s["j"] + 1) * (F.lit(SCALE) / (F.shiftleft(r["c"], 11) + F.shiftright(r["b"], 11) + 1))).cast("long").alias("j"),
            r["a"].alias("k0"), r["b"].alias("k1"), r["c"].alias("k2"),
        ))[0]

    # rows whose next jump leaves even the grown range have ended
    return F.aggregate(steps, state, lambda s, i: F.when(s["j"] > shards, s).otherwise(step(s, i)))


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of a long key among `shards` and among one more. A NULL key counts as -1."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(-1))
    start = F.struct(
        F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("j"),
        key.bitwiseAND(MASK).alias("k0"), F.shiftrightunsigned(key, LIMB).bitwiseAND(MASK).alias("k1"),
        F.shiftrightunsigned(key, 2 * LIMB).bitwiseAND(TOP).alias("k2"),
    )
    usual = _fold(F.sequence(F.lit(1), F.lit(min(USUAL_JUMPS, shards + 1))), start, shards)
    if shards + 1 > USUAL_JUMPS:  # the rest of the jumps, for the keys that need them
        rest = F.sequence(F.lit(1), F.lit(shards + 1))
        usual = F.transform(F.array(usual), lambda s: F.when(s["j"] > shards, s).otherwise(_fold(rest, s, shards)))[0]
    return usual


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every document with its shard by doc_id, its shard if one more were appended, and a gapless slot in its shard.

    A NULL text has no bytes (size 1, CRC of nothing); a NULL doc_id is placed as the key -1; rows that share a
    doc_id share a shard and have slots of their own; an empty table gives no rows. Columns of the same names as
    those made here are not read. Rows of one shard are never gathered in one task: slots are counted inside the
    parts that the rows were written in, and each part starts where the parts before it end.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_shards(F.col("doc_id"), shards).alias("to"),
        F.monotonically_increasing_id().alias("row"),
    )
    # written once, so that the two uses below see the same rows under the same numbers
    placed = stored(placed.select(
        "doc_id", "size", "text_crc32", F.col("to.shard").cast("int").alias("shard"),
        F.col("to.grown").cast("int").alias("grown_shard"), F.shiftrightunsigned("row", 33).alias("part"), "row",
    ))
    before = (
        placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
        .selectExpr("shard", "part", "coalesce(sum(n) OVER (PARTITION BY shard ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken")
    )
    inside = placed.selectExpr("*", "row_number() OVER (PARTITION BY part, shard ORDER BY doc_id, row) - 1 AS k")
    return inside.join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("k") + F.col("taken")).cast("long").alias("slot"), "grown_shard",
    )
