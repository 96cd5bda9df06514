"""Pareto order sampling: each source gets whole copies of its documents and a fixed-size sample of unequal probabilities
for the rest of its target. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthwatch.llm.base import ROW, WORD, stored

WEIGHTS = (5, 2, 1)  # by source in code-point order, repeating
MOST_COPIES = 3
COPIES = "__copies_of_row"
BUCKETS = 1 << 14  # bins of the rank; only one bin of a source is ever ordered exactly


def uniform(seed: str, *parts: Column) -> Column:
    """A number of (0, 1) that depends on the row alone: 52 bits of an MD5, plus one half."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Of one row for each source (source, source_size): its target share of all sizes.

    Weights repeat over the sources by code point, NULL last. A target stops at `most` times its source's size and
    what is over is shared again by weight: with sources in order of cap / weight, the first k stand at their caps
    and the others at level * weight, for the least k whose next cap lies above the level.
    The frame holds one row for each source, so its two windows are over sources, never over documents.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.cast("long").alias("w")).withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    up_to, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({
        "level": (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up_to), F.lit(0)))
        / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(up_to), F.lit(0))),
    })
    free = F.col("cap") >= F.col("level") * F.col("w")
    s = s.withColumn("first_level", F.first(F.when(free, F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    open_ = F.max(free.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return s.select("source", "source_size", F.when(open_, F.col("first_level") * F.col("w")).otherwise(F.col("cap")).cast("double").alias("target"))


def _first_in_order(d: DataFrame, budget: str) -> DataFrame:
    """Adds `take`: 1 for the first rows of a source in the order of rank, as long as their sizes stay within `budget`.

    Sizes are summed over bins first, and by row only inside the one bin of a source in which the budget ends.
    """
    bins = d.groupBy("none", "name", "bin", budget).agg(F.sum("size").alias("words"))
    before = bins.selectExpr(
        "none", "name", "bin", budget, "words",
        "coalesce(sum(words) OVER (PARTITION BY none, name ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start",
    )
    last = stored(before.where(f"start <= {budget} AND start + words > {budget}").select("none", "name", F.col("bin").alias("last"), "start"))
    d = d.join(last, ["none", "name"], "left")
    edge = d.where("bin = last").selectExpr(
        "*", f"""CAST(start + sum(size) OVER (PARTITION BY none, name ORDER BY rank, u, size, doc_id ROWS UNBOUNDED PRECEDING) <= {budget} AS INT) AS take""")
    whole = d.where("last IS NULL OR bin <> last").withColumn("take", (F.col("last").isNull() | (F.col("bin") < F.col("last"))).cast("int"))
    return whole.unionByName(edge).drop("last", "start")


def inclusion_rates(sizes: DataFrame) -> DataFrame:
    """Of (none, name, size, rest, m), one row for each source and size that m documents have: (none, name, rate), with
    which min(1, rate * size) of all documents of a source add up, weighted by their sizes, to the source's `rest`.

    Documents of the largest sizes may be certain. Rate is what is left of the rest for all smaller ones, over the sum
    of their squared sizes, for the fewest certain sizes with which nothing else goes above 1. Windows are over the distinct sizes of
    a source, not over its documents; sums are exact.
    """
    by = "PARTITION BY none, name ORDER BY size DESC ROWS BETWEEN"
    square = "CAST(m AS DECIMAL(18, 0)) * CAST(size AS DECIMAL(12, 0)) * CAST(size AS DECIMAL(12, 0))"
    s = sizes.where("size > 0").selectExpr("none", "name", "size", "rest", "m * size AS words", f"CAST({square} AS DECIMAL(38, 0)) AS squares")
    s = s.selectExpr(
        "none", "name", "size",
        f"(rest - coalesce(sum(words) OVER ({by} UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"
        f" / CAST(sum(squares) OVER ({by} CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate",
    )
    return s.where("rate * size <= 1").groupBy("none", "name").agg(F.max_by("rate", "size").alias("rate"))


def _numbered(d: DataFrame) -> DataFrame:
    """Adds `place`: 0, 1, … among rows of equal id, text and source, whose order does not matter.

    Only keys that stand more than once are numbered: inside the parts the rows were written in, each part from where the
    parts before it end. So equal rows, however many, are never gathered in one task.
    """
    key = ["none", "name", "id", "digest"]
    some = stored(d.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("m")))
    often = some.groupBy(*key).agg(F.sum("m").alias("all")).where("all > 1").drop("all")
    before = stored(some.join(often, key).selectExpr(
        *key, "part", "coalesce(sum(m) OVER (PARTITION BY none, name, id, digest ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start",
    ))
    keyed = [*key, "part"]
    inside = d.join(before, keyed).selectExpr("*", "start + row_number() OVER (PARTITION BY none, name, id, digest, part ORDER BY size) - 1 AS place").drop("start")
    return d.join(before, keyed, "left_anti").withColumn("place", F.lit(0).cast("long")).unionByName(inside)


def mixed_sources(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES,
                  carry: str | None = None) -> DataFrame:
    """Every document with the words that the mix takes of it (0, or its size times a whole number up to `most`), and
    the column `carry` if named.

    A source whose target is f times its size takes floor(f) copies of every document. The rest of the target is a
    Pareto order sample: each document has an inclusion probability `p` in proportion to its size, so chosen that the
    words expected are the rest; what comes to 1 or more is certain and takes one more whole copy. Documents are ranked by their
    random odds over their odds of inclusion and taken in that order while their words fit the rest. What a long
    document at the end leaves open is filled once more by the next ones in order that fit.

    The random number depends on seed, doc_id, text and the place among equal rows, so rows without a doc_id and rows
    that share one are drawn on their own, and reruns agree. Equal ranks are ordered by number, size and doc_id.

    A NULL text has size 0; documents without words take nothing beyond the whole copies; NULL sources form one source; a source
    without words takes nothing. Texts are only counted and hashed, whatever their length. An empty table gives no
    rows. Other columns are not read.
    """
    extra = [carry] if carry else []
    source = F.col("source").cast("string")
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"),
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.shiftrightunsigned(F.monotonically_increasing_id(), 33).alias("part"), *extra,
    )
    d = stored(d)
    targets = stored(source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.withColumn("copies", F.floor(ratio)).select(
        F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target", "copies",
        F.when(ratio > F.col("copies"), F.col("target") - F.col("copies") * F.col("source_size")).otherwise(F.lit(0.0)).alias("rest"),
    )
    sizes = d.groupBy("none", "name", "size").agg(F.count(F.lit(1)).alias("m")).join(t, ["none", "name"])
    t = stored(t.join(inclusion_rates(sizes), ["none", "name"], "left"))
    odds = lambda x: x / (F.lit(1.0) - x)
    d = _numbered(d).withColumn("u", uniform(seed, F.col("id"), F.col("digest"), F.col("place"))).drop("id", "digest", "part", "place").join(t, ["none", "name"])
    d = d.withColumn("p", F.least(F.coalesce(F.col("rate") * F.col("size"), F.lit(0.0)), F.lit(1.0)))
    d = d.withColumn("rank", F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, odds(F.col("u")) / odds(F.col("p"))))
    # bins rise with the rank; documents that cannot be taken have no rank and come last
    d = d.withColumn("bin", F.coalesce(F.floor(F.col("rank") / (F.col("rank") + 1) * BUCKETS), F.lit(BUCKETS)).cast("int"))
    first = stored(_first_in_order(d.where("p > 0"), "rest"))
    had = stored(first.where("take = 1").groupBy("none", "name").agg(F.sum("size").alias("had")))
    first = first.join(had, ["none", "name"], "left").withColumn("open", F.col("rest") - F.coalesce("had", F.lit(0))).withColumnRenamed("take", "taken1")
    fits = "taken1 = 0 AND size <= open"
    columns = ["doc_id", "source", "size", "source_size", "target", "copies", "p", "extra", *extra]
    second = _first_in_order(first.where(fits), "open").withColumnRenamed("take", "extra").select(*columns)
    out = first.where(f"NOT ({fits})").withColumnRenamed("taken1", "extra").select(*columns).unionByName(second)
    out = out.unionByName(d.where("p <= 0").withColumn("extra", F.lit(0)).select(*columns))
    copies = (F.col("copies") + F.col("extra")).cast("int")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), "source", copies.alias("copies"), "p", *extra)


def mixture(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with their own columns only."""
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()))
    taken = mixed_sources(rows, seed, carry=ROW).where("taken > 0").select(ROW, F.col("copies").alias(COPIES))
    return rows.join(taken, ROW).withColumn(COPIES, F.explode(F.sequence(F.lit(1), F.col(COPIES)))).drop(ROW, COPIES)
