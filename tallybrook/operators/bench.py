"""Statistics of timings and token lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's values are counted by before ranks are looked for in one of them.
RANGES = 4096
#: Values that a group may have for one task to go through them in order.
SMALL = 100_000


def _quantiles(rows: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """key, share, q: exact quantiles (between neighbours by linear interpolation), without a task that holds a group.

    Values are counted by range between a group's least and largest, which tells the range of each rank; different values
    of those ranges are counted and summed up in order.
    """
    d = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    ends = d.groupBy("k").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    width = F.col("high") - F.col("low")
    place = F.when(width > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("x") - F.col("low")) / width * RANGES))).otherwise(0).cast("int")
    placed = d.join(ends, "k").select("k", "x", "n", place.alias("r"))
    ranges = placed.groupBy("k", "n", "r").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("k").orderBy("r")
    ranges = ranges.withColumn("after", F.sum("c").over(upto)).withColumn("before", F.col("after") - F.col("c"))
    rank = F.explode(F.array(*(F.struct(F.lit(q).alias("share"), side((F.col("n") - 1) * q).cast("bigint").alias("rank")) for q in shares for side in (F.floor, F.ceil)))).alias("w")
    wanted = ranges.select("k", "n", "r", "before", "after", rank).where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("after"))).distinct()
    # The different values of the wanted ranges, with their counts: a range has one in RANGES of the group's spread.
    inside = placed.join(wanted.select("k", "r", "before").distinct(), ["k", "r"]).groupBy("k", "r", "before", "x").agg(F.count("*").alias("c"))
    inside = inside.withColumn("stop", F.col("before") + F.sum("c").over(Window.partitionBy("k", "r").orderBy("x"))).withColumn("start", F.col("stop") - F.col("c"))
    w = wanted.select("k", "n", "r", F.col("w.share").alias("share"), F.col("w.rank").alias("rank"))
    found = w.join(inside, ["k", "r"]).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop")))
    both = found.groupBy("k", "n", "share").agg(F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"))
    exact = (F.col("n") - 1) * F.col("share")
    return both.select(F.col("k").alias(key), "share", (F.col("a") + (F.col("b") - F.col("a")) * (exact - F.floor(exact))).alias("q"))


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, median (null for a group without values), of groups of any size and number.

    A small group's values are counted through in order, after one shuffle and one sort that can spill.  Larger groups are few, and are
    told by a count.
    """
    d = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x"))
    large = F.broadcast(d.where("k IS NOT NULL").groupBy("k").agg(F.count("x").alias("n")).where(F.col("n") > SMALL).select("k"))  # a key in SMALL rows at most
    order = Window.partitionBy("k").orderBy(F.asc_nulls_last("x"))
    counted = d.join(large, "k", "left_anti").select("k", "x", F.row_number().over(order).alias("i"), F.lead("x").over(order).alias("next"), F.count("x").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    middle = F.when(F.col("n") % 2 == 1, F.col("x")).otherwise(F.col("x") + (F.col("next") - F.col("x")) * 0.5)
    small = counted.where(F.col("i") == F.greatest(F.lit(1), F.ceil(F.col("n") / 2))).select(F.col("k").alias(key), F.when(F.col("n") > 0, middle).alias("median"))
    return small.unionByName(_quantiles(d.join(large, "k", "left_semi"), "k", "x", [0.5]).select(F.col("k").alias(key), F.col("q").alias("median")))


def latency(rows: DataFrame, key: str, seconds: str, units: str | None = None) -> DataFrame:
    """key, n, mean, median, max; with units, the sum of seconds by the sum of units (not a mean of shares)."""
    out = [F.count("*").alias("n"), F.avg(seconds).alias("mean"), F.max(seconds).alias("max")]
    d = rows.groupBy(key).agg(*out, *([(F.sum(seconds) / F.sum(units)).alias("per_unit")] if units else []))
    return d.join(medians(rows, key, seconds), key, "left").select(key, "n", "mean", "median", "max", *(["per_unit"] if units else []))


def warm(rows: DataFrame, key: str, seconds: str, iteration: str) -> DataFrame:
    """key, mean, max of all iterations but the first."""
    return rows.where(F.col(iteration) > 0).groupBy(key).agg(F.avg(seconds).alias("mean"), F.max(seconds).alias("max"))


def lengths(rows: DataFrame, length: str, slack: int = 10) -> DataFrame:
    """p50, p95, p99, max, the limit that follows, and the share of rows that it would cut."""
    q = _quantiles(rows.select(F.lit(0).alias("all"), length), "all", length, [0.5, 0.95, 0.99])
    of = lambda share: F.max(F.when(F.col("share") == share, F.col("q")))
    p = q.agg(of(0.5).alias("p50"), of(0.95).alias("p95"), of(0.99).alias("p99")).crossJoin(rows.agg(F.max(length).alias("max"))).withColumn("limit", F.ceil("p99") + slack)
    cut = rows.crossJoin(F.broadcast(p.select("limit"))).agg(F.avg((F.col(length) > F.col("limit")).cast("double")).alias("cut"))  # one row on either side
    return p.crossJoin(F.broadcast(cut))


def tilt(rows: DataFrame, key: str, angle: str, most: float) -> DataFrame:
    """key, tilt (the median angle), rejected."""
    return medians(rows, key, angle).select(key, F.col("median").alias("tilt"), (F.abs("median") > most).alias("rejected"))


def top(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def sampled(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows, the same for the same seed: the first by a hash of their key, then by the key.  Without replacement."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))
    return rows.orderBy(digest, *key).limit(n)


def selected(models: DataFrame, choice: DataFrame) -> DataFrame:
    """models: model, variant, size.  choice: model, variant.  The chosen variants with their share of all chosen sizes."""
    d = models.join(F.broadcast(choice), ["model", "variant"])  # a row a model
    total = d.agg(F.sum("size").alias("total"))
    return d.crossJoin(F.broadcast(total)).select("model", "variant", "size", (F.col("size") / F.col("total")).alias("share"))


def swapped(config: DataFrame, swaps: DataFrame) -> DataFrame:
    """config: part, path.  swaps: part, path.  The configuration with what swaps has in place of its own."""
    s = swaps.select("part", F.col("path").alias("other"))
    return config.join(F.broadcast(s), "part", "left").select("part", F.coalesce("other", "path").alias("path"))
