"""Mixing sources to target weights: capped water-filling and seeded repetitions (operator 10).

Everything is DataFrame work.  One row per source goes through the water-filling; documents never
gather by source.  Within a source, documents stand in the order of a seeded hash of their id, then of id, size and
content, and those before a cut get one repetition more.  The cut is found from sums over BINS ranges of the hash
(pre-aggregated in the tasks that read the rows), then among the different documents of the one range that holds it, and,
if it falls among copies of one document, among BINS ranges of these and the copies of one range.  So a source's words
come within half a document of its target, even if all its rows share an id.

Defined results: a null text, or one of white space, has size 0 and takes nothing; a null source is a source
of its own, last in order; a null doc_id hashes as the empty text; rows that share a doc_id are
documents of their own that stand side by side; which of wholly equal rows are repeated makes no difference; very long
texts count whole; a source of one document is taken a whole number of times; an empty table gives no rows; columns of any
name pass through repeated().  The water-filling sees a row a source in one task: sources are names, not documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, discard, settle, shared_dir


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code-point order; total is the mix's size in input sizes; epochs caps a source's repetitions."""

    weights: tuple[int, ...] = (5, 2, 1)
    total: float = 1.5
    epochs: int = 2
    seed: str = "mix"
    bins: int = 4096

    def targets(self, sizes: DataFrame) -> DataFrame:
        """sizes: source, source_size (a row each).  Adds target.

        With sources in the order of cap / weight, the saturated ones are a prefix: the level that the
        rest would share after a prefix is saturated is known for each prefix, and the first source
        that stays below its cap at its own level ends it.  This is where clamping and resharing settle.
        """
        every = Window.orderBy(F.asc_nulls_last("source"))
        by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
        before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
        rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        whole = Window.partitionBy()
        w = sizes.withColumn("place", F.row_number().over(every))
        w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, self.weights)), (F.pmod(F.col("place") - 1, F.lit(len(self.weights))) + 1).cast("int")))
        w = w.withColumn("cap", F.col("source_size") * self.epochs)
        w = w.withColumn("level", (F.lit(self.total) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
        w = w.withColumn("below", F.col("level") * F.col("weight") < F.col("cap"))
        w = w.withColumn("first", F.min_by("level", F.when(F.col("below"), F.struct(F.col("cap") / F.col("weight"), "place"))).over(whole))
        target = F.when(F.col("first").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("first") * F.col("weight")))
        return w.select("source", "source_size", "weight", target.alias("target"))

    def apply(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", rows: bool = False) -> DataFrame:
        """doc_id, size, source, source_size, target, repeats, taken of every row of docs; with rows, the row itself too, as `row`."""
        folder = shared_dir(docs.sparkSession)
        fine = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        content = F.xxhash64(*(docs[c] for c in fine))
        d = docs.select(*[F.struct(*(docs[c] for c in docs.columns)).alias("row")] * rows, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), content.alias("content"))
        d = d.withColumn("draw", draw(F.col("doc_id"), self.seed)).withColumn("bin", self._range(F.col("draw"), 60))
        # The places of copies among each other are kept with the rows: another reading could deal them otherwise.
        d = settle(d.withColumn("place", F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(_PLACES))), folder, "sizes")
        bins = settle(d.groupBy("source", "bin").agg(F.sum("size").alias("sum")), folder, "bins")
        # A row a source: the water-filling's windows see no more than that.
        targets = self.targets(bins.groupBy("source").agg(F.sum("sum").alias("source_size")))
        plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        plan = settle(plan.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), folder, "plan")
        same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
        extra = plan.select(F.col("source").alias("at"), "extra")
        # The range of the hash in which the running sum passes the extra share; bins rows a source.
        cut_bin = settle(_cut(bins.join(extra, same("source", "at")), "bin", F.lit(0.0)).select("at", F.col("bin").alias("cut_bin"), "before", "extra"), folder, "cut_bin")
        # Among the different documents of that range, the one in which it does.
        inside = d.join(cut_bin, same("source", "at") & (F.col("bin") == F.col("cut_bin")))
        inside = inside.groupBy("source", "at", "draw", "doc_id", "size", "content", "before", "extra").agg(F.count("*").alias("n")).withColumn("sum", F.col("n") * F.col("size"))
        here = F.struct("draw", "doc_id", "size", "content")
        cut_key = _cut(inside.withColumn("key", here), "key", F.col("before"))
        # Of its n copies, those come first whose middle lies before the cut.
        half = lambda k: F.col("before") + k * F.col("size") - F.col("size") / 2 <= F.col("extra")
        about = F.greatest(F.lit(0), F.floor((F.col("extra") - F.col("before")) / F.col("size") + 0.5))
        cut_key = cut_key.withColumn("about", about).withColumn("m", F.when(~half(F.col("about")), F.col("about") - 1).when(half(F.col("about") + 1), F.col("about") + 1).otherwise(F.col("about")))
        cut_key = settle(cut_key.select("at", "key", F.least(F.greatest("m", F.lit(0)), F.col("n")).alias("m"), "n"), folder, "cut_key")
        # The place up to which the copies that come first stand: found as the cut before, by ranges, then in one of them.
        copies = d.withColumn("own", here).join(cut_key.where("m > 0 AND m < n"), same("source", "at") & F.col("own").eqNullSafe(F.col("key")))
        copies = settle(copies.select("at", "place", F.col("m").cast("double").alias("extra"), self._range(F.col("place"), 62).alias("bin")), folder, "copies")
        ranges = _cut(copies.groupBy("at", "extra", "bin").agg(F.count("*").alias("sum")), "bin", F.lit(0.0)).select("at", "bin", "before")
        last = copies.alias("c").join(ranges.alias("r"), F.expr("c.at <=> r.at AND c.bin = r.bin")).select("c.at", "place", "before", "extra")
        order = F.row_number().over(Window.partitionBy("at").orderBy("place"))
        upto = last.withColumn("k", F.col("before") + order).where(F.col("k") <= F.col("extra")).groupBy("at").agg(F.max("place").alias("inner"))
        upto = ranges.withColumnRenamed("at", "x").join(upto, same("x", "at"), "left").select(F.col("x").alias("upto_at"), "bin", "inner")
        # All of it, a row a source.
        per = plan.select(F.col("source").alias("at"), "source_size", "target", "whole", "extra")
        for more in (cut_bin.select(F.col("at").alias("x"), "cut_bin"), cut_key.select(F.col("at").alias("x"), "key", "m", "n"), upto.select(F.col("upto_at").alias("x"), F.col("bin").alias("copy_bin"), "inner")):
            per = per.join(more, same("at", "x"), "left").drop("x")
        per = settle(per, folder, "per_source")
        copy_bin = self._range(F.col("place"), 62)
        among = F.when(F.col("m") >= F.col("n"), True).when(F.col("m") <= 0, False).when(copy_bin != F.col("copy_bin"), copy_bin < F.col("copy_bin")).otherwise(F.coalesce(F.col("place") <= F.col("inner"), F.lit(False)))
        in_bin = F.when(here.eqNullSafe(F.col("key")), among).otherwise(F.coalesce(here < F.col("key"), F.lit(False)))
        # No cut (rounding): the share is the whole source.
        more = F.when(F.col("extra") <= 0, False).when(F.col("cut_bin").isNull(), True).when(F.col("bin") != F.col("cut_bin"), F.col("bin") < F.col("cut_bin")).otherwise(in_bin)
        repeats = F.col("whole") + more.cast("long")
        discard(docs.sparkSession, folder, "bins", "plan", "cut_bin", "cut_key", "copies")
        out = d.join(per, same("source", "at"), "left")  # rows that share a source are many; sources are few
        return out.select(*["row"] * rows, "doc_id", "size", "source", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))

    def _range(self, n: Column, bits: int) -> Column:
        """Which of bins ranges a number of so many bits falls in."""
        return F.shiftright(n, bits - (self.bins - 1).bit_length()).cast("int")

    def repeated(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
        """The mix itself: each row of docs as often as it is taken, with the same columns."""
        times = F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int")))
        return self.apply(docs, doc_id, text, source, rows=True).where("repeats > 0").select("row", times).select("row.*")


#: The bits of a copy's place.
_PLACES = (1 << 62) - 1


def _cut(rows: DataFrame, key: str, start: Column) -> DataFrame:
    """rows: at, key, sum, extra.  For each at the row in which the running sum from start passes extra; before: the sum before it."""
    order = Window.partitionBy("at").orderBy(key)
    d = rows.withColumn("upto", start + F.sum("sum").over(order)).withColumn("before", F.col("upto") - F.col("sum"))
    return d.where((F.col("before") <= F.col("extra")) & (F.col("upto") > F.col("extra")))


def words(text: Column) -> Column:
    """The number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A whole number below 2**60 from the seed and the id, the same in any engine that has md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")
