"""Line dedup that can be taken back: sharded cuckoo filters over exact reference counts (operator 1).

A line's key is the line, stripped of white space and A-Z lower-cased; keys of min_chars code points or
more count.  State is three tables: `postings` (key, document), `counts` (key, documents that hold it, the
largest of them: the keeper) and `filters` (one cuckoo filter a shard, with the keys that reached
min_docs).  Inserting or deleting documents touches the counts of their keys only, and moves keys into or
out of the filters as they pass min_docs.  A line that its filter doesn't know stays, without a look
at the exact table; what the filter lets through is checked there.

Keys travel as 128-bit hashes.  No group gathers: counts are pre-aggregated, the probes of a shard
are dealt over SALTS parts by document, each with a copy of the shard's filter, and a key with a large share of
the documents meets its count where its documents are.

Defined results: a null or empty text is one empty line; a null doc_id stands for one document below all
others; rows that share a doc_id are one document for the counts, and each row is rewritten (repeated rows alike);
very long texts and lines are read whole; ties don't occur, since the largest doc_id is one document; an empty
table stays empty; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, SPACES, discard, join_spread, parallelism, settle, shared_dir, tidied
from .cuckoo import Cuckoo

SALTS = 8


def line_key(line: str, min_chars: int) -> bytes | None:
    key = line.strip(SPACES)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None


@dataclass(frozen=True)
class LineDedup:
    min_chars: int = 40
    min_docs: int = 5
    shards: int = 256

    def keys(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """shard, key, doc_id: each key of each document once."""
        least, shards = self.min_chars, self.shards

        def cut(batches):
            for b in batches:
                ids, out = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = {k for line in (t or "").split("\n") if (k := line_key(line, least))}
                    out += own
                    ids += [i] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(k[:4], "little") % shards for k in out], pa.int32()), pa.array(out, pa.binary()), pa.array(ids, pa.int64())], ["shard", "key", "doc_id"])

        d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"))
        return d.mapInArrow(tidied(cut), "shard int, key binary, doc_id long").distinct()

    def counts(self, postings: DataFrame) -> DataFrame:
        return postings.groupBy("shard", "key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))

    def filters(self, changes: DataFrame, old: DataFrame | None = None) -> DataFrame:
        """changes: shard, add (boolean), key.  Applies them to the shards' filters (none: to empty ones)."""
        spark = changes.sparkSession
        rows = changes.select("shard", F.when(F.col("add"), 2).otherwise(1).alias("kind"), "key")
        if old is not None:
            rows = old.select("shard", F.lit(0).alias("kind"), F.col("filter").alias("key")).unionByName(rows)

        def build(batches):
            shard, held, deltas = None, None, {1: [], 2: []}

            def done():
                f = held or Cuckoo(len(deltas[2]))
                f.remove(deltas[1])
                f.insert(deltas[2])
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f.dump()], pa.binary())], ["shard", "filter"])

            for b in batches:
                for s, kind, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if s != shard:
                        if shard is not None:
                            yield done()
                        shard, held, deltas = s, None, {1: [], 2: []}
                    if kind:
                        deltas[kind].append(key)
                    else:
                        held = Cuckoo.load(key)
            if shard is not None:
                yield done()

        return rows.repartition(parallelism(spark), "shard").sortWithinPartitions("shard", "kind").mapInArrow(tidied(build), "shard int, filter binary")

    def probe(self, postings: DataFrame, filters: DataFrame) -> DataFrame:
        """The postings that their shard's filter lets through."""
        copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("filter").alias("key"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("kind"))
        asked = postings.select("shard", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"), "key", "doc_id", F.lit(1).alias("kind"))

        def run(batches):
            place, held = None, None
            for b in batches:
                key_of = list(zip(b.column("shard").to_pylist(), b.column("salt").to_pylist(), strict=True))
                keys, kinds = b.column("key").to_pylist(), b.column("kind").to_pylist()
                keep, start = [False] * len(keys), 0
                while start < len(keys):
                    end = start
                    while end < len(keys) and key_of[end] == key_of[start]:
                        end += 1
                    if key_of[start] != place:
                        place, held = key_of[start], None
                    if kinds[start] == 0:
                        held, start = Cuckoo.load(keys[start]), start + 1
                    if held and start < end:
                        keep[start:end] = held.contains(keys[start:end]).tolist()
                    start = end
                yield b.filter(pa.array(keep, pa.bool_())).select(["shard", "key", "doc_id"])

        return (
            copies.unionByName(asked).repartition(parallelism(postings.sparkSession), "shard", "salt")
            .sortWithinPartitions("shard", "salt", "kind").mapInArrow(tidied(run), "shard int, key binary, doc_id long")
        )

    def drops(self, postings: DataFrame, counts: DataFrame, filters: DataFrame) -> DataFrame:
        """doc_id and the keys whose lines it loses, as lost."""
        hot = counts.where(F.col("n_docs") >= self.min_docs).select("key", "keeper", "n_docs")
        dropped = join_spread(self.probe(postings, filters), hot, "key", "n_docs").where(F.col("doc_id") < F.col("keeper"))
        return dropped.groupBy("doc_id").agg(F.collect_set("key").alias("lost"))  # no more than the document's lines

    def _with_drops(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """row (all of docs' columns) and lost."""
        spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
        postings = settle(self.keys(docs, doc_id, text), folder, "postings")
        counts = settle(self.counts(postings), folder, "counts")
        filters = settle(self.filters(counts.where(F.col("n_docs") >= self.min_docs).select("shard", F.lit(True).alias("add"), "key")), folder, "filters")
        drops = settle(self.drops(postings, counts, filters), folder, "drops")
        discard(spark, folder, "postings", "counts", "filters")
        rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
        # The same join at every size: a broadcast of few drops, which more documents outgrow, would make disk leap.
        return rows.join(drops.hint("merge"), "doc_id", "left").select("row", "lost")

    def apply(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """docs with the dropped lines gone from its texts (null texts stay null); the columns are the same."""
        names, least = docs.columns, self.min_chars
        at = names.index(text)

        def rewrite(batches):
            for b in batches:
                columns = b.column(0).flatten()
                out = [t if t is None or not lost else "\n".join(_kept(t, set(lost), least)) for t, lost in zip(columns[at].to_pylist(), b.column(1).to_pylist(), strict=True)]
                columns[at] = pa.array(out, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names)

        return self._with_drops(docs, doc_id, text).mapInArrow(tidied(rewrite), docs.schema)

    def report(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left."""
        least = self.min_chars

        def digest(batches):
            for b in batches:
                rows = []
                ids, texts = b.column(0).flatten()
                for t, lost in zip(texts.to_pylist(), b.column(1).to_pylist(), strict=True):
                    n = (t or "").count("\n") + 1
                    kept = (t or "").split("\n") if not lost else _kept(t or "", set(lost), least)
                    rows.append((n, n - len(kept), hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest()))
                lines, dropped, sums = zip(*rows, strict=True) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([pc.cast(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

        d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        return self._with_drops(d, "doc_id", "text").mapInArrow(tidied(digest), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _kept(text: str, lost: set[bytes], least: int) -> list[str]:
    return [line for line in text.split("\n") if line_key(line, least) not in lost]


_TABLES = {"postings": "doc_id long, key binary, shard int", "counts": "key binary, n_docs long, keeper long, shard int", "filters": "filter binary, shard int"}


@dataclass
class LineIndex:
    """The state of LineDedup over a changing set of documents, as files by shard below folder.

    An insertion appends the new postings, and writes the counts of the shards it touches anew; a deletion
    writes the postings and counts of its shards anew.  Counts change by what comes or goes, and a keeper is looked for again
    only where it was deleted itself.  A filter is written anew if a key of its shard passes min_docs.  All other
    shards' files stay as they are.  `places` has the files of each shard: no more than a few paths for each.
    """

    spark: SparkSession
    rule: LineDedup = field(default_factory=LineDedup)
    folder: str = ""
    version: int = 0

    def __post_init__(self):
        self.folder = self.folder or shared_dir(self.spark)
        self.places: dict[str, dict[int, list[str]]] = {name: {} for name in _TABLES}

    def table(self, name: str, shards: set[int] | None = None) -> DataFrame:
        paths = [p for s, all_ in sorted(self.places[name].items()) if shards is None or s in shards for p in all_]
        if not paths:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).option("basePath", f"{self.folder}/{name}").parquet(*paths).select(*(c.split()[0] for c in _TABLES[name].split(", ")))

    postings = property(lambda self: self.table("postings"))
    counts = property(lambda self: self.table("counts"))
    filters = property(lambda self: self.table("filters"))

    def _write(self, name: str, rows: DataFrame, shards: set[int], add: bool = False) -> None:
        """rows are these shards' new content, or come to it."""
        at = f"{self.folder}/{name}/version={self.version}"
        rows.repartition("shard").write.partitionBy("shard").parquet(at)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        written = {int(n[6:]) for f in files.listStatus(path) if (n := f.getPath().getName()).startswith("shard=")}
        for s in shards:
            new, old = [f"{at}/shard={s}"] if s in written else [], self.places[name].pop(s, [])
            if add:
                new = old + new
            else:
                for p in old:
                    files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p), True)
            if new:
                self.places[name][s] = new

    def _touched(self, changes: DataFrame) -> set[int]:
        return {r[0] for r in changes.select("shard").distinct().collect()}  # as many as there are shards, at most

    def _move(self, before: DataFrame, after: DataFrame, shards: set[int]) -> None:
        """before, after: the counts of these shards."""
        after = settle(after.where("n_docs > 0").select("key", "n_docs", "keeper", "shard"), self.folder, f"after-{self.version}")
        least, key = self.rule.min_docs, ["shard", "key"]
        was, now = (d.where(F.col("n_docs") >= least).select(*key) for d in (before, after))
        changes = now.join(was, key, "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(now, key, "left_anti").withColumn("add", F.lit(False)))
        changes = settle(changes, self.folder, f"changes-{self.version}")
        crossed = self._touched(changes)
        if crossed:
            self._write("filters", self.rule.filters(changes, self.table("filters", crossed)), crossed)
        self._write("counts", after, shards)
        discard(self.spark, self.folder, f"after-{self.version}", f"changes-{self.version}")

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Adds documents; what is there already changes nothing."""
        self.version += 1
        keys = settle(self.rule.keys(docs, doc_id, text), self.folder, f"keys-{self.version}")
        known = self.table("postings", self._touched(keys))
        new = settle(keys.join(known, ["shard", "key", "doc_id"], "left_anti"), self.folder, f"new-{self.version}")
        shards = self._touched(new)
        before = self.table("counts", shards)
        both = before.unionByName(self.rule.counts(new)).groupBy("shard", "key").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        self._move(before, both, shards)
        self._write("postings", new.select("doc_id", "key", "shard"), shards, add=True)
        discard(self.spark, self.folder, f"keys-{self.version}", f"new-{self.version}")

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Takes documents back, as if they had never come."""
        self.version += 1
        gone = ids.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id")).distinct()
        lost = settle(self.postings.join(gone, "doc_id", "left_semi"), self.folder, f"lost-{self.version}")
        shards = self._touched(lost)
        left = settle(self.table("postings", shards).join(gone, "doc_id", "left_anti"), self.folder, f"left-{self.version}")
        before, key = self.table("counts", shards), ["shard", "key"]
        less = lost.groupBy(*key).agg(F.count("*").alias("less"), F.max("doc_id").alias("largest"))
        d = settle(before.join(less, key, "left"), self.folder, f"less-{self.version}")
        orphans = d.where("largest = keeper").select(*key)
        found = left.join(orphans, key, "left_semi").groupBy(*key).agg(F.max("doc_id").alias("found"))
        n = F.col("n_docs") - F.coalesce("less", F.lit(0))
        after = d.join(found, key, "left").select("shard", "key", n.alias("n_docs"), F.when(F.col("largest") == F.col("keeper"), F.col("found")).otherwise(F.col("keeper")).alias("keeper"))
        self._move(before, after, shards)
        self._write("postings", left.select("doc_id", "key", "shard"), shards)
        discard(self.spark, self.folder, *(f"{what}-{self.version}" for what in ("lost", "left", "less")))

    def drops(self) -> DataFrame:
        return self.rule.drops(self.postings, self.counts, self.filters)
