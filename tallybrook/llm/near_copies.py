"""Copies by the Jaccard similarity of their shingles, for SimHash.keep_one with a similarity.

Two texts are copies if the sets of their shingles (XXH64, seed 42) have that similarity at least; a group is what copies
connect.  At 0.8 fingerprints differ in about ten of 64 bits, where no bucket of agreeing segments is both safe and
selective; so candidates come from MinHash: BANDS buckets of ROWS minima each, of which a pair at 0.8 shares none
with a chance of 1.3e-7.  What buckets connect is then compared: pigeonring chains of the sets' fingerprints prune
(at RADIUS bits, where a pair at 0.8 is cut off with a chance of about 1e-6), and the sets themselves decide.

No task holds a group.  A bucket's members are linked to its smallest node; buckets of many nodes are found in a sample
and have that node broadcast.  What buckets connect is compared in parts of about PART shingles: first, twice, all
members of what has more than a part with its smallest node (a stream, so a tight group of any size falls to one link a
member there), then each two parts of what is left.

Defined results: fewer words than a shingle are one shingle; texts without words (null, empty, white space) are
copies of each other; very long texts are whole sets; a null doc_id stands below all others; a group keeps the smallest
doc_id, and one row of it; texts are told apart by 64 bits; an empty table gives no rows; columns of any name pass through.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import ascii_lower_words, discard, join_spread, parallelism, settle, tidied
from .components import components

BANDS, ROWS = 40, 5
#: Bits that fingerprints of copies may differ in.
RADIUS = 24
#: Shingles in a part of what buckets connect, about; a longer text is a part of its own.
PART = 2_000_000
#: Nodes that are looked at for buckets of many nodes, about, and the share of them that makes a bucket one.
SAMPLE, MANY = 50_000, 500
#: Shingles whose minima are taken together.
_TOGETHER = 1024

_rng = np.random.default_rng(11)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The set of a text's shingles as sorted hashes; no words: zero alone."""
    ws = ascii_lower_words(text)
    if not ws:
        return np.zeros(1, np.uint64)
    joined = b" ".join(ws)
    ends = list(accumulate(len(w) + 1 for w in ws))
    n = max(1, len(ws) - words + 1)
    last = ends[words - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends][:n], last, strict=True)], np.uint64))


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The BANDS buckets of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _TOGETHER):
        x = _TIMES[:, None] * hashes[at : at + _TOGETHER]
        x += _PLUS[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * _FOLD
        out ^= out >> np.uint64(31)
    return out


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets are copies."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def groups(sets: list[np.ndarray], prints: np.ndarray, similarity: float) -> np.ndarray:
    """For each set the place of the first in its group: all that copies connect.

    A search from copy to copy takes what is found out of the rest.  Chains of the fingerprints prune, the sets decide.
    """
    group, rest = np.arange(len(sets)), np.arange(len(sets))
    while len(rest) > 1:
        first, rest = int(rest[0]), rest[1:]
        queue = [first]
        while queue and len(rest):
            x = queue.pop()
            close = np.flatnonzero(simhash.near(prints[x], prints[rest], RADIUS))
            found = close[[alike(sets[x], sets[y], similarity) for y in rest[close]]] if len(close) else close
            if len(found):
                queue += rest[found].tolist()
                group[rest[found]] = first
                rest = np.delete(rest, found)
    return group


def _connected(nodes: DataFrame, folder: str, name: str) -> DataFrame:
    """nodes: node, buckets, fresh.  node, component: what buckets that hold a fresh node connect, of nodes that share one."""

    def stars(batches):
        """Buckets come one after another, fresh nodes first; each member is linked with the first, if that is fresh."""
        head = None
        for b in batches:
            bucket, fresh, node = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            if not len(node):
                continue
            if head is not None:
                bucket, fresh, node = (np.concatenate([[h], x]) for h, x in zip(head, (bucket, fresh, node), strict=True))
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            at = np.repeat(first, np.diff([*first, len(bucket)]))
            real = (at != np.arange(len(at))) & fresh[at].astype(bool)
            head = bucket[at[-1]], fresh[at[-1]], node[at[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(node[at[real]], pa.int64()), pa.array(node[real], pa.int64())], ["a", "b"])

    spark = nodes.sparkSession
    total = nodes.count()
    each = nodes.select(F.explode("buckets").alias("bucket"), "fresh", "node")
    some = nodes.where(F.pmod(F.xxhash64(F.lit("sample"), "node"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 20)))
    found = some.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().where(F.col("count") * MANY > min(total, SAMPLE)).where("count > 4")
    # No more than MANY buckets of a band hold such a share of the sample.
    many = settle(found.orderBy(F.desc("count")).limit(MANY * BANDS).select("bucket"), folder, f"{name}-many")
    hot = each.join(F.broadcast(many), "bucket")
    least = F.broadcast(hot.groupBy("bucket").agg(F.min(F.struct((~F.col("fresh")).alias("stale"), "node")).alias("least")))
    linked = hot.join(least, "bucket").where(~F.col("least.stale") & (F.col("least.node") != F.col("node"))).select(F.col("least.node").alias("a"), F.col("node").alias("b"))
    cold = each.join(F.broadcast(many), "bucket", "left_anti").repartition(parallelism(spark), "bucket").sortWithinPartitions("bucket", F.desc("fresh"), "node")
    out = settle(components(linked.unionByName(cold.mapInArrow(tidied(stars), "a long, b long")), f"{folder}/{name}"), folder, f"{name}-connected")
    discard(spark, folder, name, f"{name}-many")
    return out


def _parted(nodes: DataFrame, connected: DataFrame, folder: str, name: str) -> DataFrame:
    """node, rep, print, component, parts (that its component has) and part."""
    d = nodes.select("node", "rep", "print", "size").join(connected, "node")
    weights = settle(d.groupBy("component").agg(F.greatest(F.ceil(F.sum("size") / PART), F.lit(1)).cast("int").alias("parts"), F.count("*").alias("m")), folder, f"{name}-parts")
    d = join_spread(d, weights, "component", "m")
    out = d.select("node", "rep", "print", "component", "parts", F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int").alias("part"))
    return settle(out, folder, f"{name}-parted")


def _with_text(members: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """members with their texts; rows that share id and text come repeatedly."""
    d = simhash.keyed(docs, doc_id, text)
    return members.join(d.select(F.col("doc_id").alias("rep"), "node", "text"), ["rep", "node"])


def _with_leader(members: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, similarity: float) -> DataFrame:
    """a (its component's smallest node), b: the members that are copies of it.  Each part gets the leader, then its members in a stream."""

    def compare(batches):
        place, own = None, None
        for b in batches:
            a, out = [], []
            for component, part, follows, node, bits, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not follows:
                    if (component, part) != place:
                        place, own = (component, part), (shingles(t, words), np.uint64(bits & (1 << 64) - 1))
                elif simhash.near(own[1], np.array([bits], np.int64).astype(np.uint64), RADIUS)[0] and alike(own[0], shingles(t, words), similarity):
                    a.append(component)
                    out.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(out, pa.int64())], ["a", "b"])

    d = _with_text(members, docs, doc_id, text)
    lead = d.where("node = component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = lead.withColumn("follows", F.lit(False)).unionByName(d.where("node <> component").withColumn("follows", F.lit(True)), allowMissingColumns=True)
    dealt = rows.select("component", "part", "follows", "node", "print", "text").repartition(parallelism(docs.sparkSession), "component", "part").sortWithinPartitions("component", "part", "follows")
    return dealt.mapInArrow(tidied(compare), "a long, b long")


def _within(members: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int, similarity: float) -> DataFrame:
    """a, b: links that connect the copies among each component's members; a task holds two of its parts."""

    def search(batches):
        held: dict[int, tuple[np.ndarray, int]] = {}
        place = None

        def done():
            nodes = np.array(list(held), np.int64)
            first = groups([s for s, _ in held.values()], np.array([p for _, p in held.values()], np.int64).astype(np.uint64), similarity)
            real = first != np.arange(len(first))
            return pa.RecordBatch.from_arrays([pa.array(nodes[first[real]], pa.int64()), pa.array(nodes[real], pa.int64())], ["a", "b"])

        for b in batches:
            for component, low, high, node, bits, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (component, low, high) != place:
                    if held:
                        yield done()
                    place, held = (component, low, high), {}
                if node not in held:  # rows that share id and text
                    held[node] = shingles(t, words), bits
        if held:
            yield done()

    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    d = _with_text(members, docs, doc_id, text).withColumn("other", other)
    d = d.select("component", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "print", "text")
    dealt = d.repartition(parallelism(docs.sparkSession), "component", "low", "high").sortWithinPartitions("component", "low", "high", "node")
    return dealt.mapInArrow(tidied(search), "a long, b long")


def keepers(job: simhash.SimHash, docs: DataFrame, folder: str, doc_id: str, text: str) -> DataFrame:
    """doc_id and node of the document that each group keeps, and n, how many rows have both."""
    spark, words, similarity = docs.sparkSession, job.words, job.similarity

    def sketch(batches):
        for b in batches:
            sets = [shingles(t, words) for t in b.column(2).to_pylist()]
            flat = np.concatenate([buckets(s) for s in sets]).astype(np.int64) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            prints = np.array([simhash.majority(s.astype(">u8").tobytes()) for s in sets], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists], ["doc_id", "node", "print", "size", "buckets"])

    rows = simhash.keyed(docs, doc_id, text).mapInArrow(tidied(sketch), "doc_id long, node long, print long, size long, buckets array<long>")
    # A row a text.
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("print").alias("print"), F.first("size").alias("size"), F.first("buckets").alias("buckets"))
    nodes = settle(nodes, folder, "nodes")
    active, links = nodes.withColumn("fresh", F.lit(True)), []
    for k in range(3):
        members = _parted(nodes, _connected(active, folder, f"round-{k}"), folder, f"round-{k}")
        large = members.where("parts > 1")
        if k == 2 or not large.limit(1).count():
            links.append(settle(_within(members, docs, doc_id, text, words, similarity), folder, f"within-{k}"))
            break
        links.append(settle(_within(members.where("parts = 1"), docs, doc_id, text, words, similarity), folder, f"within-{k}"))
        links.append(settle(_with_leader(large, docs, doc_id, text, words, similarity), folder, f"leader-{k}"))
        # Next come the members that are no copies of their leader, with those copies that share a bucket with one of them.
        copies = links[-1].select(F.col("b").alias("node")).distinct().withColumn("copy", F.lit(True))
        rest = large.where("node <> component").select("node").join(copies, "node", "left")
        active = settle(nodes.join(rest, "node").withColumn("fresh", F.col("copy").isNull()).drop("copy"), folder, f"active-{k}")
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    linked = components(every, f"{folder}/groups")
    labels = nodes.select("node", "rep").join(linked, "node", "left").withColumn("label", F.coalesce("component", "node"))
    kept = labels.groupBy("label").agg(F.min(F.struct("rep", "node")).alias("x")).select(F.col("x.rep").alias("doc_id"), F.col("x.node").alias("node"))
    own = simhash.keyed(docs, doc_id, text).select("doc_id", "node")
    kept = settle(own.join(settle(kept, folder, "keepers"), ["doc_id", "node"]).groupBy("doc_id", "node").agg(F.count("*").alias("n")), folder, "kept")
    discard(spark, folder, "nodes", "groups", "keepers", *(f"{what}-{k}" for what in ("within", "leader", "active", "round") for k in range(3)), *(f"round-{k}-{what}" for what in ("connected", "parts", "parted") for k in range(3)))
    return kept
