"""SimHash fingerprints, linked by pigeonring filtering (operator 8).

A 64-bit fingerprint is a ring of SEGMENTS segments.  If two fingerprints differ in at most RADIUS bits, then
from some segment on every chain of l segments has at most l * RADIUS / SEGMENTS differences: the first
two segments none, and the first five one at most.  So from some start two segments agree, and of
the next three at least two do.  Each fingerprint therefore goes, for every start and every choice of
those two, into the bucket of its 32 bits there.  Of the fingerprints that share a bucket, those whose cumulative
differences along the chain from the bucket's start leave the budget are pruned, and the others get the full Hamming check.

Equal fingerprints count once.  A bucket never gives all its pairs: a search from fingerprint to fingerprint takes what is
near out of the bucket's rest and gives one link for each, which connects the same documents.  What a task holds of
a bucket is its different fingerprints, eight bytes each, and neither documents nor texts.

With a similarity, keep_one() goes by the Jaccard similarity of the sets of shingles; see near_copies.py.

Defined results: fewer words than a shingle are one shingle; no words (null, empty, white space) are fingerprint
zero, linked like any other; very long texts are read whole; a null doc_id stands below all others, and a component
whose smallest it is has a null component_id; rows that share a doc_id are linked only if their texts are; a tie (a bit
set in just half of the shingles) is 0; an empty table gives no rows; columns of any name pass through keep_one().
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, ascii_lower_words, discard, join_spread, parallelism, settle, shared_dir, tidied
from .components import components

SEGMENTS, RADIUS, BITS = 8, 3, 64
#: Above so many fingerprints a bucket is cut into smaller ones first.
LARGE = 4096


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    ws = ascii_lower_words(text)
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = list(accumulate(len(w) + 1 for w in ws))
    starts = [0, *ends[:-1]]
    n = max(1, len(ws) - words + 1)
    last = ends[words - 1 :] or ends[-1:]
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts[:n], last, strict=True)]))


def majority(hashes: bytes) -> int:
    """The bits that are set in over half of some 64-bit hashes (big-endian)."""
    step, count = 8 * 65_536, np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), step):
        count += np.unpackbits(np.frombuffer(hashes[at : at + step], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes) // 8).tobytes(), "big")


def budgets(radius: int = RADIUS) -> list[int]:
    """The differences that a chain of 1, 2, ... segments may have."""
    return [length * radius // SEGMENTS for length in range(1, SEGMENTS + 1)]


def chain(start: int) -> np.ndarray:
    """The masks of the first 1, 2, ... segments of the ring from a start on."""
    size, bits, out = BITS // SEGMENTS, 0, []
    for i in range(SEGMENTS):
        bits |= ((1 << size) - 1) << (start + i) % SEGMENTS * size
        out.append(bits)
    return np.array(out, np.uint64)


def patterns() -> list[tuple[int, int]]:
    """(mask, start): the bits that a bucket's fingerprints share, which are their chain's agreeing segments, and where it starts."""
    budget = budgets()
    clean = budget.index(1)  # segments at the chain's start without a difference
    reach = max(i for i, b in enumerate(budget) if b == 1) + 1
    out = []
    for start in range(SEGMENTS):
        upto = chain(start)
        for agree in combinations(range(clean, reach), reach - clean - 1):
            out.append((int(upto[clean - 1] | np.bitwise_or.reduce([upto[i] ^ upto[i - 1] for i in agree])), start))
    return out


def on_chain(differences: np.ndarray, start: int, radius: int = RADIUS) -> np.ndarray:
    """Which differences stay within the budgets of every chain from a start, short chains first; the whole ring is the last."""
    keep = np.ones(len(differences), bool)
    for upto, budget in zip(chain(start), budgets(radius), strict=True):
        at = np.flatnonzero(keep)
        keep[at] = np.bitwise_count(differences[at] & upto) <= budget
    return keep


def near(x: np.uint64, others: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of others lie within radius of x, by the chains from any start: one stays within its budgets just if they do."""
    differences = others ^ x
    out = np.zeros(len(others), bool)
    for start in range(SEGMENTS):
        at = np.flatnonzero(~out)
        out[at] = on_chain(differences[at], start, radius)
    return out


def links(prints: np.ndarray, mask: int, start: int, at: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of places in prints (distinct, equal under mask) within RADIUS, which connect all whose chain from start is within its budgets.

    What is taken out of the rest is compared with what is left of it only, so a tight group costs its size
    times a few.  A large bucket is cut by pigeonhole: of the RADIUS + 1 parts of the bits that mask leaves
    free, one agrees.
    """
    at = np.arange(len(prints)) if at is None else at
    free = [b for b in range(BITS) if not mask >> b & 1]
    if len(at) > LARGE and len(free) > RADIUS + 1:
        out = []
        for part in np.array_split(np.array(free), RADIUS + 1):
            own = sum(1 << int(b) for b in part)
            order = at[np.argsort(prints[at] & np.uint64(own), kind="stable")]
            cuts = np.flatnonzero(np.diff(prints[order] & np.uint64(own))) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    out += links(prints, mask | own, start, group)
        return out
    out, rest = [], at.copy()
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            close = on_chain(prints[rest] ^ prints[x], start)
            if close.any():
                found = rest[close].tolist()
                rest = rest[~close]
                out += [(x, y) for y in found]
                queue += found
    return out


@dataclass(frozen=True)
class SimHash:
    """words: of a shingle.  similarity: keep_one() takes texts for copies from this Jaccard similarity on, and not by their bits."""

    words: int = 3
    similarity: float | None = None

    def fingerprints(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id (NULL_ID for null), node (a hash that tells texts apart) and print (the fingerprint as a signed long) of every row."""
        words = self.words

        def run(batches):
            for b in batches:
                prints = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.int64())], ["doc_id", "node", "print"])

        return keyed(docs, doc_id, text).mapInArrow(tidied(run), "doc_id long, node long, print long")

    def link(self, distinct: DataFrame) -> DataFrame:
        """distinct: print.  a, b: links between prints that connect all within RADIUS."""
        chains = patterns()

        def spread(batches):
            m = np.array([mask for mask, _ in chains], np.uint64)
            for b in batches:
                prints = b.column(0).to_numpy().astype(np.uint64)
                keys = (prints[:, None] & m).reshape(-1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(m), dtype=np.int16), len(prints))), pa.array(keys), pa.array(np.repeat(prints, len(m)).astype(np.int64))], ["pattern", "bucket", "print"])

        def search(batches):
            """Buckets come one after another; one may go on in the next batch."""
            held: list[np.ndarray] = []

            def found(pattern, prints):
                return [(prints[x], prints[y]) for x, y in links(prints.astype(np.uint64), *chains[pattern])]

            for b in batches:
                new = [c.to_numpy() for c in b.columns]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
                ends = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
                last = ends[-1] if len(ends) else 0
                yield _edges(found, [x[:last] for x in held], ends[:-1])
                held = [x[last:] for x in held]
            if held:
                yield _edges(found, held, np.zeros(0, int))

        n = parallelism(distinct.sparkSession)
        dealt = distinct.select("print").mapInArrow(tidied(spread), "pattern short, bucket long, print long").repartition(n, "pattern", "bucket").sortWithinPartitions("pattern", "bucket")
        return dealt.mapInArrow(tidied(search), "a long, b long").distinct()

    def _grouped(self, docs: DataFrame, folder: str, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
        """fingerprints() of docs; and print, n (its rows), least (doc_id, print and node of its component's smallest document)."""
        spark = docs.sparkSession
        prints = settle(self.fingerprints(docs, doc_id, text), folder, "prints")
        distinct = settle(prints.groupBy("print").agg(F.min(F.struct("doc_id", "node")).alias("own"), F.count("*").alias("n")), folder, "distinct")
        linked = components(self.link(distinct), folder)
        own = F.struct("own.doc_id", "print", "own.node").alias("own")
        labels = settle(distinct.join(linked, F.col("print") == F.col("node"), "left").select("print", own, "n", F.coalesce("component", "print").alias("label")), folder, "labels")
        least = settle(labels.groupBy("label").agg(F.min("own").alias("least"), F.count("*").alias("m")), folder, "least")
        out = settle(join_spread(labels, least, "label", "m").select("print", "n", "least"), folder, "of_print")
        discard(spark, folder, "distinct", "labels", "least")
        return prints, out

    def groups(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, fingerprint, component_id of every row of docs."""
        prints, of_print = self._grouped(docs, shared_dir(docs.sparkSession), doc_id, text)
        return join_spread(prints, of_print, "print", "n").select(
            F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.nullif("least.doc_id", F.lit(NULL_ID)).alias("component_id"),
        )

    def keep_one(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """docs with one row of each group, of the smallest doc_id; the columns are the same.

        Of several texts under that id in the group, the one of the smallest fingerprint (or hash) stays.
        """
        folder = shared_dir(docs.sparkSession)
        if self.similarity is not None:
            from .near_copies import keepers

            return rows_of(docs, keepers(self, docs, folder, doc_id, text), doc_id, text)
        prints, of_print = self._grouped(docs, folder, doc_id, text)
        kept = of_print.where(F.col("print") == F.col("least.print")).select("least.doc_id", "least.node")
        kept = settle(prints.join(kept, ["doc_id", "node"]).groupBy("doc_id", "node").agg(F.count("*").alias("n")), folder, "kept")
        discard(docs.sparkSession, folder, "prints", "of_print")
        return rows_of(docs, kept, doc_id, text)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id (NULL_ID for null), node (a hash of the text, null as empty), text."""
    return docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("node"), docs[text].alias("text"))


def rows_of(docs: DataFrame, kept: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of docs for each doc_id and node of kept, with the columns of docs.  n: how many rows have both."""
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("node"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    one = rows.join(kept.where("n = 1").select("doc_id", "node"), ["doc_id", "node"], "left_semi")
    # Copies under one id: partial aggregation takes any of them, and no task gathers all.
    more = rows.join(kept.where("n > 1").select("doc_id", "node"), ["doc_id", "node"], "left_semi").groupBy("doc_id", "node").agg(F.first("row").alias("row"))
    return one.select("row.*").unionByName(more.select("row.*"))


def _edges(found, columns, ends):
    a, b = [], []
    bounds = [0, *ends.tolist(), len(columns[0])]
    for start, end in zip(bounds, bounds[1:], strict=False):
        if end - start > 1:
            for x, y in found(int(columns[0][start]), columns[2][start:end]):
                a.append(x)
                b.append(y)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
