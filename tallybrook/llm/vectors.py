"""Searches over vectors: exact top-k by inner product (operator 4), approximate by cosine (operator 5).

Both search a stated query set against all rows in blocks.  Candidates are dealt into groups by a hash of
their id, queries into tiles of at most TILE; a task holds one group and one tile, and gives each query's best
of the group, which are then merged by query.  Memory is bounded by the sizes of a group and a tile.  Each candidate is
sent once for each tile of queries: with a fixed share of the rows as queries that is quadratic, as the contract's
work is; more queries a tile trade memory for it.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part, nor do null ids;
shorter vectors count as padded with zeros; rows that share a vec_id are one row (the largest of their
vectors), in the SQL too; ties go to the smaller vec_id; a query's own row is no candidate of it; with fewer candidates
than k, all are returned; components of any finite size count, and an integer score beyond 64 bits is an error; an
empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, settle, shared_dir, tidied

#: Candidates in a group, and queries in a tile, about.
GROUP, TILE = 16_384, 4_096


def sound(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine)
    return d.groupBy("vec_id").agg(F.max("vector").alias("vector"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column's rows, padded with zeros."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, offsets = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64), c.offsets.to_numpy()
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    for i, (n, at) in enumerate(zip(sizes.tolist(), (offsets - offsets[0]).tolist(), strict=False)):
        out[i, :n] = values[at : at + n]
    return out


def in_blocks(rows: DataFrame, is_query: Column, search: Callable, k: int, score: str, size: Callable[[DataFrame], tuple[int, int, int]] | None = None) -> DataFrame:
    """search(queries, their ids, candidates, their ids, candidates' table) gives (query places, candidate places, scores)."""
    n, asked, width = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("vector"))).first()
    width = width or 0
    groups, tiles = max(1, -(-n // GROUP), min(parallelism(rows.sparkSession), -(-n // 1024))), max(1, -(-asked // TILE))
    deal = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("*", deal(1, groups).alias("group"), every(tiles).alias("tile"))
    queries = rows.where(is_query).select("vec_id", "vector", deal(2, tiles).alias("tile"), every(groups).alias("group"))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        order = np.argsort(c.column("vec_id").to_numpy(), kind="stable")
        c = c.take(pa.array(order))
        qi, ci = q.column("vec_id").to_numpy(), c.column("vec_id").to_numpy()
        a, b, s = search(_matrix(q.column("vector"), width), qi, _matrix(c.column("vector"), width), ci, c) if len(qi) and len(ci) else ([], [], [])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"query_id": pa.array(qi[a], pa.int64()), "vec_id": pa.array(ci[b], pa.int64()), "score": pa.array(s, pa.int64() if score == "long" else pa.float64())})

    best = queries.groupBy("group", "tile").cogroup(candidates.groupBy("group", "tile")).applyInArrow(run, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# Exact top-k


def term_at_a_time(queries: np.ndarray, qi: np.ndarray, candidates: np.ndarray, ci: np.ndarray, k: int, scale: float, tile: int = 16) -> tuple:
    """Inner products of whole-number vectors, by exhaustive term-at-a-time accumulation.

    Each component is a term with a posting list: the candidates where it isn't zero, and their weights.
    A query's terms scatter their weighted postings into its dense array of scores; a list that
    holds most candidates is kept as a plain array of weights, and scatters by adding all of it.
    ci must ascend.  Weights of any size are exact; a score beyond 64 bits is an OverflowError.
    """
    q, c = (np.floor(scale * x) for x in (queries, candidates))
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    # Whole numbers are exact in float32 below 2**24, in float64 below 2**53.
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    q, c = (np.frompyfunc(int, 1, 1)(x) if kind is object else x.astype(kind) for x in (q, c))
    postings = []
    for j in range(c.shape[1]):
        ids = np.flatnonzero(c[:, j])
        dense = len(ids) * 2 > len(c)
        postings.append((None if dense else ids, np.ascontiguousarray(c[:, j]) if dense else c[ids, j]))
    n, last = len(ci), min(k, len(ci))
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(q), tile):
        rows = q[at : at + tile]
        scores, part = np.zeros((len(rows), n), kind), np.empty((len(rows), n), kind)
        for j, (ids, weights) in enumerate(postings):
            used = np.flatnonzero(rows[:, j])
            if not len(used) or not len(weights):
                continue
            if ids is None and len(used) == len(rows):
                np.multiply.outer(rows[:, j], weights, out=part)
                scores += part
            elif ids is None:
                scores[used] += np.multiply.outer(rows[used, j], weights)
            else:
                scores[np.ix_(used, ids)] += np.multiply.outer(rows[used, j], weights)
        own = np.searchsorted(ci, qi[at : at + tile])
        mine = (own < n) & (ci[np.minimum(own, n - 1)] == qi[at : at + tile])
        scores[np.flatnonzero(mine), own[mine]] = 0  # takes no part, so its size doesn't matter
        for i, row in enumerate(scores.astype(np.int64)):
            keep = np.ones(n, bool)
            if mine[i]:
                keep[own[i]] = False
            places = _best(row, keep, last)
            out_q.append(np.full(len(places), at + i))
            out_c.append(places)
            out_s.append(row[places])
    return tuple(np.concatenate(x) for x in (out_q, out_c, out_s))


def _best(scores: np.ndarray, keep: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest kept scores (ties: lower places), by partition selection."""
    places = np.flatnonzero(keep)
    s = scores[places]
    if len(places) > k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        above, level = np.flatnonzero(s > edge), np.flatnonzero(s == edge)
        places = places[np.concatenate((above, level[: k - len(above)]))]
    return places


def exact_top_k(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products of floor(scale * x)."""
    rows = settle(sound(df, vec_id, vector), shared_dir(df.sparkSession), "vectors")
    return in_blocks(rows, is_query, lambda q, qi, c, ci, _: term_at_a_time(q, qi, c, ci, k, scale), k, "long")


# Approximate nearest neighbours


@dataclass
class Quantiser:
    """Four-bit product codes of unit vectors with a score-aware loss.

    The part of a residual along its vector changes the scores of just those queries that lie near the
    vector, so it costs `parallel` times what the rest costs.  centres: (subspaces, 16, 2).
    """

    centres: np.ndarray
    parallel: float
    error: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> "Quantiser":
        """x: unit vectors.  threshold: the cosine from which scores matter."""
        width = x.shape[1]
        p = cls._pairs(x)
        rng = np.random.default_rng(seed)
        centres = np.stack([p[rng.choice(len(p), 16, replace=len(p) < 16), m] for m in range(p.shape[1])]) if len(p) else np.zeros((p.shape[1], 16, 2))
        out = cls(centres, max(1.0, (width - 1) * threshold**2 / (1 - threshold**2)))
        for _ in range(rounds if len(p) else 0):
            codes = out.codes(x)
            residual = p - out._decoded(codes)
            along = (residual * p).sum(axis=2)
            total = along.sum(axis=1)
            for m in range(p.shape[1]):
                own, weight = p[:, m], out.parallel - 1
                rest = total - along[:, m]
                outer = own[:, :, None] * own[:, None, :]
                for c in range(16):
                    at = codes[:, m] == c
                    if at.any():
                        left = at.sum() * np.eye(2) + weight * outer[at].sum(axis=0)
                        right = (own[at] * (1 + weight * (rest[at] + (own[at] ** 2).sum(axis=1)))[:, None]).sum(axis=0)
                        out.centres[m, c] = np.linalg.solve(left + 1e-9 * np.eye(2), right)
        if len(p):
            out.error = float(np.sqrt(((p - out._decoded(out.codes(x))) ** 2).sum(axis=(1, 2)).mean() / max(width, 1)))
        return out

    @staticmethod
    def _pairs(x: np.ndarray) -> np.ndarray:
        """(rows, subspaces, 2); an even number of subspaces, so that two codes fill a byte."""
        width = -(-max(x.shape[1], 1) // 4) * 4
        return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, 2)

    def _decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(codes.shape[1]), codes]

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """(rows, subspaces): nearest centres first, then each in turn by the whole loss."""
        p = self._pairs(x)
        residual = p[:, :, None, :] - self.centres[None]
        square, along = (residual**2).sum(axis=3), (residual * p[:, :, None, :]).sum(axis=3)
        codes = square.argmin(axis=2)
        rows = np.arange(len(p))
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for m in range(p.shape[1]):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (square[:, m] + (self.parallel - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[rows, m, codes[:, m]]
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries): what each byte of a code adds to each query's score."""
        one = np.einsum("qmd,mcd->mcq", self._pairs(queries), self.centres).astype(np.float32)
        return (one[0::2, :, None] + one[1::2, None, :]).reshape(len(one) // 2, 256, -1)


def scan(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(queries, rows): the approximate scores, from table look-ups only."""
    out = tables[0][packed[:, 0]]
    for b in range(1, len(tables)):
        out += tables[b][packed[:, b]]
    return np.ascontiguousarray(out.T)


#: Rows that the quantiser is fitted on, at most: the first by a hash of the id.  Every row is indexed.
SAMPLE = 8_192
#: Errors of an approximate score (in typical ones) that reranking allows for.
MARGIN = 4.0


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows at length one; and the rows times a power of two that brings their largest component near one, with their lengths.

    Cosines are the same for the scaled rows, to the bit where nothing over- or underflows, and right where it would.
    """
    scaled = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled / norm[:, None], scaled, norm


def approximate_top_k(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine; zero vectors take no part.

    Every candidate is scanned by its code.  The best by code are reranked on the vectors themselves, and then
    everything whose code could still bring it among them, MARGIN errors allowed: however many near-equal
    vectors there are, none is cut off by a fixed depth.
    """
    folder = shared_dir(df.sparkSession)
    rows = settle(sound(df, vec_id, vector).where(F.exists("vector", lambda x: x != 0)), folder, "vectors")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    sample = rows.orderBy(F.xxhash64(F.lit("fit"), "vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    fitted = Quantiser.fit(_unit(_matrix(sample.column("vector"), width))[0]) if len(sample) else Quantiser(np.zeros((2, 16, 2)), 1.0)
    shared = df.sparkSession.sparkContext.broadcast(fitted)

    def index(batches):
        for b in batches:
            x = _matrix(b.column(1), width)
            packed = shared.value.pack(shared.value.codes(_unit(x)[0])) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in packed], pa.binary())], ["vec_id", "vector", "code"])

    def search(q, qi, c, ci, table, tile=16):
        (qu, q, qn), (_, c, cn) = _unit(q), _unit(c)
        packed = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(c), -1)
        slack = MARGIN * shared.value.error + 1e-6
        out_q, out_c, out_s = [], [], []
        for at in range(0, len(q), tile):
            near = scan(shared.value.tables(qu[at : at + tile]), packed)
            for i, row in enumerate(near):
                row[ci == qi[at + i]] = -np.inf
                first = np.argpartition(row, max(0, len(row) - 8 * k - 1))[-8 * k :] if len(row) > 8 * k else np.arange(len(row))
                exact = (c[first] * q[at + i]).sum(axis=1) / (qn[at + i] * cn[first])
                exact[row[first] == -np.inf] = -np.inf
                least = np.sort(exact)[-k] if len(exact) >= k else -np.inf
                places = np.flatnonzero((row >= least - slack) & (row > -np.inf))
                scores = (c[places] * q[at + i]).sum(axis=1) / (qn[at + i] * cn[places])
                best = np.lexsort((places, -scores))[:k]
                out_q.append(np.full(len(best), at + i))
                out_c.append(places[best])
                out_s.append(scores[best])
        return tuple(np.concatenate(x) for x in (out_q, out_c, out_s))

    indexed = settle(rows.mapInArrow(tidied(index), "vec_id long, vector array<double>, code binary"), folder, "index")
    return in_blocks(indexed, is_query, search, k, "double")
