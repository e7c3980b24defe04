import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import vectors
from tallybrook.llm.vectors import Quantiser, approximate_top_k, exact_top_k, term_at_a_time

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def made(n, d=16, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.random((n, d)) < 0.3] = 0
    if copies:
        x[-copies:] = x[0] + rng.normal(size=(copies, d)).astype(np.float32) * 1e-3
    return x


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA)


ODD = [(None, [0.5] * 16), (901, None), (902, [None] + [0.1] * 15), (903, [float("nan")] * 16), (904, [float("inf")] + [0.0] * 15), (905, []), (906, [0.25] * 3), (20, [0.0] * 16)]


def rows_of(x):
    return [(i, [float(a) for a in v]) for i, v in enumerate(x)]


def usable(rows, zeros):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(a is not None and math.isfinite(a) for a in v) and (zeros or any(v)):
            best[i] = max(best.get(i, v), v)
    return best


def brute_exact(rows, every, k):
    v, out = {i: [math.floor(64 * float(np.float32(a))) for a in x] for i, x in usable(rows, True).items()}, []
    for q in v:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q)[:k]
            out += [(q, r, c, -n) for r, (n, c) in enumerate(s, 1)]
    return sorted(out)


def test_exact_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", 50)
    monkeypatch.setattr(vectors, "TILE", 4)
    x = made(130)
    x[60:90] = x[7]  # ties
    rows = rows_of(x) + ODD
    got = exact_top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 5)
    assert sorted(map(tuple, got.collect())) == brute_exact(rows, 20, 5)


@pytest.mark.parametrize("scale", [64.0, 1e5, 1e9])
def test_number_types(scale):
    x = made(40, seed=3).astype(float)
    q, c, s = term_at_a_time(x[:5], np.arange(5), x, np.arange(40), 3, scale)
    w = np.vectorize(int, otypes=[object])(np.floor(scale * x.astype(float)))
    for a, b, n in zip(q, c, s, strict=True):
        assert n == int((w[a] * w[b]).sum())


def test_few_rows(spark):
    rows = rows_of(made(3))
    assert sorted(map(tuple, exact_top_k(frame(spark, rows), F.col("vec_id") == 0).collect())) == brute_exact(rows, 100, 20)
    empty = frame(spark, rows).limit(0)
    for f in (exact_top_k, approximate_top_k):
        assert f(empty, F.col("vec_id") == 0).count() == 0
        assert f(frame(spark, rows[:1]), F.col("vec_id") == 0).count() == 0


def test_loss_weighs_the_parallel_part():
    x = made(3000, 32, 5).astype(float)
    x = vectors._unit(x[(x != 0).any(axis=1)])[0]
    plain, aware = Quantiser.fit(x, threshold=0.0), Quantiser.fit(x, threshold=0.5)

    def parallel(z):
        p = z._pairs(x)
        return np.abs(((p - z._decoded(z.codes(x))) * p).sum(axis=(1, 2))).mean()

    assert plain.parallel == 1 and aware.parallel > 1 and parallel(aware) < 0.7 * parallel(plain)
    codes, q = aware.codes(x), x[:7]
    near = vectors.scan(aware.tables(q), aware.pack(codes))
    assert np.allclose(near, np.einsum("qmd,nmd->qn", aware._pairs(q), aware._decoded(codes)), atol=1e-5)


@pytest.mark.parametrize("copies", [0, 700])
def test_recall(spark, copies):
    x = made(2000, 64, 6, copies)
    rows = rows_of(x) + [(i, v) for i, v in ODD if i != 20]
    got = {}
    for q, r, c, s in approximate_top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(q, []).append((c, s))
    v = {i: np.pad(np.array(a, np.float32).astype(float), (0, 64 - len(a))) for i, a in usable(rows, False).items()}
    ids, found, total = np.array(sorted(v)), 0, 0
    m = np.stack([v[i] for i in ids])
    norm = np.linalg.norm(m, axis=1)
    for q in [i for i in v if i % 50 == 0]:
        s = m @ v[q] / norm / np.linalg.norm(v[q])
        s[ids == q] = -2
        want = ids[np.lexsort((ids, -s))[:5]]
        found += len({c for c, _ in got[q]} & set(want.tolist()))
        total += 5
        assert all(abs(n - s[np.searchsorted(ids, c)]) < 1e-12 for c, n in got[q]) and [n for _, n in got[q]] == sorted((n for _, n in got[q]), reverse=True)
    assert found / total >= 0.99


def test_exact_beyond_31_bits():
    import numpy as np

    from tallybrook.llm.vectors import term_at_a_time

    for big in (2.0**27, 2.0**40):
        q, c = np.array([[big, 1.0]]), np.array([[3.0, 1.0], [5.0, 2.0], [-1.0, 0.0]])
        got = sorted(term_at_a_time(q, np.array([9]), c, np.arange(3), 3, 64.0)[2].tolist(), reverse=True)
        assert got == [4096 * (int(big) * 5 + 2), 4096 * (int(big) * 3 + 1), -4096 * int(big)]
    q, c = np.array([[2.0**53, 0.0]]), np.array([[0.015625, 2.0**20]])  # bound beyond 64 bits, the score not
    assert term_at_a_time(q, np.array([9]), c, np.arange(1), 1, 64.0)[2].tolist() == [2**59]


def test_cosines_of_huge_and_tiny_vectors(spark):
    rows = [(0, [1e-200, 1e-200]), (50, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [3e-310, 0.0]), (3, [-1e300, 1e-300]), (4, [1.0, 2.0])]
    got = {}
    for q, r, c, s in approximate_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(q, []).append((c, round(s, 9)))
    half, third = round(math.sqrt(0.5), 9), round(3 / math.sqrt(10), 9)
    assert got == {0: [(1, 1.0), (4, third), (2, half), (50, half), (3, -half)], 50: [(2, 1.0), (0, half), (1, half), (4, round(1 / math.sqrt(5), 9)), (3, -1.0)]}


def test_exact_large_and_small_components(spark):
    rows = [(0, [2.0**26, 1.0]), (1, [1 / 64, 0.0]), (2, [1 / 128, 0.5]), (3, [0.0, 0.0])]
    got = [(r.vec_id, r.score) for r in exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2**32), (2, 64 * 32), (3, 0)]
