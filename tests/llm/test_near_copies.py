import random
import re

import corpus_pipeline
import numpy as np

from tallybrook.llm import near_copies
from tallybrook.llm.simhash import SimHash

SCHEMA = "doc_id long, text string"


def plain(text, k=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} or {tuple(ws)}


def brute(rows):
    """rows: id, text.  The ids that stay."""
    sets, group = [plain(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                p, q = group[a], group[b]
                group = [q if g == p else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def copies():
    rng, rows = random.Random(21), []
    for i in range(60):
        t = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([3, 8, 60, 150, 400]))]
        rows.append((10 * i, " ".join(t)))
        for j in range(1, rng.randint(1, 6)):
            u = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 35))):  # about 0.8 at most edits
                u[rng.randrange(len(u))] = f"n{rng.randrange(10**6)}"
            rows.append((10 * i + j, " ".join(u)))
    rng.shuffle(rows)
    return [*rows, (9000, None), (9001, ""), (9002, " \n"), (9003, "x " * 50_000), (9004, "x " * 50_000)]


def test_stage_against_brute_force(spark):
    """SimHash's three bits leave most of these copies."""
    rows = copies()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == brute(rows) and all((r.doc_id, r.text) in rows for r in kept)


def test_groups_of_many_parts(spark, monkeypatch):
    """Parts of few shingles and buckets of many nodes: a group goes through leaders and pairs of parts, with the same result."""
    monkeypatch.setattr(near_copies, "PART", 300)
    monkeypatch.setattr(near_copies, "MANY", 20)
    rng, rows = random.Random(33), []
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    for i in range(160):  # one group by chains of copies: later ones are none of the first
        if i % 4 == 0:
            base[rng.randrange(60)] = f"n{i}"
        u = list(base)
        u[rng.randrange(60)] = f"m{i}"
        rows.append((i, " ".join(u)))
    rows += copies()[:80]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    rng.shuffle(rows)
    kept = SimHash(words=5, similarity=0.8).keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == brute(rows)


def test_pairs_at_the_threshold_share_a_bucket():
    rng = np.random.default_rng(22)
    for n in [9] * 500 + [90] * 500 + [1800] * 100:
        h = np.unique(rng.integers(0, 1 << 63, 10 * n // 9 + 1, dtype=np.uint64))[: 10 * n // 9]
        assert (near_copies.buckets(h[:n]) == near_copies.buckets(h[n // 9 :])).any()  # 8/9 n of 10/9 n


def test_ids_that_repeat_with_other_texts(spark):
    x, y = "a clean text of seven words here", "quite another text that nobody else has"
    kept = SimHash(words=5, similarity=0.8).keep_one(spark.createDataFrame([(5, x), (8, x), (5, y), (3, y), (None, "q"), (1, "q"), (3, y)], SCHEMA)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, x), (3, y), (None, "q")], key=str)


def test_empty(spark):
    assert SimHash(words=5, similarity=0.8).keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
