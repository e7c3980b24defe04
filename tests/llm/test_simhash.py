import random
import re

import numpy as np
import xxhash

from tallybrook.llm import simhash
from tallybrook.llm.simhash import SimHash

SCHEMA = "doc_id long, text string, print int, component string"


def plain(text, k=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(pairs):
    """pairs: id, fingerprint.  id -> smallest id reachable."""
    group = {i: i for i, _ in pairs}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, x in pairs:
        for b, y in pairs:
            if a < b and (x ^ y).bit_count() <= 3:
                p, q = sorted((find(a), find(b)))
                group[q] = p
    return {i: find(i) for i, _ in pairs}


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 50, 3000):
        t = "".join(rng.choice(["Ab", "É", "c", "\x1c"]) + rng.choice([" ", "\n", "\t ", " \x0b"]) for _ in range(n))
        assert simhash.fingerprint(t) == plain(t)
    assert simhash.fingerprint(None) == 0


def test_links_connect_exactly_what_is_near(monkeypatch):
    rng = np.random.default_rng(2)
    for large in (4096, 5):
        monkeypatch.setattr(simhash, "LARGE", large)
        base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
        xs = np.unique(np.concatenate([base, *[base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))) for _ in range(25)]]))
        group = {i: i for i in range(len(xs))}
        for a, b in [x for start in range(simhash.SEGMENTS) for x in simhash.links(xs, 0, start)]:
            assert int(xs[a] ^ xs[b]).bit_count() <= 3
            p, q = group[a], group[b]
            group = {k: p if v == q else v for k, v in group.items()}
        want = brute(list(enumerate(xs.tolist())))
        assert len(set(group.values())) == len(set(want.values())) and all((group[a] == group[b]) == (want[a] == want[b]) for a in group for b in group)


def test_every_near_pair_shares_a_bucket():
    rng = random.Random(3)
    masks = simhash.patterns()
    assert len(masks) == 24 and all(m.bit_count() == 32 for m, _ in masks)
    for _ in range(20_000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        # A bucket holds the pair, and the chain from that bucket's start stays within its budgets.
        assert any(d & m == 0 and simhash.on_chain(np.array([d], np.uint64), start)[0] for m, start in masks)


def test_chains_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    far = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(0, 40, 20_000)], np.uint64)
    for radius in (3, 24):
        within = np.bitwise_count(far) <= radius
        some = [simhash.on_chain(far, start, radius) for start in range(simhash.SEGMENTS)]
        assert (np.any(some, axis=0) == within).all() and (simhash.near(np.uint64(0), far, radius) == within).all()
        # What one chain prunes before the whole ring is looked at: most of what is too far.
        upto = simhash.chain(0)[:-1]
        left = np.all([np.bitwise_count(far & m) <= b for m, b in zip(upto, simhash.budgets(radius), strict=False)], axis=0)
        assert (left & ~within).sum() < 0.2 * (~within).sum()


def test_groups_against_brute_force(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(40)]
    rows = []
    for i in range(150):
        t = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 60, 200]))]
        rows.append((i, " ".join(t)))
        for j in range(rng.randint(0, 2)):
            u = list(t)
            u[rng.randrange(len(u))] = "new"
            rows.append((1000 + 3 * i + j, " ".join(u)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "x " * 100_000), (5004, "x " * 100_000), (7, rows[0][1])]
    got = SimHash().groups(spark.createDataFrame([(i, t, 1, "c") for i, t in rows], SCHEMA)).collect()
    flat = [(k, plain(t)) for k, (_, t) in enumerate(rows)]
    by_place = {}
    place_groups = brute([(k, f) for k, f in flat])
    for k, g in place_groups.items():
        by_place.setdefault(g, []).append(rows[k][0])
    want = sorted((rows[k][0], f"{f:016x}", min(by_place[place_groups[k]])) for k, f in flat)
    assert sorted(map(tuple, got)) == want


def test_null_id_and_empty(spark):
    rows = spark.createDataFrame([(None, "a b c d", 1, "c"), (4, "a b c d", 1, "c"), (5, "q", 1, "c")], SCHEMA)
    assert sorted(map(tuple, SimHash().groups(rows).select("doc_id", "component_id").collect()), key=str) == sorted([(None, None), (4, None), (5, 5)], key=str)
    assert SimHash().groups(rows.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Rows that share an id with other texts are no copies; columns of any name pass through."""
    x, y = "a b c d e f", "quite another text"
    rows = [(1, x, 1, "c"), (2, x, 2, "c"), (2, y, 3, "c"), (5, x, 4, None), (None, "q", 5, "c"), (7, "q", 6, "c"), (2, y, 3, "c")]
    d = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"print": "row", "component": "tallybrook_id"})
    out = SimHash().keep_one(d)
    assert out.columns == d.columns and sorted(map(tuple, out.collect()), key=str) == sorted([(1, x, 1, "c"), (2, y, 3, "c"), (None, "q", 5, "c")], key=str)
    got = {(r.doc_id, r.component_id) for r in SimHash().groups(d.select("doc_id", "text")).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (5, 1), (None, None), (7, None)}


def test_a_hub(spark):
    """A node with most of the links gathers in no task, and components are whole."""
    from tallybrook.llm.components import components

    links = [(0, i) for i in range(1, 2000)] + [(i, 5000 + i) for i in range(0, 2000, 7)] + [(9000, 9001), (9001, 9002)]
    folder = spark.conf.get("spark.checkpoint.dir") + "/hub"
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), folder).collect()}
    assert got == {n: 9000 if n >= 9000 else 0 for pair in links for n in pair}
