import hashlib
import random
from collections import defaultdict

import numpy as np

from tallybrook.llm.cuckoo import Cuckoo
from tallybrook.llm.lines import LineDedup, LineIndex

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, key string, shard int"


def brute(rows, min_chars=40, min_docs=5):
    def key(line):
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))
        return k if len(k) >= min_chars else None

    low = lambda i: -1 if i is None else i
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line) is not None:
                holders[key(line)].add(low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := key(x)) is None or len(holders[k]) < min_docs or max(holders[k]) == low(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def corpus(n, seed=0):
    rng = random.Random(seed)
    pool = ["  Shared Line number %d with quite some characters É%s" % (k, "x" * (k % 5)) for k in range(12)]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own {i} {rng.random()}" for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.1 else x + " \t" * rng.randint(0, 1) for x in lines)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 3) for i, t in rows], SCHEMA)


def test_filter_has_no_false_negatives_and_forgets():
    rng = np.random.default_rng(1)
    keys = [rng.bytes(16) for _ in range(5000)]
    f = Cuckoo(100)
    f.insert(keys)
    assert len(f) == 5000 and f.contains(keys).all() and len(f.segments) > 1
    assert Cuckoo.load(f.dump()).contains(keys).all()
    f.remove(keys[:4000])
    assert len(f) == 1000 and f.contains(keys[4000:]).all()
    assert f.contains(keys[:4000]).mean() < 0.01


def test_report_and_apply(spark):
    long_line = "Z" * 200_000
    rows = corpus(60) + [(None, "a" * 40), (100, None), (101, ""), (102, "\n\n"), (3, corpus(60)[3][1]), (7, "a" * 39)]
    rows += [(200 + i, "A" * 40 + "\n" + "a" * 40 + "\n" + long_line) for i in range(5)]
    want = brute(rows)
    got = LineDedup().report(frame(spark, rows)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(i), n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want)
    out = LineDedup().apply(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "key", "shard"]
    assert sorted((str(r[0]), r[1] or "") for r in out.collect()) == sorted((str(i), t) for i, _, _, t in want)


def test_empty(spark):
    assert LineDedup().report(frame(spark, [])).count() == 0


def test_index_is_reversible(spark):
    rule = LineDedup(min_docs=3, shards=4)
    rows = corpus(40, 5)
    texts = dict(rows)
    index = LineIndex(spark, rule)
    index.insert(frame(spark, rows[:25]))
    index.insert(frame(spark, rows[20:]))
    index.delete(spark.createDataFrame([(i,) for i in range(10, 40, 3)], "doc_id long"))
    left = [r for r in rows if r[0] not in set(range(10, 40, 3))]
    got = {r[0]: set(map(bytes, r[1])) for r in index.drops().collect()}
    want = {}
    from tallybrook.llm.lines import line_key

    for i, n, d, kept in brute(left, min_docs=3):
        if d:
            want[i] = {line_key(x, 40) for x in texts[i].split("\n")} - {line_key(x, 40) for x in kept.split("\n")}
    assert got == want
    counts = {bytes(r.key): (r.n_docs, r.keeper) for r in index.counts.collect()}
    fresh = {bytes(r.key): (r.n_docs, r.keeper) for r in rule.counts(rule.keys(frame(spark, left))).collect()}
    assert counts == fresh
    index.delete(spark.createDataFrame([(i,) for i in range(60)], "doc_id long"))
    assert index.counts.count() == 0 and sum(len(Cuckoo.load(bytes(r["filter"]))) for r in index.filters.collect()) == 0


def test_other_shards_are_left_alone(spark):
    index = LineIndex(spark, LineDedup(min_docs=2, shards=64))
    index.insert(frame(spark, [(i, "\n".join(f"a line of its own with many characters {i // 2} {k}" for k in range(9))) for i in range(10)]))
    before = {name: {s: list(p) for s, p in all_.items()} for name, all_ in index.places.items()}
    assert len(before["counts"]) > 20
    line = "a line of its own with many characters 2 3"
    for step, change in enumerate((lambda: index.insert(frame(spark, [(50, line)])), lambda: index.delete(spark.createDataFrame([(50,)], "doc_id long")))):
        change()
        for name, all_ in index.places.items():
            other = {s for s in all_ if all_[s] != before[name].get(s)}
            assert len(other) <= 1, (step, name)
        before = {name: {s: list(p) for s, p in all_.items()} for name, all_ in index.places.items()}
    assert {r.n_docs for r in index.counts.collect()} == {2}


def test_names_that_clash_and_many_shards(spark):
    rows = corpus(60)
    names = ["doc_id", "text", "lost", "row", "tallybrook_id", "tallybrook_drop", "key"]
    d = spark.createDataFrame([(i, t, "l", "r", 1, [b"k"], b"k") for i, t in rows], "doc_id long, text string, lost string, row string, tallybrook_id int, tallybrook_drop array<binary>, key binary")
    out = LineDedup(shards=1000).apply(d)
    assert out.columns == names and sorted(tuple(r)[:4] for r in out.collect()) == sorted((i, t, "l", "r") for i, _, _, t in brute(rows))
    many = LineDedup(shards=1024).keys(frame(spark, [(i, f"a line of its own with quite many characters {i}") for i in range(3000)]))
    assert many.agg({"shard": "max"}).first()[0] > 900


def test_a_line_that_all_documents_share(spark):
    """Its postings meet their count without a shuffle by key."""
    rows = [(i, "Licensed to everybody under no terms whatsoever" + f"\nown line {i}") for i in range(3000)]
    got = LineDedup().report(frame(spark, rows)).collect()
    assert sum(r.n_dropped for r in got) == 2999 and [r.doc_id for r in got if not r.n_dropped] == [2999]


def test_few_drops_are_joined_as_many_are(spark):
    """What a small input moves tells what a large one will: no broadcast that more documents outgrow."""
    joined = LineDedup()._with_drops(frame(spark, corpus(30)), "doc_id", "text")
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
