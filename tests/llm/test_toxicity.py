import math
import random
import zlib

import pytest

from tallybrook.llm import toxicity
from tallybrook.llm.toxicity import Model, Toxicity, fit

BAD = ["idiot", "scumbag", "trashy"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    part = ["ra", "to", "mi", "en", "sol", "ka", "ber", "li"]
    docs, labels = [], []
    for i in range(n):
        ws = ["".join(rng.choice(part) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(3 + len(ws) // 15):
                ws[rng.randrange(len(ws))] = rng.choice(BAD) + rng.choice(["", "s", "en", "ly"])
        docs.append((i, " ".join(ws), "x", 0.5))
        labels.append((i, 1, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_shared_model_sums_to_one():
    counts = {}
    for w, n in {b"abc": 3, b"abd": 2, b"longerthaneight": 4, b"b": 1}.items():
        for context, letter in toxicity._spelling(w):
            toxicity._add(counts, context, letter, n)
    shared = toxicity._Shared(counts)
    letters = {x for own in shared.counts.values() for x in own}
    for context in shared.counts:
        assert math.isclose(sum(shared.of(context, x) for x in letters) + shared.of(context, "?"), 1)


def test_word_store_gives_the_same_with_any_limit():
    texts = [d[1] for d in corpus(40)[0]]
    gain = {"\x02" + a: 0.5 for a in "abcdefg"}
    assert (Model(gain, limit=3).scores(texts) == Model(gain).scores(texts)).all()


def test_held_out_accuracy_and_folds(spark):
    docs, labels = corpus(900)
    got = {r.doc_id: r for r in Toxicity().report(*frames(spark, docs, labels)).collect()}
    truth = dict((i, t) for i, _, t in labels)
    assert len(got) == 900 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    # Labels of held-out rows change nothing.
    flipped = [(i, q, 1 - t if got[i].held_out else t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in Toxicity().report(*frames(spark, docs, flipped)).collect()}
    assert all(again[i] == got[i].score for i in got)


def test_apply_keeps_clean_rows_and_all_columns(spark):
    docs, labels = corpus(400, 1)
    docs += [(None, "ra mi sol", "x", 0.1), (5000, None, "x", 0.1), (5001, "", None, None), (5002, "ra " * 100_000, "x", 0.1), (3, docs[3][1], "x", 0.5)]
    d, lab = frames(spark, docs, labels + [(3, 1, None), (None, 1, 1)])
    kept, scores = Toxicity().apply(d, lab).collect(), Toxicity().report(d, lab).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r, s in zip(d.collect(), scores, strict=True) if s.score < 0.5)
    assert {5000, 5001, 5002, None} <= {r.doc_id for r in kept}


@pytest.mark.parametrize("toxic", [[], [1]])
def test_without_a_class(spark, toxic):
    docs, _ = corpus(10)
    d, lab = frames(spark, docs, [(i, 1, 0) for i in range(10) if not toxic])
    assert all(r.predicted == 0 and r.score < 0.01 for r in Toxicity().report(d, lab).collect())
    assert Toxicity().report(d.limit(0), lab).count() == 0


def test_fit_is_deterministic():
    docs, labels = corpus(200)
    t, o = ([toxicity.bag_of(d[1]) for d, x in zip(docs, labels, strict=True) if x[2] == c] for c in (1, 0))
    assert fit(t, o).gain == fit(list(t), list(o)).gain


def plain_difference(learn, text):
    """Both classes' log-likelihoods of a text, letter by letter from the definitions."""
    seen = [[w for t in side for w in {x.decode() for x in toxicity.ascii_lower_words(t)}] for side in learn]
    whole = lambda w: "\x02" + w + "\x03"
    pairs = lambda w: [whole(w)[max(0, i - 8) : i] + "|" + whole(w)[i] for i in range(1, len(w) + 2)]
    counts = [{}, {}]
    for own, side in zip(counts, seen, strict=True):
        for w in side:
            for p in pairs(w):
                own[p] = own.get(p, 0) + 1
    often = {}
    for own in counts:
        for p, n in own.items():
            often[p.rpartition("|")[0]] = often.get(p.rpartition("|")[0], 0) + n
    counts = [{p: n for p, n in own.items() if often[p.rpartition("|")[0]] >= toxicity.LEAST} for own in counts]
    levels = {p: sum(own.get(p, 0) for own in counts) for own in counts for p in own}
    for size in range(8, 0, -1):
        for p in [p for p in levels if len(p.rpartition("|")[0]) == size]:
            levels[p[1:]] = levels.get(p[1:], 0) + 1
    followers = {}
    for p, n in levels.items():
        followers.setdefault(p.rpartition("|")[0], {})[p[-1]] = n

    def shared(context, x):
        lower = shared(context[1:], x) if context else 1 / (1 + len(followers.get("", {})))
        own = followers.get(context)
        return lower if own is None else (max(own.get(x, 0) - 0.75, 0) + 0.75 * len(own) * lower) / sum(own.values())

    ws, total = toxicity.ascii_lower_words(text), 0.0
    for w in ws:
        for p in pairs(w.decode()):
            context, x = p[:-2], p[-1]
            rows = [{q[-1]: n for q, n in own.items() if q[:-2] == context} for own in counts]
            sums = [sum(r.values()) for r in rows]
            if not all(sums):
                continue
            a, b = (r.get(x, 0) for r in rows)
            rate, g = (a + b) / sum(sums), 0.0
            for k, n in ((a, sums[0]), (b, sums[1])):
                g += sum(2 * v * math.log(v / e) for v, e in ((k, n * rate), (n - k, n * (1 - rate))) if v > 0)
            log = [math.log((max(r.get(x, 0) - 0.75, 0) + 0.75 * len(r) * shared(context, x)) / n) for r, n in zip(rows, sums, strict=True)]
            if g >= toxicity.CONTRAST and abs(log[0] - log[1]) >= toxicity.MARGIN:
                total += log[0] - log[1]
    return total / (len(ws) + toxicity.STEADY)


def test_differences_against_plain_version():
    docs, labels = corpus(160, 5)
    sides = [[d[1] for d, x in zip(docs, labels, strict=True) if x[2] == c] for c in (1, 0)]
    model = fit(*([toxicity.bag_of(t) for t in side] for side in sides))
    learn = [side[: len(side) - len(side) // 4] for side in sides]
    texts = [sides[0][0], sides[0][-1], sides[1][0], "", "idiot", "Idiots scumbag ra mi É"]
    assert model.gain and any(plain_difference(learn, t) for t in texts)
    for t in texts:
        assert math.isclose(model.difference(t), plain_difference(learn, t), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(model.of_bag(toxicity.bag_of(t)), model.difference(t), rel_tol=1e-9, abs_tol=1e-12)
