import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from tallybrook.llm import attention, lm
from tallybrook.llm.attention import Attention, rows_of, windows
from tallybrook.llm.lm import LanguageModel

PATH = public_tokenizers.path("byte_bpe_50k.json")


def small(size=50, seed=0):
    rng = np.random.default_rng(seed)
    make = lambda *s: rng.normal(size=s).astype(np.float32) * 0.5
    d, k = attention.WIDTH, attention.KINDS
    layer = {"embed": make(size, d), "query": make(d, d), "key": make(d, d), "value": make(d, d), "bias": make(attention.WINDOW), "gate": make(d, k), "lean": make(k)}
    table = rng.random((size, k)).astype(np.float32)
    return Attention(layer, table / table.sum(axis=0), 0)


def train(texts, counts, start, **options):
    parts = [rows_of(t, start) for t in texts]
    return attention.train(*(np.concatenate(x) for x in zip(*parts, strict=True)), counts, start, **options)


def about_exp(x):
    """2^n (1 + f) where x is (n + f) ln 2."""
    n = np.floor(x / math.log(2))
    return 2.0**n * (1 + x / math.log(2) - n)


def test_weights_stand_in_for_exp():
    x = np.linspace(-50, 50, 100_001).astype(np.float32)
    got = attention.weights(x * attention.SLOPE + attention.ONE)
    assert np.allclose(got, about_exp(x.astype(float)), rtol=2e-4)
    share = got / np.exp(x.astype(float))
    assert share.min() > 0.999 and share.max() < 1.0625
    assert attention.weights(np.array([-1e30], np.float32))[0] == 0


def test_draws_follow_the_shares():
    rng = np.random.default_rng(3)
    share = rng.random(attention.KINDS).astype(np.float32)
    got = np.bincount((share * attention.noise()).argmax(axis=1), minlength=attention.KINDS) / attention.NOISE
    assert np.abs(got - share / share.sum()).max() < 0.006


def plain(model, text):
    """One token after another, with the context that its window gives it."""
    layer, out = model.layer, []
    given = [model.start, *text[:-1]]
    for i, t in enumerate(text):
        step = attention.WINDOW - attention.CONTEXT
        begin = 0 if i < attention.WINDOW else ((i - attention.CONTEXT) // step) * step
        x = layer["embed"][given[begin : i + 1]].astype(float)
        s = np.array([x[-1] @ layer["query"] @ (row @ layer["key"]) + layer["bias"][i - begin - j] for j, row in enumerate(x)])
        w = about_exp(s)
        h = x[-1] + (w / w.sum()) @ (x @ layer["value"])
        g = about_exp(h @ layer["gate"] + layer["lean"])
        out.append(math.log10(g / g.sum() @ model.table[t]))
    return out


def test_windows_score_each_token_once():
    lengths = np.array([0, 1, 8, 9, 32, 33, 56, 57, 500])
    text, begin = windows(lengths)
    seen = Counter((t, b + i) for t, b in zip(text.tolist(), begin.tolist(), strict=True) for i in range(attention.WINDOW) if b + i < lengths[t] and (b == 0 or i >= attention.CONTEXT))
    assert seen == Counter((t, i) for t, n in enumerate(lengths) for i in range(n))


def test_logs_against_plain_version():
    model, rng = small(), np.random.default_rng(1)
    texts = [rng.integers(0, 50, n) for n in (1, 5, 31, 32, 33, 0, 90, 200)]
    assert np.allclose(model.logs(texts), [x for t in texts for x in plain(model, t)], atol=1e-4)
    assert len(model.logs([])) == 0


def test_slopes():
    model, rng = small(20, 3), np.random.default_rng(4)
    given, target = rng.integers(0, 20, (3, attention.WINDOW)), rng.integers(0, 20, (3, attention.WINDOW))
    layer = {k: v.astype(np.float64) for k, v in model.layer.items()}

    def loss():
        return -np.log(model._mixture(attention._forward(layer, given)["gate"], target)).sum()

    f = attention._forward(layer, given)
    joint = f["gate"] * model.table[target]
    slopes = attention._backward(layer, given, f, f["gate"] - joint / joint.sum(axis=-1, keepdims=True))
    for k, v in layer.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            old, e = v[at], 1e-5
            v[at] = old + e
            up = loss()
            v[at] = old - e
            down = loss()
            v[at] = old
            assert math.isclose((up - down) / 2 / e, slopes[k][at], rel_tol=1e-3, abs_tol=1e-4), k


def test_learns_what_depends_on_context():
    rng = np.random.default_rng(5)
    texts = [np.concatenate([[k, k] + rng.integers(10 * k, 10 * k + 10, 40).tolist()]) for k in rng.integers(1, 5, 300)]
    model = train(texts[:250], np.bincount(np.concatenate(texts[:250]), minlength=60).astype(float), 0, steps=150, batch=64, lean=20.0)
    assert np.allclose(model.table.sum(axis=0), 1, atol=1e-3)
    held = model.logs(texts[250:])
    assert held.mean() > -1.25  # ten tokens a kind: -1; without context, forty: -1.6


def rows():
    rng, part = random.Random(6), ["ra", "To", "mi", "én", "sol"]
    out = [(i, " ".join("".join(rng.choice(part) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 60))), True) for i in range(80)]
    return out + [(None, "Ra To\tmi", None), (200, None, None), (201, "", None), (202, " \n", None), (203, "ra " * 20_000, None), (204, "x" * 5000, None), (205, "\xa0 a\x85b <|endoftext|>", None), (3, "again", None), (3, "again", None)]


def test_score_against_brute_force(spark, monkeypatch):
    data = rows()
    job = LanguageModel(PATH, head=7, sample=30, steps=20)
    got = job.score(spark.createDataFrame(data, "doc_id long, text string, held_out boolean")).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    c = Counter(w for i, t, _ in data if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, _ in data:
        ws = [*words(t), None]
        want.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)))
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 3))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:5] == b[:5] and math.isclose(a.base_score, b[5], rel_tol=1e-9) and a.score < 0
    # Scores, from the model's log of each subword one after another.
    frame = spark.createDataFrame(data, "doc_id long, text string, held_out boolean")
    training = frame.where(frame.doc_id.isNull() | frame.doc_id.isin([i for i, _, _ in data if i is not None and not held(i)]))
    vocabulary = job.vocabulary(training)
    model, cutter = job.fit(training, vocabulary, training.count()), lm._subwords(PATH, job.end)
    plainly = []
    for i, t, _ in data:
        ws = [w.encode() for w in words(t)]
        if len(ws) > 100:
            continue
        pieces = [cutter.cut([w])[0].tolist() for w in ws] + [[job.end]]
        logs, at, out = plain(model, [x for p in pieces for x in p]), 0, 0.0
        for w, p in zip([*words(t), None], pieces, strict=True):
            log, at = sum(logs[at : at + len(p)]), at + len(p)
            out += math.log10(lm.MIX * 10**log + (1 - lm.MIX) * c[w] / n)
        plainly.append((str(i), len(ws) + 1, out, sum(logs)))
    those = sorted((str(r.doc_id), r.n_tokens, r.score, r.model_score) for r in got if r.n_tokens <= 101)
    for a, b in zip(those, sorted(plainly), strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-3, atol=1e-3), (a, b)
    # The same scores however many words the head holds.
    other = LanguageModel(PATH, head=1000, sample=30, steps=20).score(spark.createDataFrame(data, "doc_id long, text string, held_out boolean")).collect()
    for a, b in zip(sorted(got, key=key), sorted(other, key=key), strict=True):
        assert math.isclose(a.score, b.score, rel_tol=1e-6)


def test_empty(spark):
    assert LanguageModel(PATH, steps=2).score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mixture_of_columns_and_arrays(spark):
    from pyspark.sql import functions as F

    cases = [(-1.0, 5), (-2000.0, 5), (-2000.0, 0), (-3.0, 0)]
    got = [r[0] for r in spark.createDataFrame(cases, "log double, n long").select(lm._mixed(F.col("log"), F.col("n"), 100)).collect()]
    assert np.allclose(got, lm._mixed_array(np.array([a for a, _ in cases]), np.array([b for _, b in cases]), 100))


def test_learns_from_texts_outside_the_sample(spark):
    """Executors gather what one pass over all texts gives, and a word that the sample lacks depends on what stands before it."""
    rng, sides = random.Random(7), [["red", "green", "blue"], ["one", "two", "three"]]
    side = lambda k: " ".join(rng.choice(sides[k]) for _ in range(30))
    data = [(i, f"{side(i % 2)} {'zebra ' * 3 if i % 2 and i >= 30 else ''}{side(i % 2)}") for i in range(400)] + [(None, None)]
    job = LanguageModel(PATH, sample=30, steps=150)
    cutter = lm._subwords(PATH, job.end)
    texts = [cutter.text(lm.ascii_lower_words(t)) for _, t in data]
    counts = np.bincount(np.concatenate(texts), minlength=cutter.size).astype(float)
    start = train(texts[:30], counts, job.end, steps=150)
    got = job.gather(spark.createDataFrame(data, "doc_id long, text string").repartition(5), start, counts)
    sums = np.zeros(start.table.shape)
    start.gather(texts, sums)
    assert np.isclose(sums.sum(), counts.sum(), rtol=1e-5) and np.allclose(got.table, attention.leant(sums, attention.shares_of(counts)), rtol=1e-3, atol=1e-7)
    zebra = cutter.cut([b"zebra"])[0][0]
    assert not any(zebra in t for t in texts[:30])
    after = lambda model, k: model.logs([np.append(cutter.cut([w.encode() for w in sides[k] * 6])[0], zebra)])[-1]
    assert after(start, 1) - after(start, 0) < 0.3 < after(got, 1) - after(got, 0)


def test_context_is_whole():
    """A scored token sees nine tokens before it at least (or its whole text), and 128 kinds to choose from."""
    assert small().table.shape[1] >= 128
    _, begin = windows(np.array([500]))
    for b in begin.tolist():
        for i in range(b if b == 0 else b + attention.CONTEXT, b + attention.WINDOW):
            assert i - b + 1 >= min(9, i + 1)  # what is given at places b to i: the tokens b - 1 to i - 1


def test_more_words_than_the_head_holds(spark):
    """A head too small for the most frequent words, alike in count, still knows the end."""
    text = " ".join(f"w{k}" for k in range(12))
    d = spark.createDataFrame([(0, text)], "doc_id long, text string")
    for head in (5, 1000):
        r = LanguageModel(PATH, head=head, steps=2).score(d).first()
        assert r.n_known == r.n_tokens == 13 and math.isclose(r.base_score, 13 * math.log10(1.5 / (13 + 7)), rel_tol=1e-9)


def test_a_word_that_many_texts_share(spark):
    """Unseen in training, in most held-out texts: it is joined where they are, with the same counts."""
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == 1]
    d = spark.createDataFrame([(i, f"own{i} template" if i in set(held) else "plain words") for i in range(3000)], "doc_id long, text string")
    out = LanguageModel(PATH, head=2, steps=2).score(d).where("held_out").collect()
    assert len(out) == len(held) and all(r.n_tokens == 3 and r.n_known == 1 for r in out) and len({round(r.base_score, 9) for r in out}) == 1


def test_words_are_cut_one_by_one():
    cutter = lm.Subwords(PATH, 50256, limit=4)
    words = [w.encode() for w in "the quick\xa0brown fox \x85 it's 中文 naïve the quick fox again \xa0 12345".split(" ")]
    for _ in range(3):
        ids, sizes = cutter.cut(words)
        assert ids.tolist() == [x for w in words for x in np.frombuffer(cutter.one(w), "<u4").tolist()] and sizes.sum() == len(ids) and (sizes > 0).all()


def test_slopes_of_a_pass(monkeypatch):
    """With exp itself for weights(), a pass's slopes are those of training, which test_slopes holds against differences."""
    monkeypatch.setattr(attention, "weights", lambda scaled, least=0, into=None: np.exp((scaled.astype(float) - attention.ONE) / attention.SLOPE).astype(np.float32))
    model, rng = small(20, 3), np.random.default_rng(4)
    texts = [rng.integers(0, 20, attention.WINDOW) for _ in range(5)]
    found = []
    monkeypatch.setattr(Attention, "_move", lambda self, step, error, scale, squares, rate: found.append(self._slopes(step, error, scale)))
    into = np.zeros(model.table.shape, np.float32)
    model.learn(texts, into, attention.resting(model.layer))
    given, target = (np.stack(x) for x in zip(*((np.append(model.start, t[:-1]), t) for t in texts), strict=True))
    f = attention._forward(model.layer, given)
    joint = f["gate"] * model.table[target]
    want = attention._backward(model.layer, given, f, f["gate"] - joint / joint.sum(axis=-1, keepdims=True))
    (slopes, rows, by_row), embed = found[0], want.pop("embed")
    assert len(found) == 1 and into.sum() == sum(map(len, texts)) and slopes.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(slopes[k], v, rtol=2e-3, atol=2e-3), k
    assert np.allclose(by_row, embed[rows], rtol=2e-3, atol=2e-3) and set(rows) == set(np.flatnonzero(embed.any(axis=1)))


def test_the_layer_learns_from_texts_outside_the_sample(spark):
    """What follows "zebra" is known from texts that the sample lacks: its embedding and all else of the layer move."""
    rng = random.Random(8)
    data = [(i, " ".join(f"{a} {b}" for a, b in (rng.choice([("red", "one"), ("blue", "two")] + [("zebra", "nine")] * (i >= 30)) for _ in range(60)))) for i in range(1500)]
    job = LanguageModel(PATH, sample=30, steps=150)
    cutter = lm._subwords(PATH, job.end)
    texts = [cutter.text(lm.ascii_lower_words(t)) for _, t in data]
    counts = np.bincount(np.concatenate(texts), minlength=cutter.size).astype(float)
    start = train(texts[:30], counts, job.end, steps=150)
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    got, plainly = job.learn(frame, start, counts), job.gather(frame, start, counts)
    zebra = cutter.cut([b"zebra"])[0]
    assert all(not np.allclose(got.layer[k], start.layer[k]) for k in start.layer) and not np.allclose(got.layer["embed"][zebra], start.layer["embed"][zebra])
    unseen = np.setdiff1d(np.arange(cutter.size), np.append(np.concatenate(texts), job.end))
    assert np.array_equal(got.layer["embed"][unseen], start.layer["embed"][unseen])
    assert np.allclose(got.table.sum(axis=0, dtype=float), 1, atol=1e-5)
    assert got.logs(texts[30:]).mean() > plainly.logs(texts[30:]).mean() + 0.003


def test_a_pass_is_the_mean_of_its_tasks(spark):
    """Two tasks of the same texts reach what one of them reaches, with twice its counts."""
    text = [("red one blue two " * 20,)]
    job = LanguageModel(PATH, sample=30, steps=5)
    cutter = lm._subwords(PATH, job.end)
    ids = cutter.text(lm.ascii_lower_words(text[0][0]))
    counts = np.bincount(ids, minlength=cutter.size).astype(float)
    start = train([ids], counts, job.end, steps=5)
    twice = spark.createDataFrame(text, "text string")
    got = job.learn(twice.unionAll(twice), start, counts)
    own, into = Attention({k: v.copy() for k, v in start.layer.items()}, start.table, start.start), np.zeros(start.table.shape, np.float32)
    own.learn([ids], into, attention.resting(own.layer))
    assert all(np.allclose(got.layer[k], own.layer[k], rtol=1e-4, atol=1e-6) for k in own.layer)
    assert np.allclose(got.table, attention.leant(2 * into, attention.shares_of(counts)), rtol=1e-4)


def test_words_are_cut_as_one_text():
    coder, rng = lm._subwords(PATH, 50256).coder, random.Random(9)
    letters = list("abcxyz019'.,!?<|>-_é中🙂\u0301\u200d\u180e") + ["'s", "'ll", "the", "ing", "<|endoftext|>"]
    for _ in range(2000):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))).encode() for _ in range(rng.randint(1, 12))]
        ids, sizes = coder.encode_words(words)
        assert ids.tolist() == [i for w in words for i in coder.encode_ordinary(" " + w.decode())]
        assert sizes.tolist() == [len(coder.encode_ordinary(" " + w.decode())) for w in words]
    for odd in ("a\xa0", "\x85b", "\u3000", "\x1cb", "x" * 3000):
        assert coder.encode_words([b"plain", odd.encode()]) is None
    assert coder.encode_words([b"plain", b"\xff"]) is None and coder.encode_words([b"plain", b""]) is None and coder.encode_words([]) is None


def test_logs_that_need_no_clipping():
    """Where no log can be beyond what weights() tells apart, the clip is left out; where one can, it is not."""
    x = np.linspace(-50, 50, 10_001).astype(np.float32) * attention.SLOPE + attention.ONE
    assert np.array_equal(attention.weights(x.copy(), None), attention.weights(x.copy()))
    model, far, rng = small(), small(), np.random.default_rng(2)
    far.layer["gate"] *= 1000
    texts, seen, plainly = [rng.integers(0, 50, n) for n in (40, 100)], [], attention.weights

    def held(scaled, least=np.float32(0), into=None):
        seen.append((least is None, float(np.abs(scaled - attention.ONE).max())) if into is not None else (False, 0.0))
        return plainly(scaled, least, into)

    attention.weights = held
    try:
        assert np.isfinite(far.logs(texts)).all() and not any(free for free, _ in seen)
        seen.clear()
        assert np.allclose(model.logs(texts), [p for t in texts for p in plain(model, t)], atol=1e-4)
    finally:
        attention.weights = plainly
    assert any(free for free, _ in seen) and all(most < attention.MOST * attention.SLOPE for free, most in seen if free)


def test_texts_are_scored_together_as_alone():
    rng, model = np.random.default_rng(6), small(50257)
    cutter = lm._subwords(PATH, 50256)
    texts = [[f"w{k}".encode() for k in rng.integers(0, 30, n)] for n in (3, 0, 50, 1, 0, 200)]
    counts = lm.Counts(500, 31, {f"w{k}".encode(): k + 1 for k in range(0, 30, 2)} | {lm.END: 9})
    cut = [(t, *cutter.cut(t)) for t in texts]
    together, alone = lm._scored(model, counts, 50256, cut), [lm._scored(model, counts, 50256, [t])[0] for t in cut]
    for a, b, t in zip(together, alone, texts, strict=True):
        assert a[:2] == b[:2] == (len(t) + 1, 1 + sum(w in counts.head for w in t)) and a[5] == b[5] == [w for w in t if w not in counts.head]
        assert np.allclose(a[2:5], b[2:5], rtol=1e-5) and np.allclose(a[6], b[6], rtol=1e-4)
        assert math.isclose(a[2], sum(math.log10((counts.head[w] + 0.5) / counts.floor) for w in [*t, lm.END] if w in counts.head), rel_tol=1e-9)


def test_ids_without_sizes():
    coder = lm._subwords(PATH, 50256).coder
    for words in ([b"the", b"quick", b"it's"], ["中文".encode(), b"x"], [b"a" * 1999]):
        assert np.array_equal(coder.ids_of_words(words), coder.encode_words(words)[0])
    for words in ([], [b""], [b"\xff"], [b"x" * 2000], ["a\xa0".encode()]):
        assert coder.ids_of_words(words) is None is coder.encode_words(words)
