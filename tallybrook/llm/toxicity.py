"""Toxicity from class-conditional Kneser-Ney models of how words are spelt (operator 6).

A word's probability is the product of its letters' ones, each given the word so far (CONTEXT letters at
most).  Inflected and made-up forms of a rare expression share its beginning, which is where the classes
differ.  Each class discounts its own counts and backs off to one shared interpolated Kneser-Ney model,
whose counts come from both classes: what a class has hardly seen has the shared probability in both, and so
hardly counts.  Counts are of documents that hold a word, not of its repetitions.

A text's difference is that of its two log-likelihoods, toxic and ordinary, by its length in words plus STEADY.  Letters for
which the two classes share a probability fall out of it, so only the others are kept (see CONTRAST).

Training takes a bounded sample: the PER_CLASS labelled documents of each class that come first by a hash of
their id; counts come from three quarters of it and the two numbers that turn the difference into a
probability from the rest, which the counts have not seen: its slope by logistic regression, and its middle where fewest of
them are on the wrong side.  The sample's words (each once a document) are all that the driver gets, and their number of documents
doesn't grow with the table.  Scores cover every document and whole texts, however long.

Defined results: a text without words has difference 0 and so the score of that; a null doc_id
hashes as the empty text; several labels of a document: toxic if any is; labels that are null are left out;
without toxic or without ordinary training documents every score is 0 or 1; rows pass through one by one, repeated ones
alike; a score of just 0.5 is toxic; an empty table gives no rows; columns of any name pass through apply().
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_words, crc32_text, tidied

#: Labelled documents a class that training takes at most.
PER_CLASS = 2_000
DISCOUNT, CONTEXT, STEADY = 0.75, 8, 20
#: Beginnings that fewer training documents hold are left to the shared model, where the classes agree.
LEAST = 3
#: Where the classes' counts differ by less than this G squared, chance may explain it: both have the shared probability.
#: (Backoff alone doesn't calm chance: long clean texts then differ as much as toxic ones.  The README has the figures.)
CONTRAST = 15.0
#: Ratios below three to one are left out too: a large group of copies in one class shifts all others by so much.
MARGIN = math.log(3)
_START, _END = "\x02", "\x03"

Counts = dict[str, dict[str, float]]
#: A text's different words, a space between them, and how often it has each: little memory for many texts.
Bag = tuple[bytes, np.ndarray]


def _spelling(word: bytes) -> list[tuple[str, str]]:
    """(what comes before, letter) for each letter of a word and for its end."""
    w = _START + word.decode("utf-8", "replace") + _END
    return [(w[max(0, i - CONTEXT) : i], w[i]) for i in range(1, len(w))]


def _add(counts: Counts, context: str, letter: str, n: float) -> None:
    own = counts.setdefault(context, {})
    own[letter] = own.get(letter, 0) + n


class _Shared:
    """Interpolated Kneser-Ney over both classes' counts."""

    def __init__(self, longest: Counts):
        self.counts: Counts = {c: dict(own) for c, own in longest.items()}
        for size in range(CONTEXT, 0, -1):  # a shorter context counts the different longer ones before a letter
            for context in [c for c in self.counts if len(c) == size]:
                for letter in self.counts[context]:
                    _add(self.counts, context[1:], letter, 1)
        self.total = {c: sum(own.values()) for c, own in self.counts.items()}
        self.flat = 1 / (1 + len(self.counts.get("", {})))

    def of(self, context: str, letter: str) -> float:
        lower = self.of(context[1:], letter) if context else self.flat
        own = self.counts.get(context)
        return lower if own is None else _discounted(own, self.total[context], letter, lower)


def _discounted(own: dict[str, float], total: float, letter: str, lower: float) -> float:
    return (max(own.get(letter, 0) - DISCOUNT, 0) + DISCOUNT * len(own) * lower) / total


class Model:
    """gain: log ratio of a beginning's next letter, by both together, where the classes differ.

    limit: words whose log ratios a worker keeps, in two generations.
    """

    def __init__(self, gain: dict[str, float], slope: float = 1.0, shift: float = 0.0, limit: int = 300_000):
        self.gain, self.slope, self.shift, self.limit = gain, slope, shift, limit
        self.known: dict[bytes, float] = {}
        self.older: dict[bytes, float] = {}

    def word(self, w: bytes) -> float:
        out = self.older.get(w)
        if out is None:
            out = sum([self.gain.get(context + letter, 0.0) for context, letter in _spelling(w)])
        if len(self.known) >= self.limit:
            self.older, self.known = self.known, {}
        self.known[w] = out
        return out

    def difference(self, text: str | None) -> float:
        ws = ascii_lower_words(text)
        try:
            total = sum(map(self.known.__getitem__, ws))
        except KeyError:
            total = sum([x if (x := self.known.get(w)) is not None else self.word(w) for w in ws])
        return total / (len(ws) + STEADY)

    def of_bag(self, bag: Bag) -> float:
        """difference() of a text with these words."""
        return sum([n * self.word(w) for w, n in zip(bag[0].split(), bag[1].tolist(), strict=True)]) / (int(bag[1].sum()) + STEADY)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.difference(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -500, 500)))


def _contrast(a: float, n: float, b: float, m: float) -> float:
    """The likelihood-ratio statistic (G squared) of a in n against b in m."""
    rate, out = (a + b) / (n + m), 0.0
    for k, total in ((a, n), (b, m)):
        for seen, expected in ((k, total * rate), (total - k, total * (1 - rate))):
            if seen > 0:
                out += 2 * seen * math.log(seen / expected)
    return out


def _place(context: str) -> int:
    return xxhash.xxh3_64_intdigest(context)


def _often(words: list[Counter[bytes]]) -> set[int]:
    """Hashes of the beginnings that LEAST documents hold.  Most are rare, and only arrays of hashes grow with those."""
    places = array("Q")
    counts = array("l")
    for side in words:
        for w, n in side.items():
            own = [_place(context) for context, _ in _spelling(w)]
            places.extend(own)
            counts.extend([n] * len(own))
    kinds, at = np.unique(np.frombuffer(places, np.uint64), return_inverse=True)
    return set(kinds[np.bincount(at, np.frombuffer(counts, np.int64), len(kinds)) >= LEAST].tolist()) if len(kinds) else set()


def bag_of(text: str | None) -> Bag:
    own = Counter(ascii_lower_words(text))
    return b" ".join(own), np.array(list(own.values()), "<i4")


def fit(toxic: list[Bag], ordinary: list[Bag], ratio: float = 1.0) -> Model:
    """ratio: how many ordinary documents of the corpus one of the sample stands for, for each one that a toxic one stands for."""
    sides = (toxic, ordinary)
    learn = [side[: len(side) - len(side) // 4] for side in sides]
    check = [side[len(side) - len(side) // 4 :] for side in sides]
    words = [Counter(w for bag, _ in bags for w in bag.split()) for bags in learn]
    often = _often(words)
    counts: list[Counts] = [{}, {}]
    both: Counts = {}
    for side, own in zip(words, counts, strict=True):
        for w, n in side.items():
            for context, letter in _spelling(w):
                if _place(context) in often:
                    _add(own, context, letter, n)
                    _add(both, context, letter, n)
    shared, gain = _Shared(both), {}
    for context, letters in both.items():
        own = [side.get(context, {}) for side in counts]
        totals = [sum(x.values()) for x in own]
        if not all(totals):
            continue  # a class without the beginning has the shared probability, and so little against the other
        for letter in letters:
            if _contrast(own[0].get(letter, 0), totals[0], own[1].get(letter, 0), totals[1]) >= CONTRAST:
                p = shared.of(context, letter)
                t, o = (_discounted(x, n, letter, p) for x, n in zip(own, totals, strict=True))
                if abs(x := math.log(t / o)) >= MARGIN:
                    gain[context + letter] = x
    model = Model(gain)
    model.slope, model.shift = _line([np.array([model.of_bag(x) for x in side]) for side in check], [len(side) for side in learn], ratio)
    return model


def _line(sides: list[np.ndarray], sizes: list[int], ratio: float) -> tuple[float, float]:
    """Logistic regression of the class on the difference."""
    if not all(sizes):
        return 0.0, 50.0 if sizes[0] else -50.0
    if not all(map(len, sides)):
        return 100.0, 0.0
    x = np.concatenate(sides)
    y = np.repeat([1.0, 0.0], list(map(len, sides)))
    weight = np.repeat([1.0, ratio], list(map(len, sides)))
    weight /= weight.sum()
    scale = max(x.std(), 1e-9)
    z = np.column_stack((x / scale, np.ones(len(x))))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        slope = z.T @ (weight * (p - y)) + 1e-4 * b
        b -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2), slope)
    order = np.argsort(x, kind="stable")
    wrong = np.concatenate(([0.0], np.cumsum(np.where(y[order] == 1, weight[order], -weight[order]))))  # with the cut behind each
    ends = np.concatenate(([x.min() - scale], x[order], [x.max() + scale]))
    gaps = np.where(np.isclose(wrong, wrong.min()), np.diff(ends), -1)
    middle = float(ends[gaps.argmax()] + ends[gaps.argmax() + 1]) / 2
    steep = max(float(b[0] / scale), 1e-6)
    return steep, -steep * middle


@dataclass(frozen=True)
class Toxicity:
    """held: rows whose crc32(doc_id) mod folds is held are never learnt from."""

    per_class: int = PER_CLASS
    folds: int = 5
    held: int = 0

    def fit(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
        known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and id is not null")
        known = known.where(crc32_text("id") % self.folds != self.held).groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        order = F.xxhash64(F.lit("toxicity"), "id")
        known = known.persist()
        sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
        chosen = [known.where(F.col("toxic") == c).orderBy(order, "id").limit(self.per_class) for c in (1, 0)]
        # At most 2 * per_class ids: the bound of what is broadcast, and of the rows that reach the driver.
        sample = chosen[0].unionByName(chosen[1])
        rows = docs.select(F.col(doc_id).alias("at"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("at") == F.col("id"))
        rows = rows.groupBy("id", "toxic").agg(F.max("text").alias("text")).select(order.alias("order"), "id", "toxic", "text")

        def bags(batches):
            for b in batches:
                own = [bag_of(t) for t in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x for x, _ in own], pa.binary()), pa.array([n.tobytes() for _, n in own], pa.binary())], ["order", "id", "toxic", "words", "n"])

        rows = rows.mapInArrow(tidied(bags), "order long, id long, toxic int, words binary, n binary").collect()
        rows.sort(key=lambda r: (r["order"], r["id"]))
        known.unpersist()
        stands = [max(1.0, sizes.get(c, 0) / self.per_class) for c in (1, 0)]
        sides = [[(bytes(r["words"]), np.frombuffer(bytes(r["n"]), "<i4")) for r in rows if r["toxic"] == c] for c in (1, 0)]
        del rows
        return fit(*sides, stands[1] / stands[0])

    def report(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, held_out, score and predicted of every row."""
        model = docs.sparkSession.sparkContext.broadcast(self.fit(docs, labels, doc_id, text))

        def run(batches):
            for b in batches:
                scores = model.value.scores(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (crc32_text(doc_id) % self.folds == self.held).alias("held_out"), F.col(text).alias("text"))
        return d.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")

    def apply(self, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows of docs that are not toxic, with all their columns."""
        model = docs.sparkSession.sparkContext.broadcast(self.fit(docs, labels, doc_id, text))

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(model.value.scores(b.column(b.schema.get_field_index(text)).to_pylist()) < 0.5))

        return docs.mapInArrow(tidied(run), docs.schema)

