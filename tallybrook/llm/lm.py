"""Scoring texts with a causal self-attention model over subwords (operator 2).

Words are lower-cased (A-Z) and every word, with a space before it, is cut into byte-level BPE ids, so a text is
a sequence of subwords that ends with the end id.  The attention model (see attention.py) learns from all training documents:
windows of a bounded sample only give the start that tasks share, from which each goes on over all its texts; the
layers they reach are averaged, the output distributions gathered, and these lean on subword counts of all.  A word's
probability is MIX times what the model gives its subwords in context, plus the rest times the word's share of
all training tokens; a text's is the product over its words and the end.  model_score is the model's part alone.

Word counts cover all training documents: tasks pre-aggregate them, and no task or driver holds all.  The
HEAD most frequent go to every task; what other words a text has is joined with the table of counts, frequent ones
(which a sample finds) where the texts are.

Defined results: a null or empty text is the end alone; a null doc_id hashes as the empty text; rows that share a
doc_id are scored one by one, repeated ones alike; an empty table gives no rows, and without training documents every
subword is as likely as another; texts and words of any length are scored whole; other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention, byte_bpe
from .attention import Attention, train
from .common import ascii_lower_words, crc32_text, parallelism, settle, shared_dir, tidied

#: Words whose counts every task holds, at most.
HEAD = 100_000
#: Training documents that the attention layer starts from, at most: the first by a hash of the id.  Of each the driver gets
#: some windows, however long it is: the first by a hash of their place.
SAMPLE, SOME_WINDOWS = 4_000, 64
#: The share of the attention model in a word's probability.
MIX = 0.7
#: The end of a text among words: no word is empty.
END = b""
#: A word among the texts' rarer ones that has a larger share of them than one in COMMON is joined where they are.
COMMON = 1_000
#: Different words that a task counts before it passes them on.
_FLUSH = 200_000
#: Tokens that are scored together, about.
_TOGETHER = 200_000


class Subwords:
    """Cuts words into subwords.  limit: words whose subwords a worker keeps, in two generations."""

    def __init__(self, path: str, end: int, limit: int = 100_000):
        self.coder, self.end, self.limit = byte_bpe.load(path), end, limit
        self.size = max(self.coder.size, end + 1)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def one(self, word: bytes) -> bytes:
        return self.coder.encode_ordinary(" " + word.decode("utf-8", "replace")).astype("<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        if len(self.known) >= self.limit:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        for w in words:
            if w not in known:
                known[w] = older.get(w) or self.one(w)

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The subwords of words one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if found := self.coder.encode_words(words):
            return found
        try:
            found = list(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(words)
            found = list(map(self.known.__getitem__, words))
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def text(self, words: list[bytes]) -> np.ndarray:
        """The subwords of a text, with its end."""
        ids = self.coder.ids_of_words(words)
        return np.append(self.cut(words)[0] if ids is None else ids, np.uint32(self.end))


_loaded: dict[tuple[str, int], Subwords] = {}


def _subwords(path: str, end: int) -> Subwords:
    if (path, end) not in _loaded:
        _loaded[path, end] = Subwords(path, end)
    return _loaded[path, end]


@dataclass(frozen=True)
class Counts:
    """Of training tokens, ends included: how many (total), how many different, and those of the HEAD most frequent."""

    total: int
    different: int
    head: dict[bytes, int]

    @property
    def floor(self) -> float:
        return self.total + 0.5 * (self.different + 1)


@dataclass(frozen=True)
class LanguageModel:
    """path: of the byte-level BPE file; end: the id after a text; rows whose crc32(doc_id) mod folds is held are not learnt from."""

    path: str
    end: int = 50256
    folds: int = 5
    held: int = 1
    head: int = HEAD
    sample: int = SAMPLE
    steps: int = 1500

    def _rows(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        held = crc32_text(doc_id) % self.folds == self.held
        return docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))

    def vocabulary(self, training: DataFrame) -> DataFrame:
        """word (bytes; empty: the end), n of all texts of training."""

        def count(batches):
            own: Counter[bytes] = Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    own.update(ascii_lower_words(t))
                    own[END] += 1
                    if len(own) >= _FLUSH:
                        yield _counted(own)
                        own = Counter()
            yield _counted(own)

        return training.select("text").mapInArrow(tidied(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def subword_counts(self, vocabulary: DataFrame) -> np.ndarray:
        """Of each id; the vocabulary of ids bounds what the driver gets."""
        path, end = self.path, self.end

        def count(batches):
            cutter = _subwords(path, end)
            out = np.zeros(cutter.size)
            for b in batches:
                words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
                ends = np.array([w == END for w in words], bool)
                out[end] += n[ends].sum()
                ids, sizes = cutter.cut([w for w in words if w != END])
                out += np.bincount(ids, np.repeat(n[~ends], sizes), len(out))
            ids = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out[ids])], ["id", "n"])

        got = vocabulary.mapInArrow(tidied(count), "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(_subwords(path, end).size)
        for r in got:
            out[r["id"]] = r["n"]
        return out

    def counts(self, vocabulary: DataFrame) -> Counts:
        total, different = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        # Sizes by sixteenths of an octave, a thousand rows at most, tell from which count on HEAD words are enough: tasks
        # then send those words only, and not each its own most frequent ones.
        octave = F.floor(16 * F.log2("n")).cast("int")
        room, least = self.head, None
        for r in sorted(vocabulary.groupBy(octave.alias("o")).count().collect(), reverse=True):
            room -= r["count"]
            if room < 0:
                break
            least = r["o"]
        enough = F.lit(False) if least is None else octave >= least  # none: more words than that are the most frequent alike
        top = vocabulary.where(enough | (F.col("word") == F.lit(END))).collect()
        return Counts(total, different, {bytes(r["word"]): r["n"] for r in top})

    def windows(self, training: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sample's windows: the subwords before each place, those at it, and which places are real.  texts: how many training has."""
        path, end, most = self.path, self.end, SOME_WINDOWS
        order = F.xxhash64(F.lit("lm"), "doc_id")
        near = F.pmod(order, F.lit(1 << 30)) < int(min(1.0, (2 * self.sample + 100) / max(texts, 1)) * (1 << 30))  # so that tasks offer about twice the sample
        ids = training.where(F.col("doc_id").isNotNull() & near).select("doc_id").distinct().orderBy(order, "doc_id").limit(self.sample)
        rows = training.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))  # SAMPLE rows at most

        def some(batches):
            cutter = _subwords(path, end)
            for b in batches:
                found = []
                for t in b.column(1).to_pylist():
                    given, target, real = attention.rows_of(cutter.text(ascii_lower_words(t)), end)
                    first = np.argsort((np.arange(len(given)) * 2_654_435_761 + int(target.sum())) % 1_000_003, kind="stable")[:most]
                    found.append(np.concatenate((given[first], target[first], real[first]), axis=1).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["doc_id", "windows"])

        got = sorted(rows.mapInArrow(tidied(some), "doc_id long, windows binary").collect())  # SAMPLE * SOME_WINDOWS windows at most
        flat = np.frombuffer(b"".join(r["windows"] for r in got), "<i4").reshape(-1, 3 * attention.WINDOW)
        given, target, real = np.split(flat, 3, axis=1)
        return given, target, real.astype(bool)

    def fit(self, training: DataFrame, vocabulary: DataFrame, texts: int) -> Attention:
        counts = self.subword_counts(vocabulary)
        return self.learn(training, train(*self.windows(training, texts), counts, self.end, steps=self.steps), counts)

    def learn(self, training: DataFrame, start: Attention, counts: np.ndarray) -> Attention:
        """start, learnt further from every text of training: the layer's mean over tasks, and the kinds' distributions gathered.

        Each task goes on from start over all its texts (see Attention.learn).  A token's embedding counts for as often as a
        task's texts give it, all else of the layer for the task's tokens; these sums and the kinds' are added by executors.
        """
        shared = training.sparkSession.sparkContext.broadcast(start)
        path, end, (size, kinds) = self.path, self.end, start.table.shape
        width, rest = attention.WIDTH, sorted(k for k in start.layer if k != "embed")
        wide = kinds + width + 1  # a row: of a token its kinds, its embedding times its weight, its weight; beyond the tokens, the rest of the layer

        def some(ids, rows) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], ["id", "sums"])

        def one_pass(batches):
            model, cutter = shared.value, _subwords(path, end)
            model = Attention({k: v.copy() for k, v in model.layer.items()}, model.table, model.start)
            squares, into, given = attention.resting(model.layer), np.zeros((size, kinds), np.float32), np.zeros(size)

            def over(texts):
                model.learn(texts, into, squares)
                for t in texts:
                    np.add.at(given, t[:-1], 1)
                given[end] += len(texts)

            for b in batches:
                held, tokens = [], 0
                for t in b.column(0).to_pylist():
                    held.append(cutter.text(ascii_lower_words(t)))
                    tokens += len(held[-1])
                    if tokens > _TOGETHER:
                        over(held)
                        held, tokens = [], 0
                over(held)
            if given.any():
                flat = np.append(np.concatenate([model.layer[k].ravel() for k in rest]).astype(float) * given.sum(), given.sum())
                flat = np.append(flat, np.zeros(-len(flat) % wide)).reshape(-1, wide)
                ids = np.flatnonzero(into.any(axis=1) | (given > 0))
                own = np.concatenate((into[ids], model.layer["embed"][ids] * given[ids, None], given[ids, None]), axis=1, dtype=np.float32)
                yield some([*ids, *range(size, size + len(flat))], [*own, *flat])

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for i, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sums[i] = sums.get(i, 0.0) + np.frombuffer(row, "<f4").astype(float)
            yield some(list(sums), list(sums.values()))

        parts = training.select("text").mapInArrow(tidied(one_pass), "id long, sums binary").repartition(parallelism(training.sparkSession), "id")
        got = {r["id"]: np.frombuffer(r["sums"], "<f4") for r in parts.mapInArrow(tidied(add), "id long, sums binary").collect()}  # the vocabulary of ids bounds it
        shared.destroy()
        sums, layer = np.zeros((size, kinds), np.float32), {k: v.copy() for k, v in start.layer.items()}
        for i in [i for i in got if i < size]:
            row = got.pop(i)
            sums[i] = row[:kinds]
            if row[-1]:
                layer["embed"][i] = row[kinds:-1] / row[-1]
        if got:
            flat, at = np.concatenate([got[i] for i in sorted(got)]), 0
            weight = flat[sum(layer[k].size for k in rest)]
            for k in rest:
                layer[k][...] = (flat[at : at + layer[k].size] / weight).reshape(layer[k].shape)
                at += layer[k].size
        return Attention(layer, attention.leant(sums, attention.shares_of(counts)), start.start)

    def gather(self, training: DataFrame, start: Attention, counts: np.ndarray) -> Attention:
        """start with the kinds' distributions gathered anew, by an expectation step over every text of training."""
        shared = training.sparkSession.sparkContext.broadcast(start)
        path, end, shape = self.path, self.end, start.table.shape

        def some(into: np.ndarray) -> pa.RecordBatch:
            ids = np.flatnonzero(into.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([into[i].astype(np.float32).tobytes() for i in ids], pa.binary())], ["id", "sums"])

        def expect(batches):
            model, cutter, into = shared.value, _subwords(path, end), np.zeros(shape, np.float32)
            for b in batches:
                held, tokens = [], 0
                for t in b.column(0).to_pylist():
                    held.append(cutter.text(ascii_lower_words(t)))
                    tokens += len(held[-1])
                    if tokens > _TOGETHER:
                        model.gather(held, into)
                        held, tokens = [], 0
                model.gather(held, into)
            yield some(into)

        def add(batches):
            into = np.zeros(shape)
            for b in batches:
                if b.num_rows:
                    attention._scatter(into, b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, shape[1]))
            yield some(into)

        parts = training.select("text").mapInArrow(tidied(expect), "id long, sums binary").repartition(parallelism(training.sparkSession), "id")
        sums = np.zeros(shape, np.float32)
        for r in parts.mapInArrow(tidied(add), "id long, sums binary").collect():  # the vocabulary of ids bounds it
            sums[r["id"]] = np.frombuffer(r["sums"], np.float32)
        shared.destroy()
        return Attention(start.layer, attention.leant(sums, attention.shares_of(counts)), start.start)

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, model_score of every row."""
        spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
        rows = self._rows(docs, doc_id, text)
        training = rows.where(~F.col("held_out"))
        vocabulary = settle(self.vocabulary(training), folder, "vocabulary")
        counts = self.counts(vocabulary)
        shared = spark.sparkContext.broadcast((self.fit(training, vocabulary, counts.head.get(END, 0)), counts))
        path, end = self.path, self.end

        def run(batches):
            (model, known), cutter = shared.value, _subwords(path, end)
            for b in batches:
                held, out, tokens = [], [], 0
                for t in b.column(3).to_pylist():
                    words = ascii_lower_words(t)
                    held.append((words, *cutter.cut(words)))
                    tokens += len(held[-1][1])
                    if tokens > _TOGETHER or len(held) >= 256:
                        out += _scored(model, known, end, held)
                        held, tokens = [], 0
                out += _scored(model, known, end, held)
                columns = list(zip(*out, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "model_score", "words", "logs"])

        first = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
        first = settle(first.mapInArrow(tidied(run), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, model_score double, words array<binary>, logs array<double>"), folder, "scored")
        rare = first.select("row", F.explode(F.arrays_zip("words", "logs")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.logs").alias("log"))
        n = F.coalesce(F.col("n"), F.lit(0))
        # Words that many of the texts share go to them; which those are makes no difference to the result.
        some = rare.select("word").sample(0.01, seed=3)
        common = some.groupBy("word").agg(F.count("*").alias("count")).where((F.col("count") > 20) & (F.col("count") * COMMON > some.count())).orderBy(F.desc("count"), "word").limit(COMMON)
        common = settle(common.select("word").join(vocabulary, "word", "left"), folder, "common")
        rest = rare.join(F.broadcast(common), "word").unionByName(rare.join(F.broadcast(common.select("word")), "word", "left_anti").join(vocabulary, "word", "left"))
        rest = rest.groupBy("row").agg(F.sum(F.log10((n + 0.5) / counts.floor)).alias("more_base"), F.sum(_mixed(F.col("log"), n, counts.total)).alias("more_score"), F.count_if(n > 0).alias("more_known"))
        out = first.drop("words", "logs").join(rest, "row", "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
        return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(counts.total).cast("long").alias("train_tokens"), plus("base_score", "more_base"), plus("score", "more_score"), "model_score")


def _counted(own: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["word", "n"])


#: Below this log10 a model's probability is nothing against any share of the counts, and no double holds it.
_LEAST = -300.0


def _mixed(log: Column, n: Column, total: int) -> Column:
    """log10 of MIX * 10^log + (1 - MIX) * n / total."""
    both = F.log10(MIX * F.pow(F.lit(10.0), F.greatest(log, F.lit(_LEAST))) + (1 - MIX) * n / max(total, 1))
    return F.when(n > 0, both).otherwise(log + float(np.log10(MIX)))


def _mixed_array(logs: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    return np.where(n > 0, np.log10(MIX * 10.0 ** np.maximum(logs, _LEAST) + (1 - MIX) * n / max(total, 1)), logs + np.log10(MIX))


def _scored(model: Attention, counts: Counts, end: int, texts: list[tuple[list[bytes], np.ndarray, np.ndarray]]) -> list[tuple]:
    """texts: words, their subwords, how many each has.

    n_tokens, n_known, base_score, score of what the head knows, the model's log10 of all, and the other words with theirs.
    """
    if not texts:
        return []
    logs = model.logs([np.append(ids, np.uint32(end)) for _, ids, _ in texts])
    words = [w for own, _, _ in texts for w in (*own, END)]
    n_tokens = np.array([len(own) + 1 for own, _, _ in texts])
    last = np.cumsum(n_tokens)
    first = last - n_tokens
    sizes = np.concatenate([x for _, _, own in texts for x in (own, [1])]).astype(np.int64)
    by_word = np.add.reduceat(logs, np.cumsum(sizes) - sizes)
    n = np.array(list(map(counts.head.get, words, repeat(0))))
    known = n > 0
    known[last - 1] = True  # the end's count is in the head, or nothing was learnt
    base, score = np.zeros(len(words)), np.zeros(len(words))
    base[known] = np.log10((n[known] + 0.5) / counts.floor)
    score[known] = _mixed_array(by_word[known], n[known], counts.total)
    n_known, base, score, own = (np.add.reduceat(x, first).tolist() for x in ((n > 0).astype(np.int64), base, score, by_word))
    rare = np.flatnonzero(~known)
    cut = np.searchsorted(rare, np.append(0, last)).tolist()
    rare_words, rare_logs = [words[i] for i in rare.tolist()], by_word[rare].tolist()
    return [(*row, rare_words[a:b], rare_logs[a:b]) for *row, a, b in zip(n_tokens.tolist(), n_known, base, score, own, cut, cut[1:], strict=False)]
