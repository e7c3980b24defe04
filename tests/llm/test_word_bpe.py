import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallybrook.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "\n", "'", "s", "é", "1", "  ", "\t", "\xa0", "\x1c", "\x85", "中", "<|endoftext|>", "<|startoftext|>", ".", "T", "'ll", "́", "ſ", "𝟙", " ", "<|", "Σ", "İ", "the", "ing", "tion"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(coder, library, texts):
    for text, ids in zip(texts, coder.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:50]
        assert coder.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_same_as_library(library):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(5000)]
    texts += ["".join(rng.choice("aab") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 30))) for _ in range(5000)]
    texts += ["ab" * 50_000, "x" * 199, "x" * 200, "x" * 201, "the " * 50_000]
    same(word_bpe.WordBpe(PATH), library, texts)


def test_small_stores_forget_nothing_needed(library):
    coder, rng = word_bpe.WordBpe(PATH, limit=20), random.Random(3)
    for _ in range(30):
        same(coder, library, [" ".join("".join(rng.choice("abc") for _ in range(3)) for _ in range(20)) for _ in range(3)])


def test_report(spark, library):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (None, "no id", "x"), (3, None, "x"), (4, "", "x"), (5, " \n", "x"), (6, "Éa <|endoftext|>", "x")]
    got = word_bpe.report(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert word_bpe.report(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
