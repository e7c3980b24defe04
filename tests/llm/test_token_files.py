import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallybrook.llm.byte_bpe import ByteBpe
from tallybrook.llm.token_files import Reader, TokenFiles, Writer, bits_for, pack, token_files, unpack

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a  b\n\nc ", "It's <|endoftext|> naïve  中文 \x1c!", "x" * 5000, None, "the end 12345", "\t\r\n", "a\x85b 'll ſ"]


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << bits, n).astype(np.uint32)
    assert unpack(pack(ids, bits), bits, n).tolist() == ids.tolist()
    assert len(pack(ids, bits)) == -(-n * bits // 8)


def test_bits():
    assert [bits_for(v) for v in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_random_access(tmp_path):
    rng = np.random.default_rng(0)
    docs = [(i, rng.integers(0, 300, n).astype(np.uint32)) for i, n in enumerate([0, 5, 4096, 1, 300_000, 0, 9000])]
    w = Writer(f"file://{tmp_path}/a/x.bin", 9)
    for i, x in docs:
        w.add(i, x)
    w.close()
    r, every = Reader(f"file://{tmp_path}/a/x.bin"), np.concatenate([x for _, x in docs])
    for a, b in ((0, 0), (0, len(every)), (4090, 4110), (299_999, 310_000), (len(every) - 1, len(every))):
        assert (r.tokens(a, b) == every[a:b]).all()
    for at_once in (1, 5000, 1 << 20):
        assert [(i, x.tolist()) for i, _, x in r.documents(at_once)] == [(i, x.tolist()) for i, x in docs]


def test_same_ids_as_library():
    coder, library = ByteBpe(PATH), Tokenizer.from_file(PATH)
    for t in TEXTS:
        assert coder.encode(t or "").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_same_ids_as_library_on_random_texts():
    """Both encoders, ordinary texts and runs around LONG_RUN."""
    import random

    from tallybrook.llm.byte_bpe import LONG_RUN

    coder, library, rng = ByteBpe(PATH), Tokenizer.from_file(PATH), random.Random(4)
    parts = ["a", "b", " ", "\n", "'", "s", "é", "1", "  ", "\t", "\xa0", "\x1c", "\x85", "中", "<|endoftext|>", ".", "T", "'ll", "\u0301", "ſ", "𝟙", "\u2003", "<|", "Σ", "İ", "the", "ing", " tion", "\r\n", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(6000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x3000, 0x30FF), rng.randrange(0x1F300, 0x1F400)])) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for n in (LONG_RUN - 1, LONG_RUN, LONG_RUN + 1, 3 * LONG_RUN):
        texts += ["ab" * (n // 2) + "c" * (n % 2), " " * n, "\n" * n, "x" * n + " y", "é" * n, "q " + " " * n + "z <|endoftext|>"]
    for t in texts:
        assert coder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]
    library.encode_special_tokens = True
    for t in texts:
        assert coder.encode_ordinary(t).tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]


def test_ids_that_fill_files(spark):
    """Null and repeated ids have the rows of several files, which are split; long texts pass through."""
    rows = [(None, f"no id {k}") for k in range(50)] + [(5, f"again {k} " * (k % 3)) for k in range(50)] + [(i, "x" * 2500 if i % 5 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in token_files(df, PATH, 2, rows_per_file=10).orderBy("start").collect()]
    library = Tokenizer.from_file(PATH)
    coded = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in rows]
    assert sorted(map(str, [(i, len(x), zlib.crc32(x.tobytes())) for i, x in coded])) == sorted(str((i, n, c)) for i, _, n, c in got)
    assert [s for _, s, _, _ in got] == np.cumsum([0, *(n for _, _, n, _ in got)])[:-1].tolist()
    ids = [(i is not None, i or 0) for i, _, _, _ in got]
    assert ids == sorted(ids)
    files = TokenFiles(PATH, 2, rows_per_file=10).write(df, f"file://{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/filled")
    assert files.count() > 8 and max(r.n_docs for r in files.collect()) < 40


def test_query_against_brute_force(spark):
    rows = [(i * 7 % 11, t, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", "s"), (3, "again", "s"), (3, "again", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = [tuple(r) for r in token_files(df, PATH, 2, rows_per_file=4).orderBy("start").collect()]
    library = Tokenizer.from_file(PATH)
    want, start = [], 0
    coded = sorted(((i is not None, i or 0, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t, _ in rows), key=lambda x: (x[:2], x[2].astype("<u2").tobytes()))
    for known, i, ids in coded:
        want.append((i if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(spark):
    assert token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0
