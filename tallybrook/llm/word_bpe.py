"""BPE over words with a word-end mark: encoding by a prefix-sharing trie, and decoding (operator 3).

The last token of a prefix's encoding is one particular suffix of that prefix: the suffix token that may stand
after the last token of what precedes it.  So the encoding of any string is a chain of last tokens, and
strings that share a prefix share the chain up to there.  The distinct words of a batch go into one trie; a
depth-first walk gives every node its last token from its ancestors' ones, once, and a word's ids are read off
by following the chain back from its end.

Two tokens may stand side by side if the merges that built them would not have joined anything across their
seam first.  That is found by undoing the merges next to the seam, latest first.

Defined results: a null or empty text has no ids and decodes to nothing; words and texts of any length take the same way;
rows that share a doc_id, or have none, pass through one by one, repeated ones alike; an empty table gives no rows; of
equal merges the left one is made first; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import byte_letters
from .common import tidied

#: Fixed value: the pre-tokenizer's pattern for this kind of vocabulary.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-ɏ]+")


class WordBpe:
    """limit: words and chunks that a worker keeps, in two generations each."""

    def __init__(self, path: str, limit: int = 200_000):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end, self.ids = model["end_of_word_suffix"], model["vocab"]
        specials = self.library.get_added_tokens_decoder()
        self.specials = {t.content: i for i, t in specials.items()}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.texts = [b""] * (max([*self.ids.values(), *specials]) + 1)
        for token, i in [*self.ids.items(), *((t.content, i) for i, t in specials.items())]:
            self.texts[i] = token.encode()
        self.rank, self.left, self.right = {}, {}, {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[x, y] = k
            self.left[z], self.right[z] = (x, k), (y, k)
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        letters = byte_letters()
        self.byte_letters = letters
        self.fits: dict[int, bool] = {}
        self.limit = limit
        self.words, self.older_words = {}, {}
        self.chunks, self.older_chunks = {}, {}

    # Encoding

    def _fit(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's characters together is a, b."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * self.limit:
                self.fits.clear()
            known = self.fits[key] = self._seam(a, b)
        return known

    def _seam(self, a: int, b: int) -> bool:
        """Goes back in time: a merge across the seam is wrong if it comes before the merges that have not been undone yet."""
        never = len(self.rank)
        x, y, before_x, before_y = a, b, never, never
        # x is the token at the end of a, until the merge before_x takes it; y likewise at b's start.
        while True:
            k = self.rank.get((x, y), never)
            # Of equal merges the left one is made first: x's own next merge lies left of the seam, y's right of it.
            if k < before_x and k <= before_y:
                return False
            inner_x, inner_y = self.right.get(x), self.left.get(y)
            if inner_x is None and inner_y is None:
                return True
            if inner_y is None or (inner_x is not None and inner_x[1] > inner_y[1]):
                x, before_x = inner_x
            else:
                y, before_y = inner_y

    def encode_words(self, words: set[str]) -> None:
        """Puts the ids of byte-lettered words into the store."""
        root: dict = {}
        for w in words:
            node = root
            for c in w[:-1]:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(w)  # its last character has the word-end mark and is no inner node
        # chain[d]: (last token, depth before it) of the prefix of length d on the current path.
        path: list[str] = []
        chain: list[tuple[int, int]] = [(-1, 0)]
        stack = [iter(root.items())]
        while stack:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if path:
                    path.pop()
                    chain.pop()
                continue
            c, below = step
            if c == "":
                prefix = "".join(path[1 - self.longest :]) if self.longest > 1 else ""  # no token is longer
                for w in below:
                    self.words[w] = self._read(chain, self._last(prefix + w[-1], self.end, chain))
            else:
                path.append(c)
                chain.append(self._last("".join(path[-self.longest :]), "", chain))
                stack.append(iter(below.items()))

    def _last(self, prefix: str, mark: str, chain: list[tuple[int, int]]) -> tuple[int, int]:
        """The last token of a prefix (or its tail), and the depth before it; chain has all shorter prefixes."""
        n, ids, depth = len(prefix), self.ids, len(chain)
        for size in range(1, min(n, self.longest) + 1):
            t = ids.get(prefix[n - size :] + mark)
            if t is not None:
                before = depth - size
                if before == 0 or self._fit(chain[before][0], t):
                    return t, before
        raise ValueError(f"no token ends {prefix[-20:]!r}")

    @staticmethod
    def _read(chain: list[tuple[int, int]], last: tuple[int, int]) -> bytes:
        out = [last[0]]
        while last[1]:
            last = chain[last[1]]
            out.append(last[0])
        return np.array(out[::-1], "<u4").tobytes()

    def _pieces(self, chunk: str) -> list[str]:
        """Byte-lettered words of a chunk without white space or special tokens."""
        if _PLAIN.fullmatch(chunk):
            found = _PIECES.findall(chunk.lower())
            return [p if p.isascii() else "".join(map(self.byte_letters.__getitem__, p.encode())) for p in found]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def _cut(self, chunk: str) -> list:
        """Words (byte-lettered) and special ids of a chunk."""
        if "<|" not in chunk:
            return self._pieces(chunk)
        out: list = []
        for part in self.special_cut.split(chunk):
            out += [self.specials[part]] if part in self.specials else self._pieces(part) if part else []
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [_chunks(t or "") for t in texts]
        new = {c for cs in cut for c in cs if c not in self.chunks}
        for c in [c for c in new if c in self.older_chunks]:
            self.chunks[c] = self.older_chunks[c]
            new.discard(c)
        made = {c: self._cut(c) for c in new}
        need = {w for ws in made.values() for w in ws if isinstance(w, str) and w not in self.words}
        for w in [w for w in need if w in self.older_words]:
            self.words[w] = self.older_words[w]
            need.discard(w)
        self.encode_words(need)
        for c, ws in made.items():
            self.chunks[c] = b"".join([self.words[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in ws])
        get = self.chunks.__getitem__
        out = [b"".join(map(get, cs)) for cs in cut]
        if len(self.chunks) > self.limit:
            self.older_chunks, self.chunks = self.chunks, {}
        if len(self.words) > self.limit:
            self.older_words, self.words = self.words, {}
        return out

    # Decoding

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: the file names no decoder, so tokens stand apart by a space."""
        return b" ".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _chunks(text: str) -> list[str]:
    """Runs without white space.  Control characters 1C to 1F are space to str.split, but not to the pattern."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in regex.split(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text) if c]
    return text.split()


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


#: Texts that are encoded together: their new words share a trie.
TOGETHER = 512


def _parts(texts: list[str | None]):
    """Slices of at most TOGETHER texts and about 8 million characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start == TOGETHER or size > 8_000_000):
            yield texts[start:i]
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield texts[start:]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian uint32) of every row; a null or empty text has no ids.

    No shuffle: each task encodes the rows it reads.  Repeated, null and clashing ids pass through row by row.
    """

    def run(batches):
        coder = load(path)
        for b in batches:
            out = [x for part in _parts(b.column(1).to_pylist()) for x in coder.encode_batch(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), "doc_id long, ids binary")


def report(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from the ids; with ids, these too (binary)."""

    def run(batches):
        coder = load(path)
        for b in batches:
            kept = [x for part in _parts(b.column(1).to_pylist()) for x in coder.encode_batch(part)]
            out = {
                "doc_id": b.column(0), "n_tokens": pa.array([len(x) // 4 for x in kept], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in kept], pa.string()),
            }
            if ids:
                out["ids"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids)
