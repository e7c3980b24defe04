"""Byte-level BPE ids as the tokenizers library gives them for a vocabulary file.

The library spends most of its time on offsets that nothing here needs.  The vocabulary file is
therefore read into tiktoken's merge core, whose ids are the same (tests compare the two); texts with a
run of over LONG_RUN characters without a space, where that core is slow, go to the library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pre-tokenizer's pattern for this kind of vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_RUN = 2_000
_ODD_SPACE = re.compile(r"[^\S ]")
_LONG = re.compile(rf"[^ ]{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocabulary.items() if token not in specials}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.specials = frozenset(specials)
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)  # of ids, in bytes
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.size = self.library.get_vocab_size(with_added_tokens=True)

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids of a text; special tokens' strings in it become their ids, none are added."""
        if not text:
            return np.zeros(0, np.uint32)
        if len(text) > LONG_RUN and _LONG.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.core.encode_to_numpy(text, allowed_special=self.specials, disallowed_special=())

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of words with a space before each, one after another, and how many each has, as encode_ordinary() gives them alone.

        Pieces begin at spaces, so the words are read as one text.  None where that may differ: words that hold white
        space of other kinds or no UTF-8, and long ones.
        """
        ids = self.ids_of_words(words)
        if ids is None:
            return None
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        upto = np.searchsorted(np.cumsum(self.lengths.take(ids)), np.cumsum(sizes + 1)) + 1
        return ids, np.diff(upto, prepend=0)

    def ids_of_words(self, words: list[bytes]) -> np.ndarray | None:
        """The ids of encode_words() alone, or None where it gives none."""
        if not words or not all(words) or len(max(words, key=len)) >= LONG_RUN:
            return None
        try:
            text = " " + b" ".join(words).decode()
        except UnicodeDecodeError:
            return None
        if _ODD_SPACE.search(text):
            return None
        return self.core.encode_to_numpy(text, allowed_special=frozenset(), disallowed_special=())

    def encode_ordinary(self, text: str) -> np.ndarray:
        """As encode(), but special tokens' strings are ordinary text."""
        if len(text) > LONG_RUN and _LONG.search(text):
            self.library.encode_special_tokens = True
            try:
                return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            finally:
                self.library.encode_special_tokens = False
        return self.core.encode_to_numpy(text, allowed_special=frozenset(), disallowed_special=())


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
