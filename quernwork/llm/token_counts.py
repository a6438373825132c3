"""Counting the tokens of whole texts, huge ones in overlapping chunks.

A space before anything but white space always begins a piece of its own, whatever
stands around it: no rule of the splitting pattern takes such a space but as its
first character, and no special token holds a space. Nothing merges across pieces.
So where two encodings of overlapping chunks both begin a token at such a space,
away from the ends of the chunks, the first may be left and the second taken up.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# Longer texts are encoded in chunks of this many characters, which overlap by that many.
CHUNK = 32_768
OVERLAP = 512
# Characters at the ends of a chunk where no splice is made; above the length of any
# special token.
MARGIN = 64
# Words with their counts that a worker keeps, in each of two generations.
MOST_WORDS = 300_000

_UNSURE = re.compile(r" (?:\s|\Z)")


class Counter(dict):
    """Counts by the library; as a dict, words that follow a space with their counts."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if any(len(t.content) >= MARGIN or " " in t.content for t in self.library.get_added_tokens_decoder().values()):
            raise ValueError("a special token is too long, or holds a space")
        self.chunk, self.overlap, self.older = chunk, overlap, {}

    def _encoded(self, texts: list[str]) -> list[int]:
        batch = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [len(found) for found in batch]

    def __missing__(self, word: str) -> int:
        found = self.older.get(word)
        if found is None:
            found = self._encoded([f" {word}"])[0]
        if len(word) <= 64:
            self[word] = found
        return found

    def _learn(self, words: set[str]) -> None:
        """Count all new words in one call of the library."""
        new = [w for w in words if w not in self and w not in self.older and len(w) <= 64]
        if len(self) + len(new) > MOST_WORDS:
            self.older = dict(self)
            self.clear()
        self.update(zip(new, self._encoded([f" {w}" for w in new])))

    def _starts(self, text: str, start: int, end: int) -> np.ndarray:
        """Where the tokens of ``text[start:end]`` begin, in characters of ``text``."""
        found = self.library.encode(text[start:end], add_special_tokens=False)
        return np.array([o[0] for o in found.offsets], np.int64) + start

    def _chunked(self, text: str) -> int:
        """Tokens of a huge text from chunks spliced at stable common boundaries."""
        start, size, overlap, total, spliced = 0, self.chunk, self.overlap, 0, 0
        left = self._starts(text, start, start + size)
        while start + size < len(text):
            end = start + size
            begin = max(start + 1, end - overlap)
            right = self._starts(text, begin, begin + max(self.chunk, 2 * overlap))
            common = np.intersect1d(left, right)
            common = common[(common >= max(begin + MARGIN, spliced)) & (common < end - MARGIN)]
            at = next((p for p in common[::-1].tolist() if text[p] == " " and not text[p + 1].isspace()), None)
            if at is not None:
                total += int(np.searchsorted(left, at) - np.searchsorted(left, spliced))
                left, start, spliced = right, begin, at
                size, overlap = max(self.chunk, 2 * overlap), self.overlap
            elif overlap < size // 2:
                overlap *= 2
            else:
                # No boundary in half the chunk: take a larger one from where it starts.
                size *= 2
                left = self._starts(text, start, start + size)
        return total + len(left) - int(np.searchsorted(left, spliced))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(text) > self.chunk:
            return self._chunked(text)
        if _UNSURE.search(text):
            return self._encoded([text])[0]
        first, *words = text.split(" ")
        return self._encoded([first])[0] + sum([self[w] for w in words])

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of every text. Words between stable boundaries are encoded once each."""
        plain = (t for t in texts if t and len(t) <= self.chunk and not _UNSURE.search(t))
        words: set[str] = set()
        for text in plain:
            words.update(text.split(" ")[1:])
        self._learn(words)
        return [self.count(t) for t in texts]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker and vocabulary."""
    return Counter(path)


def token_count(text: Column, path: str) -> Column:
    """How many tokens the ``tokenizers`` library makes of every text, as a long.

    By the byte-level vocabulary in ``path``, without added special tokens; strings
    of special tokens inside texts are the special tokens, as the library has it.
    Texts of any length are counted whole: those above ``CHUNK`` characters in
    overlapping chunks, spliced only at boundaries that are proved stable, with
    wider overlaps and larger chunks where there is none. 0 for null and empty texts.
    """

    @arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path).counts(texts.to_pylist()), pa.int64())

    return run(text)
