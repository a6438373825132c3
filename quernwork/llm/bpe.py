"""Byte-level BPE as a transducer that is made deterministic while it runs.

The tokens of a text's first n bytes end in exactly one token that may follow the token
before it. So a left-to-right reader needs no merges: at every byte it finds the one
token that ends here and may follow the token that ends where it begins.

What the reader must know of the bytes so far is the longest end of them with which a
token may still begin. These ends are the states of a finite transducer. Which one
follows on a byte, and which tokens end there, is worked out when a text first asks.

A token may begin only at the end of the text or within its state, and all tokens before
those places agree from some place back. They are sure, and emitted; as no state is as
long as the longest token, the reader looks ahead no further than that.
"""

from __future__ import annotations

import base64
import re
import string
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# Pairs of tokens, and texts with their tokens in each of two generations, that a
# worker keeps if no other number is given; beyond that older ones are forgotten, which
# changes no token.
MOST_PAIRS = 400_000
MOST_TEXTS = 100_000
# Tokens decoded at a time.
DECODED = 4096

# Bytes at the beginning of a piece that are read once for all pieces that share them,
# and how many such beginnings a worker keeps.
BEGINNING = 6
MOST_BEGINNINGS = 50_000
# Bytes of a piece after which sure tokens are emitted.
EMITTED = 4096

# Fixed value. The pattern under which a space before anything but white space always
# begins a match: no alternative takes such a space but as its first character, and
# what stands before it is split the same whether the text ends there or goes on with
# a space. So the words between may be split one by one.
SPACED_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# A space for which that does not hold.
_UNSURE = re.compile(r" (?:\s|\Z)")
# Marks, of which no run after letters is split or taken up by them if no letter follows.
_MARKS = string.punctuation


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as file:
        pairs = (line.split() for line in file)
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], tuple | None]:
    """The tokens of a short piece by merging pairs, lowest rank first: the definition.

    Also the last two tokens that were merged, if they make up the piece.
    """
    parts, last = [piece[i : i + 1] for i in range(len(piece))], None
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return parts, last
        _, i = min(pairs)
        last = tuple(parts) if len(parts) == 2 else None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


# Where each byte leads, as far as texts have asked; the tokens that end here with their
# lengths, the longest first, and the tokens that they may follow or not; and the bytes
# that the state stands for.
State = tuple[dict[int, "State"], list[tuple[int, int, set[int], set[int]]], bytes]


class Transducer:
    """Merges compiled to what may follow what, and the moves made so far."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # A token that merging does not make out of its own bytes is a token only
        # where it is a whole piece. The others are split where they were last merged.
        self.whole_only: dict[bytes, int] = {}
        self.split: dict[bytes, tuple[bytes, bytes]] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts, last = merged(token, ranks)
                if parts == [token]:
                    self.split[token] = last
                else:
                    self.whole_only[token] = rank
        # Merges run in the order of ranks only if no token has a part of higher rank.
        self.ordered = all(ranks[p] < ranks[t] or len(p) == 1 for t, two in self.split.items() for p in two)
        self.edges: dict[tuple[int, int], list] = {}
        self.begun = {token[:end] for token in ranks for end in range(len(token) + 1)}
        # For each token those that it may follow, and those that it may not.
        self.fits: dict[int, tuple[set[int], set[int]]] = {}
        self.pairs = 0
        # States by the bytes they stand for.
        self.states: dict[bytes, State] = {}
        self.start = self._state(b"")
        # Beginnings of pieces, read already.
        self.beginnings: dict[bytes, tuple[list[int], State]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at one end of a token while it is being merged.

        From its outermost byte to itself, each with the rank of the merge that
        takes it up. ``side`` is 0 for the left end and 1 for the right.
        """
        found = self.edges.get((token, side))
        if found is None:
            part, until, found = self.tokens[token], float("inf"), []
            while True:
                found.append((part, until))
                if len(part) == 1:
                    break
                until, part = self.ranks[part], self.split[part][side]
            found.reverse()
            self.edges[token, side] = found
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens are these two tokens.

        They are unless some merge joins what stands on both sides of the seam
        before either is taken up by its own token. Of equal merges the left one
        comes first.
        """
        if self.ordered:
            known, ends, begins = True, self._edge(left, 1), self._edge(right, 0)
            i = j = 0
            while known and (i < len(ends) and j < len(begins)):
                (end, end_until), (begin, begin_until) = ends[i], begins[j]
                across = self.ranks.get(end + begin, float("inf"))
                if across < end_until and across <= begin_until:
                    known = False
                elif end_until <= begin_until:
                    i += 1
                else:
                    j += 1
        else:
            pair = [self.tokens[left], self.tokens[right]]
            known = merged(b"".join(pair), self.ranks)[0] == pair
        if self.pairs > MOST_PAIRS:
            for sets in self.fits.values():
                for one in sets:
                    one.clear()
            self.pairs = 0
        self.pairs += 1
        self.fits[right][0 if known else 1].add(left)
        return known

    def _state(self, text: bytes) -> State:
        found = self.states.get(text)
        if found is None:
            ends = [text[i:] for i in range(len(text))]
            tokens = [self.ranks[t] for t in ends if t in self.ranks and t not in self.whole_only]
            ending = [(t, len(self.tokens[t]), *self.fits.setdefault(t, (set(), set()))) for t in tokens]
            found = self.states[text] = ({}, ending, text)
        return found

    def move(self, state: State, byte: int) -> State:
        """The state after one more byte."""
        text = state[2] + bytes([byte])
        while text not in self.begun:
            text = text[1:]
        found = state[0][byte] = self._state(text)
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece, which nothing merges across."""
        whole = self.whole_only.get(piece)
        if whole is not None:
            return (whole,)
        # The token that ends at each place since the last emitted one, which is the
        # first here; -1 stands at the beginning of the piece.
        # No token that ends later begins before it, so none is longer than this.
        if len(piece) <= BEGINNING:
            return tuple(self._chain(last := self._read(piece, [-1], self.start)[0], len(last) - 1))
        known = self.beginnings.get(piece[:BEGINNING])
        if known is None:
            if len(self.beginnings) >= MOST_BEGINNINGS:
                self.beginnings.clear()
            known = self._read(piece[:BEGINNING], [-1], self.start)
            self.beginnings[piece[:BEGINNING]] = known
        last, _ = self._read(piece[BEGINNING:], known[0].copy(), known[1], out := [])
        out += self._chain(last, len(last) - 1)
        return tuple(out)

    def _read(
        self, part: bytes, last: list[int], state: State, out: list[int] | None = None
    ) -> tuple[list[int], State]:
        """``last`` and ``state`` after some more bytes, what is sure emitted to ``out``."""
        for byte in part:
            state = state[0].get(byte) or self.move(state, byte)
            for token, length, after, never in state[1]:
                before = last[-length]
                if before < 0 or before in after:
                    break
                if before not in never and self.may_follow(before, token):
                    break
            else:
                raise ValueError(f"no token ends in byte {byte}: the vocabulary lacks single bytes")
            last.append(token)
            if len(last) > EMITTED:
                last = self._emit(last, state[2], out)
        return last, state

    def _chain(self, last: list[int], end: int) -> list[int]:
        """The tokens from the beginning of ``last`` up to the one that ends at ``end``."""
        found = []
        while end > 0:
            found.append(last[end])
            end -= len(self.tokens[last[end]])
        found.reverse()
        return found

    def _emit(self, last: list[int], text: bytes, out: list[int]) -> list[int]:
        """Emit the tokens on which all places agree where a token may still begin."""
        places = {len(last) - 1}
        for size in range(1, len(text) + 1):
            if text[len(text) - size :] in self.begun:
                places.add(len(last) - 1 - size)
        # Back from the latest of the places until they are one.
        while len(places) > 1:
            latest = max(places)
            places.remove(latest)
            places.add(latest - len(self.tokens[last[latest]]))
        (sure,) = places
        if sure <= 0:
            return last
        out += self._chain(last, sure)
        return last[sure:]


class Utf8Reader:
    """Text out of bytes that come in parts, which may end within a character.

    The state is the bytes of a character that has begun; a part is read up to the
    last byte that may begin an unfinished one. Bytes that are no UTF-8 become
    U+FFFD, as if all had been read at once.
    """

    def __init__(self) -> None:
        self.begun = b""

    def feed(self, part: bytes) -> str:
        part = self.begun + part
        cut = len(part)
        for back in range(1, min(4, cut + 1)):
            byte = part[-back]
            if byte >= 0xC0:
                length = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if length > back:
                    cut -= back
                break
            if byte < 0x80:
                break
        self.begun = part[cut:]
        return part[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.begun = self.begun, b""
        return rest.decode("utf-8", "replace")


class Known(dict):
    """A function's results for short texts: those used of late, in two generations."""

    def __init__(self, find: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.find(text)
        if len(text) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Codec:
    """Texts to tokens and back. Tokens are kept as the bytes of ints of 32 bits."""

    def __init__(self, path: str, pattern: str, texts: int = MOST_TEXTS) -> None:
        self.transducer = Transducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.spaced = pattern == SPACED_PATTERN
        self.piece = Known(self._piece, texts // 2)
        self.word = Known(self._after_space, texts)

    def _tokens(self, piece: str) -> bytes:
        return array("i", self.transducer.encode(piece.encode())).tobytes()

    def _piece(self, piece: str) -> bytes:
        # A word of letters is kept once, wherever it stands.
        if self.spaced and piece[0] == " " and piece[1:].isalpha():
            return self.word[piece[1:]]
        return self._tokens(piece)

    def _after_space(self, word: str) -> bytes:
        # Letters after a space are one piece, and so are the marks that end a word.
        if word.isalpha():
            return self._tokens(f" {word}")
        letters = word.rstrip(_MARKS)
        if letters.isalpha():
            return self.word[letters] + self.piece[word[len(letters) :]]
        return self._pieces(f" {word}")

    def _pieces(self, text: str) -> bytes:
        piece = self.piece
        return b"".join([piece[match] for match in self.split(text)])

    def encode(self, text: str) -> bytes:
        if not self.spaced or _UNSURE.search(text):
            return self._pieces(text)
        first, *words = text.split(" ")
        word = self.word
        return self._pieces(first) + b"".join([word[w] for w in words])

    def decode(self, ids: list[int]) -> Iterator[str]:
        """The text of ``ids``, a part at a time."""
        reader, tokens = Utf8Reader(), self.transducer.tokens
        for at in range(0, len(ids), DECODED):
            yield reader.feed(b"".join([tokens[i] for i in ids[at : at + DECODED]]))
        yield reader.finish()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, texts: int = MOST_TEXTS) -> Codec:
    """One codec per worker and vocabulary, with all states it has made."""
    return Codec(path, pattern, texts)


def encode(text: Column, path: str, pattern: str) -> Column:
    """The token ids of every text by the ranks in ``path``, an array of int.

    ``pattern`` splits the text; each match is encoded by itself and what no match
    covers is left out. Special tokens are not known here, their strings are
    ordinary text. Null and empty texts give an empty array; no texts give no rows. A
    text of any length is encoded whole, in one task.
    """

    @arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        known = codec(path, pattern)
        found = [known.encode(t) if t else b"" for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, found)]) // 4
        values = pa.array(np.frombuffer(b"".join(found), np.int32))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    return run(text)


def _lengths(arrays: pa.Array) -> list[int]:
    return pc.fill_null(pc.list_value_length(arrays), 0).to_pylist()


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The text that token ids stand for; empty for a null or empty array."""

    @arrow_udf("string")
    def run(arrays: pa.Array) -> pa.Array:
        known = codec(path, pattern)
        values, ends = arrays.flatten().to_numpy(), np.cumsum([0, *_lengths(arrays)])
        found = ["".join(known.decode(values[a:b].tolist())) for a, b in zip(ends, ends[1:])]
        return pa.array(found, pa.string())

    return run(ids)


def encode_proved(text: Column, path: str, pattern: str) -> Column:
    """``ids`` as ``encode`` gives them, and whether they decode to the text (``same``).

    Both in one place, so that a task needs one worker and one codec. Null and empty
    texts give no ids and are the same.
    """

    @arrow_udf("struct<ids: array<int>, same: boolean>")
    def run(texts: pa.Array) -> pa.Array:
        known = codec(path, pattern)
        rows = [t or "" for t in texts.to_pylist()]
        found = [np.frombuffer(known.encode(t), np.int32) for t in rows]
        same = ["".join(known.decode(f.tolist())) == t for f, t in zip(found, rows)]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int32), *found])
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "same"])

    return run(text)


def encode_decoded(text: Column, path: str, pattern: str, texts: int = MOST_TEXTS) -> Column:
    """``ids`` as ``encode`` gives them, and the text that they decode to (``decoded``).

    In one place: Spark would run ``encode`` once for its own column and once more for
    ``decode`` of it. Null and empty texts give no ids and the empty text. ``texts`` says
    how many short texts a worker keeps the tokens of.
    """

    @arrow_udf("struct<ids: array<int>, decoded: string>")
    def run(rows: pa.Array) -> pa.Array:
        known = codec(path, pattern, texts)
        found = [np.frombuffer(known.encode(t or ""), np.int32) for t in rows.to_pylist()]
        decoded = pa.array(["".join(known.decode(f.tolist())) for f in found], pa.string())
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int32), *found])
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        return pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])

    return run(text)
