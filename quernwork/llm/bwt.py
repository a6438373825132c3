"""Burrows-Wheeler transforms of shards, and merging them without sorting again.

A shard is a text of pieces, each closed by a byte that no UTF-8 text holds, and read
as a ring. Its suffixes are sorted once, by itself. Two or more shards are merged by
refining an interleave: in which order the sorted suffixes of the shards take turns.
At first nothing is compared. Each round puts the symbols before the suffixes, taken in
the order so far, into stable order; that is the order by two more bytes, since a symbol
here is the pair of bytes before a suffix. Where neighbours differ is noted, so the
rounds also give common prefixes: suffixes in one interval after n rounds share 2n bytes.
"""

from __future__ import annotations

import numpy as np

# Closes a piece; in no UTF-8 text.
END = 0xFF


class Shard:
    """A text of closed pieces, its sorted suffixes, and the pairs of bytes before them."""

    def __init__(self, pieces: list[bytes]) -> None:
        closed = bytes([END])
        self.text = np.frombuffer(closed.join(pieces) + closed, np.uint8)
        self.suffixes = _sorted_suffixes(self.text)
        before = self.text.astype(np.uint16)
        pairs = (np.roll(before, 2) << np.uint16(8)) | np.roll(before, 1)
        self.transform = pairs[self.suffixes]


def _sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Where the suffixes of the ring begin, in their order, by doubling prefixes."""
    n, size = len(text), 8
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key = (key << np.uint64(8)) | np.roll(text, -i)
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        step = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        if step[-1] == n - 1 or size >= n:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = step
        key = (rank << np.uint64(32)) | np.roll(rank, -(size % n))
        size *= 2


def interleave(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order to ``depth`` bytes (even): suffixes, and their intervals.

    Suffixes are numbered through the shards. Those of one interval have the first
    ``depth`` bytes in common, others differ in them.
    """
    n = sum(len(s.text) for s in shards)
    turn = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.text) for s in shards])
    interval = np.zeros(n, np.int32)
    symbols = np.empty(n, np.uint16)
    edge = np.ones(n, bool)
    for _ in range(depth // 2):
        for i, shard in enumerate(shards):
            symbols[turn == i] = shard.transform
        order = np.argsort(symbols, kind="stable")
        turn, interval, moved = turn[order], interval[order], symbols[order]
        np.not_equal(moved[1:], moved[:-1], out=edge[1:])
        edge[1:] |= interval[1:] != interval[:-1]
        interval = np.cumsum(edge, dtype=np.int32)
        if interval[-1] == n:
            break
    merged, offset = np.empty(n, np.int64), 0
    for i, shard in enumerate(shards):
        merged[turn == i] = shard.suffixes + offset
        offset += len(shard.text)
    return merged, interval
