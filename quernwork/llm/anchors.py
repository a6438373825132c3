"""Cutting texts into runs of windows by anchors that depend on the windows alone.

The anchor of a window of 100 bytes is the least hash of the grams of 32 bytes in it.
Equal windows have equal anchors, wherever they are. Windows in a row with one anchor
make a run, some 35 on average.
"""

from __future__ import annotations

import numpy as np

WINDOW = 100
GRAM = 32
# Grams in a window, and the most windows of a run; longer runs are cut.
SPAN = WINDOW - GRAM + 1


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of every gram, by doubling its length."""
    found = text.astype(np.uint64) + np.uint64(1)
    factor, size = 0x100000001B3, 1
    while size < GRAM:
        power = np.uint64(pow(factor, size, 1 << 64))
        found = found[:-size] * power + found[size:]
        size *= 2
    found ^= found >> np.uint64(31)
    found *= np.uint64(0x9E3779B97F4A7C15)
    return found ^ (found >> np.uint64(29))


def _least(values: np.ndarray, width: int, take=np.minimum) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        values = take(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return take(values[:-rest], values[rest:]) if rest else values


def runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a text of ``WINDOW`` bytes or more.

    Anchors, first windows, numbers of windows, and whether the anchor occurs more
    than once within the run, so that windows of the run may be equal to one another.
    """
    grams = gram_hashes(text)
    anchors = _least(grams, SPAN)
    n = len(anchors)
    change = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
    first = np.concatenate([[0], change])
    count = np.diff(np.concatenate([first, [n]]))
    anchor = anchors[first]
    # Where a gram is the anchor of some window: the greatest anchor of its windows.
    ends = np.full(SPAN - 1, 0, np.uint64)
    at = np.flatnonzero(_least(np.concatenate([ends, anchors, ends]), SPAN, np.maximum) == grams)
    low = np.searchsorted(at, first)
    high = np.searchsorted(at, first + count - 1 + SPAN)
    seen = np.zeros(len(first), np.int32)
    for step in range(int(np.minimum(high - low, SPAN).max())):
        inside = np.minimum(low + step, len(at) - 1)
        seen += (low + step < high) & (grams[at[inside]] == anchor)
    several = (seen > 1) | (count > SPAN)
    if count.max() > SPAN:
        pieces = -(-count // SPAN)
        which = np.repeat(np.arange(len(first)), pieces)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        anchor, several = anchor[which], several[which]
        first, count = first[which] + inside * SPAN, count[which] - inside * SPAN
        count = np.minimum(count, SPAN)
    return anchor, first, count, several
