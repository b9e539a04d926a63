"""A run-length index of a text: its Burrows-Wheeler transform by runs, suffix positions at run ends, and the text's matching statistics by streaming.

The text is a row of pieces, each closed by a separator of its own that never matches. Kept per run: its byte, its first row, the text position of
its first suffix, the text position of the last suffix of the run before, and how many bytes these two have in common. Nothing is kept per row
or per text byte, so the index grows with the runs: copies of a piece add next to none.

Suffixes that are neighbours in order stay neighbours one byte further on, with one byte less in common, until the transform changes there; so
from one sample on, up to the next sample in the text, each position's neighbour and what it has in common with it follow by counting.
Streamed in text order, the samples thus give every position's matching statistic against all the rest of the text: the longest
match is with the neighbour before or the one after. Positions with the same next `length` bytes are linked through neighbours.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    def __init__(self, pieces: list[np.ndarray]):
        """pieces: byte arrays."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.size = int(self.starts[-1])
        text = np.zeros(self.size, np.int64)  # bytes are 1 to 256, separators 0
        for p, at in zip(pieces, self.starts, strict=False):
            text[at : at + len(p)] = p.astype(np.int64) + 1
        order = _suffixes(text)
        before = text[order - 1]
        edge = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])) if len(text) else np.zeros(0, np.int64)
        self.byte, self.first = before[edge].astype(np.uint16), edge.astype(np.int32)
        head, tail = order[edge], order[edge - 1]
        shared = _common(text, tail, head)
        shared[:1] = 0  # the first suffix has none before it
        turn = np.argsort(head)
        self.at, self.near, self.shared = head[turn].astype(np.int32), tail[turn].astype(np.int32), shared[turn].astype(np.int32)

    @property
    def stored(self) -> int:
        """Bytes that the index keeps."""
        return sum(x.nbytes for x in (self.byte, self.first, self.at, self.near, self.shared))

    def matches(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Text positions, rising, whose suffix has at least `length` bytes in common with its neighbour before, and that neighbour's position."""
        reach = np.diff(np.concatenate([self.at, [self.size]]))  # positions that follow from a sample
        many = np.clip(self.shared - length + 1, 0, reach)
        of = np.repeat(np.arange(len(many)), many)
        on = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        return self.at[of] + on, self.near[of] + on

    def statistics(self) -> np.ndarray:
        """Each position's longest match that starts elsewhere in the text, in bytes."""
        at, near = self.matches(1)
        reach = np.diff(np.concatenate([self.at, [self.size]]))
        own = np.repeat(self.shared + self.at, reach)[at] - at  # text position 0, after a separator, is the first sample
        out = np.zeros(self.size, np.int64)
        np.maximum.at(out, at, own)
        np.maximum.at(out, near, own)
        return out

    def late(self, length: int) -> np.ndarray:
        """Positions, rising, whose next `length` bytes also start at a smaller position."""
        at, near = self.matches(length)
        places = np.union1d(at, near)
        link = np.arange(len(places))
        link[np.searchsorted(places, at)] = np.searchsorted(places, near)
        while (link[link] != link).any():  # up the chain of neighbours to the first one in order
            link = link[link]
        least = np.full(len(places), self.size, np.int64)
        np.minimum.at(least, link, places)
        return places[places > least[link]]


def _suffixes(text: np.ndarray) -> np.ndarray:
    """All suffixes in order; each separator is a symbol of its own, so none are equal."""
    n, ends = len(text), text == 0
    symbol = np.where(ends, np.cumsum(ends) - 1, text - 1 + ends.sum())
    bits = int(ends.sum() + 256).bit_length()
    depth = 62 // bits
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key[: max(0, n - k)] |= symbol[k:] << (bits * (depth - 1 - k))
    while True:
        order = np.argsort(key)
        new = np.concatenate([[0], (key[order][1:] != key[order][:-1]).cumsum()])
        if n == 0 or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        key[: max(0, n - depth)] += rank[depth:] + 1
        depth *= 2


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths to which the suffixes at a and b agree; separators agree with nothing."""
    out, live, k = np.zeros(len(a), np.int64), np.flatnonzero(a != b), 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        inside = (x < len(text)) & (y < len(text))
        live, x, y = live[inside], x[inside], y[inside]
        live = live[(text[x] == text[y]) & (text[x] > 0)]
        k += 1
        out[live] = k
    return out
