"""Byte-pair merging of one string, shared by the two tokenizer operators."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable

#: Above this many symbols a heap finds the next merge.
SHORT = 48
#: Entries of a young half of a Memory, and the longest key that it keeps.
REMEMBER, LONGEST = 1 << 17, 64


class Memory(dict):
    """Remembers ``work`` of the keys asked for, within bounds.

    A full memory becomes its older half and starts anew; what is asked for again comes back from there, so that frequent
    keys stay. Results don't depend on what it holds.
    """

    def __init__(self, work: Callable[[Hashable], object], most: int = REMEMBER):
        super().__init__()
        self.work, self.most, self.old = work, most, {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        got = self.old.get(key)
        if got is None:
            got = self.work(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


    def forget(self) -> None:
        self.clear()
        self.old = {}


def merged(symbols: list[str], rank: Callable[[str, str], float | None]) -> list[str]:
    """Joins the adjacent pair of least rank, the leftmost of equals, until no pair has a rank."""
    return _by_scan(list(symbols), rank) if len(symbols) <= SHORT else _by_heap(symbols, rank)


def _by_scan(s: list[str], rank: Callable[[str, str], float | None]) -> list[str]:
    ranks = [rank(a, b) for a, b in zip(s, s[1:], strict=False)]
    while True:
        best = at = None
        for i, r in enumerate(ranks):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at is None:
            return s
        s[at : at + 2] = [s[at] + s[at + 1]]
        del ranks[at]
        if at:
            ranks[at - 1] = rank(s[at - 1], s[at])
        if at < len(ranks):
            ranks[at] = rank(s[at], s[at + 1])


def _by_heap(symbols: list[str], rank: Callable[[str, str], float | None]) -> list[str]:
    n = len(symbols)
    text, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, str, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (r := rank(text[i], text[j])) is not None:
            heapq.heappush(heap, (r, i, text[i], text[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if text[i] != a or j < 0 or text[j] != b:
            continue  # one of the two has changed meanwhile
        text[i], text[j] = a + b, ""
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i], i)
        offer(i, right[i])
    return [t for t in text if t]
