"""Ratcliff/Obershelp similarity of long texts by suffix automata.

The longest block that two stretches share is found in one scan: an automaton of the second
stretch's runs of characters that are not popular is walked by the first. Its states know the
first place at which their strings end, so of equally long blocks the first in both texts is
taken, as the standard library's matcher does. The block is widened by equal characters on either
side, and the stretches before and after it are matched in the same way. A level of that reads
each stretch once; the standard matcher compares each character with all its equals.
"""

from __future__ import annotations

from collections import Counter

#: From this length of the second text on, characters that make up over a hundredth of it (and one) begin no block.
LONG = 200


def popular(b: str) -> frozenset[str]:
    if len(b) < LONG:
        return frozenset()
    most = len(b) // 100 + 1
    return frozenset(c for c, n in Counter(b).items() if n > most)


class Automaton:
    """All substrings of b[lo:hi] without popular characters, with the first place where each ends."""

    def __init__(self, b: str, lo: int, hi: int, skip: frozenset[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for j in range(lo, hi):
            last = 0 if b[j] in skip else self._add(last, b[j], j)

    def _new(self, size: int, end: int, link: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.end.append(end)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        """A state for the strings of q that are no longer than p's and c."""
        clone = self._new(self.size[p] + 1, self.end[q], self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, c: str, j: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier run has this string
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        new = self._new(self.size[last] + 1, j, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return new

    def longest(self, a: str, lo: int, hi: int) -> tuple[int, int, int]:
        """(start in a, start in b, size) of the longest string of a[lo:hi] that is in the automaton; size 0 if none."""
        edges, link, size, end = self.next, self.link, self.size, self.end
        state = length = 0
        best = (lo, -1, 0)
        for i in range(lo, hi):
            c = a[i]
            to = edges[state].get(c)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = edges[state].get(c)
            if to is None:
                length = 0
                continue
            state = to
            length += 1
            if length > best[2]:
                best = (i - length + 1, end[state] - length + 1, length)
        return best


def matched(a: str, b: str) -> int:
    """How many characters the matching blocks of a and b hold."""
    skip = popular(b)
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, size = _block(a, b, alo, ahi, blo, bhi, skip)
        if size:
            total += size
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
    return total


def _same_ahead(a: str, b: str, i: int, j: int, most: int) -> int:
    """How many characters from i and j on are equal, by doubling and halving."""
    step, n = 16, 0
    while n < most and step:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        else:
            step //= 2
    return n


def _block(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int, skip: frozenset[str]) -> tuple[int, int, int]:
    if a[alo:ahi] == b[blo:bhi] and not any(c in skip for c in b[blo:bhi]):
        return alo, blo, ahi - alo
    i, j, size = Automaton(b, blo, bhi, skip).longest(a, alo, ahi)
    if not size:
        i, j = alo, blo
    while i > alo and j > blo and a[i - 1] == b[j - 1]:
        i, j, size = i - 1, j - 1, size + 1
    size += _same_ahead(a, b, i + size, j + size, min(ahi - i, bhi - j) - size)
    return i, j, size


def ratio(a: str, b: str) -> float:
    """Twice the matched characters over all; 1 for two empty texts. Not symmetric."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0
