"""A run-length index over byte strings, and matching statistics streamed through it.

The strings are joined, each closed by a separator, and their suffixes sorted (prefix doubling, as deep as the longest
query). The Burrows-Wheeler transform is kept as its runs: symbol, first row and last row of each, and the row its first row steps to. That is
enough to go from a row to the row of the suffix one symbol longer, and, where that symbol does not precede the row, to jump
to the run end with that symbol, before or after, which agrees longest; how long is the least of the common
prefixes of neighbouring rows in between.

Queries are streamed from right to left, all of them by one symbol at a time, so one numpy operation
serves every query. At each symbol a query has the length of its longest match and a row that holds it.
Rows with the same first ``width`` symbols are neighbours; each such group keeps the smallest place at which its string
starts, a sample of the suffix array.
"""

from __future__ import annotations

import numpy as np

NEVER = np.iinfo(np.int64).max
_PACKED, _BITS = 7, 9  # symbols in the first sort key, bits of one (257 symbols)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Order of the keys, dense ranks, and whether all differ."""
    order = np.argsort(key)
    new = np.empty(len(key), dtype=bool)
    new[:1] = False
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return order, rank, bool(new[1:].all())


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols at least, and how many symbols neighbours have in common."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(_PACKED, dtype=np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(_PACKED):
        key = (key << np.uint64(_BITS)) | padded[j : j + n]
    order, rank, done = _ranks(key)
    levels = [(_PACKED, rank)]
    while levels[-1][0] < depth and not done:
        size, rank = levels[-1]
        later = np.zeros(n, dtype=np.int64)
        later[: max(n - size, 0)] = rank[size:] + 1
        order, rank, done = _ranks(rank * (n + 1) + later)
        levels.append((2 * size, rank))
    common = np.zeros(n, dtype=np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for size, rank in reversed(levels):
        rank = np.concatenate([rank, np.full(depth + 4 * size, -1)])
        same = rank[a] == rank[b]
        step = np.where(same, size, 0)
        a, b, common[1:] = a + step, b + step, common[1:] + step
    symbols = np.concatenate([text, np.zeros(depth + 4 * levels[-1][0] + _PACKED, dtype=text.dtype)])
    live = np.arange(n - 1)
    for _ in range(_PACKED - 1):
        live = live[symbols[a[live]] == symbols[b[live]]]
        a[live] += 1
        b[live] += 1
        common[live + 1] += 1
    return order, np.minimum(common, depth)


class RunIndex:
    """Index of byte strings; ``places[i]`` is the place of string i's first byte, later bytes count on from it.

    ``width`` is the least length of interest, ``longest`` the length of the longest query.
    """

    def __init__(self, strings: list[bytes], places: np.ndarray, width: int, longest: int):
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        text = np.zeros(int(lengths.sum()) + len(strings), dtype=np.uint16)  # 0 closes a string
        starts = np.cumsum(lengths + 1) - lengths - 1
        inside = np.ones(len(text), dtype=bool)
        inside[starts + lengths] = False
        text[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.uint16) + 1
        place = np.repeat(places - starts, lengths + 1) + np.arange(len(text))
        order, common = sorted_suffixes(text, max(longest + 1, width))
        self.width, self.rows = width, len(text)

        symbol = text[order - 1]
        head = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        tail = np.r_[head[1:], self.rows] - 1
        by_symbol = np.argsort(symbol[head], kind="stable")
        self.first, self.last = head[by_symbol], tail[by_symbol]
        self.symbol = symbol[self.first].astype(np.int64)
        self.key = self.symbol * self.rows + self.first
        size = self.last - self.first + 1
        self.to = np.cumsum(size) - size  # the row that the first row of a run steps to

        self.group = np.flatnonzero(common < width)
        self.earliest = np.minimum.reduceat(place[order], self.group)
        self.common = np.empty((self.rows.bit_length(), self.rows), dtype=np.int32)  # least of 1, 2, 4, ... rows from each
        self.common[0] = common
        for k in range(1, len(self.common)):
            half = 1 << (k - 1)
            self.common[k] = self.common[k - 1]
            np.minimum(self.common[k - 1, :-half], self.common[k - 1, half:], out=self.common[k, :-half])

    def _agreement(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes of rows ``low`` and ``high``, a later one, have in common."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.common[level, low + 1], self.common[level, high - (1 << level) + 1])

    def statistics(self, queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from each byte of each query, and the earliest place of the ``width`` bytes from there.

        Both are arrays with a row for each query, whose bytes stand at the left. The place is
        ``NEVER`` where fewer bytes match.
        """
        lengths = np.array([len(q) for q in queries], dtype=np.int64)
        wide = int(lengths.max(initial=0))
        by_length = np.argsort(-lengths, kind="stable")
        column = np.arange(wide)
        inside = column >= (wide - lengths[by_length])[:, None]  # aligned at the right while streaming
        text = np.zeros((len(queries), wide), dtype=np.uint16)
        text[inside] = np.frombuffer(b"".join(queries[i] for i in by_length), dtype=np.uint8).astype(np.uint16) + 1
        row, length = np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64)
        matched = np.zeros((len(queries), wide), dtype=np.int32)
        place = np.full((len(queries), wide), NEVER)
        active = np.searchsorted(-lengths[by_length], column - wide, side="right")
        for c in range(wide - 1, -1, -1):
            n = active[c]
            sign, here = text[:n, c].astype(np.int64), row[:n]
            run = np.searchsorted(self.key, sign * self.rows + here, side="right") - 1
            before = (run >= 0) & (self.symbol[run] == sign)
            moved = self.to[run] + here - self.first[run]
            grown = length[:n] + 1
            miss = np.flatnonzero(~(before & (here <= self.last[run])))
            if len(miss):
                r, had, at, sign = run[miss], length[miss], here[miss], sign[miss]
                after = np.minimum(r + 1, len(self.key) - 1)
                ahead = (r + 1 < len(self.key)) & (self.symbol[after] == sign)
                left, right = np.full(len(miss), -1), np.full(len(miss), -1)
                x = np.flatnonzero(before[miss])
                left[x] = np.minimum(had[x], self._agreement(self.last[r[x]], at[x]))
                x = np.flatnonzero(ahead)
                right[x] = np.minimum(had[x], self._agreement(at[x], self.first[after[x]]))
                end = np.where(left >= 0, self.to[r] + self.last[r] - self.first[r], 0)
                moved[miss] = np.where(right > left, self.to[after], end)
                grown[miss] = np.maximum(left, right) + 1
            row[:n], length[:n] = moved, grown
            matched[:n, c] = grown
            long = np.flatnonzero(grown >= self.width)
            place[long, c] = self.earliest[np.searchsorted(self.group, moved[long], side="right") - 1]
        out = np.zeros_like(matched), np.full_like(place, NEVER)
        left = column < lengths[by_length][:, None]
        for whole, part in zip(out, (matched, place)):
            turned = whole[: len(queries)]
            turned[left] = part[inside]
            whole[by_length] = turned.copy()
        return out
