"""Recompression: many sequences of symbols as one grammar of blocks and pairs, and longest common extensions by it.

Rounds alternate. A block round replaces every maximal repetition of a symbol by one symbol (symbol, times): the grammar is
run-length. A pair round splits the symbols into left and right ones and replaces every left one that a right one follows.
Equal stretches are parsed alike but for their ends, so two places are compared symbol by symbol only until both stand at a
border of the next level. That takes one step per level at most: up while they agree, and down again where they differ.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Level:
    """One level. ``symbol`` has a guard between sequences that equals nothing else.

    ``up``: the symbol of the next level that each one belongs to; ``down``: the first one that belongs to each of the next level,
    and the number of symbols. ``block``: the next level is one of blocks.
    """

    symbol: np.ndarray
    block: bool = False
    up: np.ndarray | None = None
    down: np.ndarray | None = None


def _coins(n: int, round_: int) -> np.ndarray:
    """A bit for each of n symbols."""
    h = (np.arange(n, dtype=np.uint64) + np.uint64(round_ * 2 + 1)) * _ODD
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(63)).astype(bool)


class Grammar:
    """``symbols``: non-negative numbers, sequences one after the other; ``bounds``: where each sequence begins, and the end.

    Places are those of ``laid``, the sequences with a guard before each and at the end: place of item k of sequence s is k + s + 1.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray) -> None:
        n = len(symbols) + len(bounds)
        guard = bounds + np.arange(len(bounds))
        laid = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[guard] = False
        laid[inside] = symbols
        laid[guard] = -1 - np.arange(len(bounds))  # guards are below zero, each its own
        self.laid, self.levels = laid, [Level(laid)]
        free = int(symbols.max()) + 1 if len(symbols) else 0
        live = len(bounds) + int((bounds[1:] > bounds[:-1]).sum())
        for round_ in count():  # until a sequence is one symbol; a pair is made with probability 1/2 at least where there are more
            if len(self.levels[-1].symbol) <= live:
                break
            free = self._pairs(self._blocks(free), round_)

    def _raise(self, first: np.ndarray, symbol: np.ndarray, block: bool) -> None:
        low = self.levels[-1]
        low.block, low.down = block, np.append(first, len(low.symbol))
        low.up = np.repeat(np.arange(len(first)), np.diff(low.down))
        self.levels.append(Level(symbol))

    def _blocks(self, free: int) -> int:
        s = self.levels[-1].symbol
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(first) == len(s):
            return free
        times = np.diff(np.append(first, len(s)))
        symbol = s[first].copy()
        many = np.flatnonzero(times > 1)
        names = np.unique(symbol[many] * (int(times.max()) + 1) + times[many], return_inverse=True)
        symbol[many] = free + names[1].reshape(-1)
        self._raise(first, symbol, True)
        return free + len(names[0])

    def _pairs(self, free: int, round_: int) -> int:
        """Of the two ways to pair the sides, the one with more pairs. Numbers are given anew, so that coins stay few."""
        s = self.levels[-1].symbol
        left = np.append(_coins(free, round_), False)[np.maximum(s, 0)]
        real = s >= 0
        a, b = left & real, ~left & real
        one, two = a[:-1] & b[1:], b[:-1] & a[1:]
        joined = np.flatnonzero(one if one.sum() >= two.sum() else two)
        if not len(joined):
            return free
        keep = np.ones(len(s), bool)
        keep[joined + 1] = False
        first = np.flatnonzero(keep)
        symbol = s.copy()
        pairs, name = np.unique(s[joined] * free + s[joined + 1], return_inverse=True)
        symbol[joined] = free + name.reshape(-1)
        symbol = symbol[first]
        live = symbol >= 0
        used, name = np.unique(symbol[live], return_inverse=True)
        symbol[live] = name.reshape(-1)
        self._raise(first, symbol, False)
        return len(used)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items from places i and j on are equal. Places of a pair differ and lie in one sequence."""
        a, b, start = i.copy(), j.copy(), i
        stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.arange(len(i))
        for level in self.levels:
            if not len(live):
                break
            a, b, same = self._step(level, a, b)
            stopped.append((live[~same], a[~same], b[~same]))
            if level.up is not None:
                live, a, b = live[same], level.up[a[same]], level.up[b[same]]
        who, a, b = (np.zeros(0, np.int64) for _ in range(3))
        for level, here in zip(self.levels[len(stopped) - 1 :: -1], stopped[::-1]):
            if len(who):
                a, b = self._advance(level, level.down[a], level.down[b])
            who, a, b = (np.concatenate(x) for x in zip((who, a, b), here))
        out = np.zeros(len(i), np.int64)
        out[who] = a - start[who]
        return out

    @staticmethod
    def _rest(level: Level, at: np.ndarray) -> np.ndarray:
        """Symbols from ``at`` to the end of its block."""
        return level.down[level.up[at] + 1] - at

    def _advance(self, level: Level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step, or the rest of the shorter block, where the symbols are equal."""
        equal = level.symbol[a] == level.symbol[b]
        step = np.minimum(self._rest(level, a), self._rest(level, b)) if level.block else 1
        return a + equal * step, b + equal * step

    def _step(self, level: Level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both places at borders of the next level, or at the first difference: (a, b, whether both may go up)."""
        if level.up is None:
            return a, b, np.zeros(len(a), bool)
        border = (level.down[level.up[a]] == a) & (level.down[level.up[b]] == b)
        equal = level.symbol[a] == level.symbol[b]
        move = ~border & equal
        step = np.minimum(self._rest(level, a), self._rest(level, b)) if level.block else 1
        a, b = a + move * step, b + move * step
        border = (level.down[level.up[a]] == a) & (level.down[level.up[b]] == b)
        equal = level.symbol[a] == level.symbol[b]
        return a, b, border & equal

    def reversed(self) -> Grammar:
        """The same parse read from the right, for extensions to the left: place k becomes the number of places less k + 1."""
        out = object.__new__(Grammar)
        out.laid, out.levels = self.laid[::-1], []
        for level in self.levels:
            new = Level(level.symbol[::-1], level.block)
            if level.up is not None:
                new.up = len(level.down) - 2 - level.up[::-1]
                new.down = len(level.symbol) - level.down[::-1]
            out.levels.append(new)
        return out
