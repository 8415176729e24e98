"""Merging adjacent symbols by rank, for many short units side by side."""

from __future__ import annotations

import numpy as np


class Merges:
    """Pairs of symbols that become another symbol, better pairs with smaller ranks.

    Symbols are numbers below `symbols`. A unit's best pair is merged first, the leftmost
    of equally good ones, until none of its pairs is known. Units do not touch each other,
    so a round merges one pair of each of them.
    """

    def __init__(self, pairs: list[tuple[int, int, int, int]], symbols: int):
        """`pairs` are (left, right, rank, merged symbol)."""
        self.symbols = symbols
        found = sorted((left * symbols + right, rank, merged)
                       for left, right, rank, merged in pairs)
        worst = max((rank for _, rank, _ in found), default=0) + 1
        self.keys, self.ranks, self.merged = np.array(
            [*found, (symbols * symbols, worst, 0)]).T.copy()

    def _known(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the list, the last place for a pair that is not in it."""
        keys = left * self.symbols + right
        at = np.searchsorted(self.keys[:-1], keys)
        return np.where(self.keys[at] == keys, at, len(self.keys) - 1)

    def run(self, symbols: np.ndarray, sizes: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all units after all merges, in order, and how many each unit
        has. `symbols` holds the units one after the other, `sizes` their lengths."""
        none = len(self.keys) - 1
        unit = np.repeat(np.arange(len(sizes)), sizes)
        pairs = self._known(symbols, np.append(symbols[1:], 0))
        pairs[np.append(unit[1:] != unit[:-1], True)[:len(pairs)]] = none
        done = [(unit[:0], symbols[:0])]
        while len(unit):
            ranks = self.ranks[pairs]
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.repeat(np.minimum.reduceat(ranks, starts),
                             np.diff(np.append(starts, len(unit))))
            over = best == self.ranks[-1]
            if over.any():
                done.append((unit[over], symbols[over]))
                keep = ~over
                unit, symbols, pairs = unit[keep], symbols[keep], pairs[keep]
                ranks, best = ranks[keep], best[keep]
                if not len(unit):
                    break
            at = np.flatnonzero(ranks == best)
            at = at[np.append(True, unit[at[1:]] != unit[at[:-1]])]  # leftmost
            symbols[at] = self.merged[pairs[at]]
            # The second symbol goes; the merged one meets that one's neighbour.
            last = np.append(unit[1:] != unit[:-1], True)[at + 1]
            after = np.minimum(at + 2, len(symbols) - 1)
            pairs[at] = np.where(last, none, self._known(symbols[at], symbols[after]))
            inner = at[at > 0]
            inner = inner[unit[inner - 1] == unit[inner]]
            pairs[inner - 1] = self._known(symbols[inner - 1], symbols[inner])
            keep = np.ones(len(unit), bool)
            keep[at + 1] = False
            unit, symbols, pairs = unit[keep], symbols[keep], pairs[keep]
        unit, symbols = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        return (symbols[np.argsort(unit, kind="stable")],
                np.bincount(unit, minlength=len(sizes)))
