"""An FM-index over integer symbols: suffix array, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; only groups that still tie are sorted again.

    The last symbol must occur once, so that every suffix ends in a difference.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = symbols[sa[1:]] != symbols[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, at, 0))
    h = 1
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return sa
        suffix = sa[tied]
        first, then = rank[suffix], rank[suffix + h]
        order = np.argsort(first * n + then, kind="stable")
        sa[tied], first, then = suffix[order], first[order], then[order]
        new[tied[1:]] = (first[1:] != first[:-1]) | (then[1:] != then[:-1])
        rank[sa[tied]] = np.maximum.accumulate(np.where(new, at, 0))[tied]
        h *= 2


class WaveletMatrix:
    """rank(symbol, i): how often ``symbol`` stands before place i, for arrays of both."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        seq = symbols
        for level in range(bits - 1, -1, -1):
            ones = (seq >> level & 1).astype(bool)
            before = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((level, before, len(seq) - int(before[-1])))
            seq = np.concatenate([seq[~ones], seq[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for level, before, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            b0, b1 = before[start], before[i]
            start, i = np.where(one, zeros + b0, start - b0), np.where(one, zeros + b1, i - b1)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        found = np.zeros_like(i)
        for level, before, zeros in self.levels:
            one = before[i + 1] > before[i]
            found |= one.astype(found.dtype) << level
            i = np.where(one, zeros + before[i], i - before[i])
        return found


class FMIndex:
    """Finds symbol strings in ``symbols``; 0 is a separator that no string holds."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.append(symbols, 0).astype(np.int64)
        gaps = text == 0
        distinct = np.where(gaps, np.cumsum(gaps) - 1, text + int(gaps.sum()))  # separators differ, so no suffix is compared beyond one
        sa = suffix_array(distinct)
        bwt = text[sa - 1]
        self.n = len(text)
        self.tree = WaveletMatrix(bwt, max(1, int(sigma).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        kept = (sa % sample == 0) | (bwt == 0)  # a walk back ends at a separator at the latest
        self.kept, self.places = np.concatenate([[0], np.cumsum(kept)]), sa[kept]

    def search(self, patterns: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) rows of the suffixes that begin with each row of ``patterns``, or with those rows of it in ``only``."""
        only = np.arange(len(patterns)) if only is None else only
        low, high = np.zeros(len(only), np.int64), np.full(len(only), self.n, np.int64)
        live = np.arange(len(only))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[only[live], j].astype(np.int64)
            a, b = (self.first[c] + self.tree.rank(c, x[live]) for x in (low, high))
            low[live], high[live] = a, b
            live = live[a < b]
        dead = np.ones(len(only), bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes in these rows, by walks to sampled ones."""
        rows, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        out, live = np.empty(len(rows), np.int64), np.arange(len(rows))
        while len(live):
            r = rows[live]
            known = self.kept[r + 1] > self.kept[r]
            out[live[known]] = self.places[self.kept[r[known]]] + steps[live[known]]
            live, r = live[~known], r[~known]
            c = self.tree.access(r)
            rows[live] = self.first[c] + self.tree.rank(c, r)
            steps[live] += 1
        return out
