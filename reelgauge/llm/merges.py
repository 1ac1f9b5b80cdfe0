"""Heap-and-linked-list merging of adjacent symbol pairs, for byte-pair and score-ordered vocabularies.

A unit is a linked list of symbols with a heap of its adjacent pairs, ordered by (order of the pair, position). The
first is popped again and again; an entry whose pair is gone is skipped; the pair's symbols become
one, and the two new pairs enter. The pairs of the initial symbols are looked up and sorted for all units at
once; a sorted list is a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np

SHORT = 12  # bits of a position, more if a unit is longer


class PairMerger:
    """Pairs have numbers 0 ... n - 1; pair p joins left[p] and right[p] into merged[p], the lowest order[p] first, then the leftmost."""

    def __init__(self, n_symbols: int, pairs: Iterable[tuple[int, int, int]], order: list[int], merged: list[int]):
        """pairs: (left symbol, right symbol, pair number); several may share a number. order >= 0, below 2^31."""
        nothing: dict[int, int] = {}
        self.rows: list[dict[int, int]] = [nothing] * n_symbols
        for a, b, p in pairs:
            if self.rows[a] is nothing:
                self.rows[a] = {}
            self.rows[a][b] = p
        self.order, self.merged = [*order, -1], merged  # order[-1]: no pair waits here
        self.order_of = np.array(self.order, "int64")
        self.keys, self.pair_of = np.empty(0, "int64"), np.empty(0, "int64")

    def initial(self, symbols: Iterable[int]) -> None:
        """Symbols that units can start with; their pairs are looked up by array."""
        first = set(symbols)
        found = sorted((a << 32 | b, p) for a in first for b, p in self.rows[a].items() if b in first)
        self.keys, self.pair_of = np.array([k for k, _ in found], "int64"), np.array([p for _, p in found], "int64")

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Per unit the number of merges and its symbols, -1 where one went into a symbol before. ``symbols``: of all units, one after another."""
        if not len(sizes):
            return
        shift = max(SHORT, int(sizes.max()).bit_length())
        mask = (1 << shift) - 1
        ends = np.cumsum(sizes)
        pair = np.full(len(symbols), -1, "int64")
        if len(self.keys) and len(symbols) > 1:
            wanted = symbols[:-1].astype("int64") << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            pair[:-1] = np.where(self.keys[at] == wanted, self.pair_of[at], -1)
        pair[ends[sizes > 0] - 1] = -1
        have = np.flatnonzero(pair >= 0)
        unit = np.repeat(np.arange(len(sizes)), sizes)[have]
        entries = self.order_of[pair[have]] << shift | (have - (ends - sizes)[unit])
        entries = entries[np.lexsort((entries, unit))].tolist()
        heap_ends = np.cumsum(np.bincount(unit, minlength=len(sizes))).tolist()
        symbols, pair = symbols.tolist(), pair.tolist()
        rows, order, merged, pop, push = self.rows, self.order, self.merged, heapq.heappop, heapq.heappush
        lists: dict[int, tuple[list[int], list[int]]] = {}
        a = x = 0
        for b, y in zip(ends.tolist(), heap_ends):
            n, own = b - a, symbols[a:b]
            if x == y:
                yield 0, own
                a = b
                continue
            if n in lists:
                after, before = lists[n]
                after, before = after[:], before[:]
            else:
                after, before = list(range(1, n + 1)), list(range(-1, n - 1))
                if n < 64:
                    lists[n] = after[:], before[:]
            waiting, heap, merges = pair[a:b], entries[x:y], 0
            while heap:
                entry = pop(heap)
                i = entry & mask
                p = waiting[i]
                if order[p] != entry >> shift:
                    continue
                merges += 1
                j = after[i]
                new = own[i] = merged[p]
                own[j] = waiting[j] = -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    p = waiting[i] = rows[new].get(own[k], -1)
                    if p >= 0:
                        push(heap, order[p] << shift | i)
                else:
                    waiting[i] = -1
                h = before[i]
                if h >= 0:
                    p = waiting[h] = rows[own[h]].get(new, -1)
                    if p >= 0:
                        push(heap, order[p] << shift | h)
            yield merges, own
            a, x = b, y
