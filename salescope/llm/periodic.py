"""Periodic runs of words: every maximal repetition of a text, found through suffix trees.

A run is a stretch of consecutive words with a smallest period ``q`` (words ``q`` apart are identical) that no
neighbouring word extends, of at least ``least`` words and ``exponent`` periods. ``runs`` finds all of them:

1. Ukkonen's algorithm builds the suffix tree of the words and that of their reversal.
2. An Euler tour of each tree, holding string depths, makes the longest common extension of two places the
   minimum of a range of the tour; doubled ranges (a sparse table) answer each in constant time. The levels of the
   table are made one after the other for all questions at once, so two of them are held.
3. The tour visits suffixes in order. The longest Lyndon word at each place ends before the next smaller suffix, for
   the order of words and for its reverse. Each run has such a word as its root in one of the two orders, so these
   (at most two a place) are all candidates; a candidate is extended to both sides by one question to each tree.

Work before the trees: in a run of at least ``least`` words and ``exponent`` periods every stretch of
``least * (1 - 1/exponent)`` words from its start occurs again one period later, and these stretches cover it. Words
that no repeated stretch (known by hash: a collision only adds work) covers are in no run, and each part between them
is taken by itself. Nothing is dropped by this; texts without repeated stretches need no tree.

Defined results: null and empty texts have no words and no runs. Words are what stands between blanks
(``[^\\x20\\x09-\\x0D]+``). Equal rows are worked on like any other, each gives its own row. Other columns pass
through; a column named like a new one is replaced. A text is worked on whole by one task: about 1 KB for each
word inside a part with repeated stretches.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.llm.common import with_columns

LEAST = 24
EXPONENT = 3

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_tree(symbols: list[int], width: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's suffix tree of ``symbols`` (the last one, 0, stands nowhere else; all are below ``width``): for each
    node the start and the end of its edge's label, and the child of node v by symbol c under ``v * width + c``."""
    open_end = len(symbols)
    start, end, link, child = [0], [0], [0], {}
    node = edge = length = waiting = 0
    for i, c in enumerate(symbols):
        waiting += 1
        made = 0  # the inner node that still waits for its suffix link
        while waiting:
            if not length:
                edge = i
            key = node * width + symbols[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(open_end)
                link.append(0)
                if made:
                    link[made] = node
                    made = 0
            else:
                first = start[below]
                size = min(end[below], i + 1) - first
                if length >= size:
                    edge += size
                    length -= size
                    node = below
                    continue
                if symbols[first + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                inner = len(start)
                child[key] = inner
                start += (first, i)
                end += (first + length, open_end)
                link += (0, 0)
                child[inner * width + c] = inner + 1
                start[below] = first + length
                child[inner * width + symbols[first + length]] = below
                if made:
                    link[made] = inner
                made = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return start, end, child


class Extensions:
    """Longest common extensions of places of a text, by range minima over the Euler tour of its suffix tree."""

    def __init__(self, symbols: np.ndarray):
        """``symbols``: from 1 up; the end sign 0 is added."""
        text = [*symbols.tolist(), 0]
        n, width = len(text), int(symbols.max(initial=0)) + 1
        start, end, child = suffix_tree(text, width)
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)
        kids = np.fromiter(child.values(), np.int64, len(child))[order]
        del child
        bounds = np.searchsorted(keys[order] // width, np.arange(len(start) + 1)).tolist()
        kids = kids.tolist()
        depth, tour, place = [0] * len(start), [], [0] * n
        stack = [0]
        while stack:
            v = stack.pop()
            if v < 0:
                tour.append(depth[~v])
                continue
            d = depth[v]
            low, high = bounds[v], bounds[v + 1]
            if low == high:
                place[n - d] = len(tour)
            tour.append(d)
            for k in range(high - 1, low - 1, -1):
                c = kids[k]
                depth[c] = d + end[c] - start[c]
                stack.append(~v)
                stack.append(c)
        self.tour = np.array(tour, np.int32)
        self.place = np.array(place, np.int64)
        self.rank = np.empty(n, np.int64)
        self.rank[np.argsort(self.place)] = np.arange(n)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``i`` and ``j`` (other places) share from their start."""
        a, b = self.place[i], self.place[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        order = np.argsort(level, kind="stable")
        ends = np.searchsorted(level[order], np.arange(int(level.max(initial=-1)) + 2))
        out, minima = np.zeros(len(i), np.int64), self.tour
        for k in range(len(ends) - 1):
            at = order[ends[k]:ends[k + 1]]
            out[at] = np.minimum(minima[low[at]], minima[high[at] - (1 << k) + 1])
            if k < len(ends) - 2:
                minima = np.minimum(minima[:-(1 << k)], minima[1 << k:])
        return out


def lyndon_roots(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of the longest Lyndon word at each place, in the order of ``rank`` and in the reverse one.
    ``rank`` ends with that of the empty suffix."""
    n = len(rank) - 1
    ranks = rank.tolist()
    smaller, greater = [n] * n, list(range(n))  # the end is smaller than all; where nothing greater follows, no word
    low, high = [n], []  # places whose suffixes fall, or rise, from the top of the stack down
    for i in range(n - 1, -1, -1):
        r = ranks[i]
        while ranks[low[-1]] > r:
            low.pop()
        smaller[i] = low[-1]
        low.append(i)
        while high and ranks[high[-1]] < r:
            high.pop()
        if high:
            greater[i] = high[-1]
        high.append(i)
    at = np.arange(n)
    return np.concatenate([at, at]), np.concatenate([np.array(smaller, np.int64) - at, np.array(greater, np.int64) - at])


def runs_of(symbols: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """All runs of ``symbols`` (numbers from 1) as rows of start, length and period, by start and period."""
    n = len(symbols)
    ahead, back = Extensions(symbols), Extensions(symbols[::-1])
    i, period = lyndon_roots(ahead.rank)
    near = (period > 0) & (period * exponent <= n)
    i, period = i[near], period[near]
    right = ahead.common(i, i + period)
    left = back.common(n - i, n - i - period)
    length = period + right + left
    good = (length >= exponent * period) & (length >= least)
    return np.unique(np.stack([i - left, length, period], 1)[good], axis=0) if good.any() else np.empty((0, 3), np.int64)


def repeated_parts(ids: np.ndarray, size: int) -> np.ndarray:
    """Begin and end of the parts of ``ids`` that stretches of ``size`` words (down to a power of two), each occurring
    at least twice, cover."""
    print_ = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    print_ ^= print_ >> np.uint64(29)
    step = 1
    while 2 * step <= size:
        ahead = print_[step:]
        print_ = print_[:-step] * np.uint64(0xBF58476D1CE4E5B9) + (ahead ^ (ahead >> np.uint64(31)))
        step *= 2
    order = np.argsort(print_, kind="stable")
    same = print_[order][1:] == print_[order][:-1]
    if not same.any():
        return np.empty((0, 2), np.int64)
    again = np.zeros(len(print_), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, np.int64)
    change[:len(print_)] += again
    change[step:step + len(print_)] -= again
    inside = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def find(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs of a list of words: start, length and period, by start, then period."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    size = max(1, least - -(-least // exponent))
    if len(words) < max(least, 2):
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = []
    for begin, stop in repeated_parts(ids, size).tolist():
        if stop - begin >= least:
            part = np.unique(ids[begin:stop], return_inverse=True)[1] + 1
            for start, length, period in runs_of(part, least, exponent).tolist():
                found.append((begin + start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stand in no run behind that run's first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def runs(df: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``df`` with ``n_words``, all ``runs`` (by start, then period) and ``collapsed``, the text's words without
    the repetitions of its runs, joined by one space."""

    def start():
        def work(batch: list[bytes]) -> Iterable[Iterable]:
            counts, all_runs, kept = [], [], []
            for t in batch:
                words = t.split()
                found = find(words, least, exponent)
                counts.append(len(words))
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                kept.append(b" ".join(collapse(words, found)).decode())
            return counts, all_runs, kept

        return work

    return with_columns(df, text, [("n_words", "bigint"), ("runs", RUNS), ("collapsed", "string")], start)


def strongest(found: Column) -> Column:
    """The run with the greatest exact length by period; of equal ones the first by start, then period."""
    more = lambda a, r: r["length"] * a["period"] > a["length"] * r["period"]
    return F.reduce(found, F.try_element_at(found, F.lit(1)), lambda a, r: F.when(more(a, r), r).otherwise(a))
