"""Suffix array of one shard by induced sorting, and its permuted common prefixes.

The first level, whose alphabet is bytes, induces whole character buckets with array operations; the reduced strings
of the recursion have large alphabets and few symbols and use plain loops.
"""

from __future__ import annotations

import numpy as np


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last symbol must be the unique smallest."""
    n = len(s)
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    small = np.ones(len(starts), dtype=bool)  # the last run is the sentinel
    small[:-1] = s[starts[:-1]] < s[starts[1:]]
    return np.repeat(small, np.diff(np.append(starts, n)))


def _deal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order of the keys, the distinct ones, and how many of each."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    return order, ranked[heads], np.diff(np.append(heads, len(ranked)))


def induce(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Order of all suffixes induced from the order of the leftmost-smaller ones."""
    n, width = len(s), int(s.max()) + 1
    counts = np.bincount(s, minlength=width)
    ends = np.cumsum(counts)
    begins = ends - counts
    order, chars, many = _deal(s[leftmost])
    by_char = dict(zip(chars.tolist(), np.split(leftmost[order], np.cumsum(many)[:-1])))
    sa = np.full(n, -1, dtype=np.int64)
    head = begins.copy()

    def push_larger(items: np.ndarray, char: int) -> np.ndarray:
        """Put the larger-type predecessors behind what their buckets hold; return those of bucket ``char``."""
        before = items[items > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return before
        order, chars, many = _deal(s[before])
        before = before[order]
        first = np.cumsum(many) - many
        sa[np.repeat(head[chars] - first, many) + np.arange(len(before))] = before
        head[chars] += many
        return before[:many[0]] if chars[0] == char else before[:0]

    for c in np.flatnonzero(counts).tolist():
        wave = sa[begins[c]:head[c]].copy()
        while len(wave):
            wave = push_larger(wave, c)
        if c in by_char:
            push_larger(by_char[c], c)

    tail = ends.copy()

    def push_smaller(items: np.ndarray, char: int) -> np.ndarray:
        """The same from the right: ``items`` in descending order, buckets filled from their ends."""
        before = items[items > 0] - 1
        before = before[small[before]]
        if not len(before):
            return before
        order, chars, many = _deal(s[before])
        before = before[order]
        first = np.cumsum(many) - many
        sa[np.repeat(tail[chars] - 1 + first, many) - np.arange(len(before))] = before
        tail[chars] -= many
        at = np.flatnonzero(chars == char)
        return before[first[at[0]]:first[at[0]] + many[at[0]]] if len(at) else before[:0]

    for c in np.flatnonzero(counts).tolist()[::-1]:
        wave = sa[tail[c]:ends[c]][::-1].copy()
        while len(wave):
            wave = push_smaller(wave, c)
        push_smaller(sa[begins[c]:head[c]][::-1], c)
    sa[0] = n - 1
    return sa


def _induce_loops(large: list[int], small: list[int], counts: np.ndarray, leftmost: list[int]) -> list[int]:
    """The same with plain loops, for large alphabets.

    ``large`` and ``small`` hold the symbols of the positions of that type and -1 for all others, with two more -1 at the end: those
    are what stands before position 0 and before a place not yet filled (-1).
    """
    ends = np.cumsum(counts)
    heads, tails = (ends - counts).tolist(), ends.tolist()
    sa, tail = [-1] * (len(small) - 2), tails[:]
    for i in reversed(leftmost):
        c = small[i]
        tail[c] -= 1
        sa[tail[c]] = i
    for i in sa:  # places ahead are filled on the way
        c = large[i - 1]
        if c >= 0:
            head = heads[c]
            sa[head] = i - 1
            heads[c] = head + 1
    for i in reversed(sa):
        c = small[i - 1]
        if c >= 0:
            tails[c] = last = tails[c] - 1
            sa[last] = i - 1
    return sa


def _names(s: np.ndarray, leftmost_sorted: np.ndarray, next_at: np.ndarray) -> np.ndarray:
    """Names 0, 1, ... of the sorted leftmost-smaller substrings; equal substrings share one."""
    a, b = leftmost_sorted[:-1], leftmost_sorted[1:]
    la, lb = next_at[a] - a, next_at[b] - b
    same = la == lb
    alive = np.flatnonzero(same)
    k = 0
    while len(alive):
        equal = s[a[alive] + k] == s[b[alive] + k]
        same[alive[~equal]] = False
        alive = alive[equal]
        k += 1
        alive = alive[k <= la[alive]]
    return np.concatenate(([0], np.cumsum(~same)))


def _sorted_marks(s: np.ndarray, small: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Leftmost-smaller substrings in order, and their names, by packed symbols; None if some are too long to pack."""
    symbols = 2 * s + small + 1  # of equal symbols the larger type comes first
    lengths = np.append(np.diff(marks), 0) + 1
    bits = int(symbols.max()).bit_length()
    each = 63 // bits
    if not each or lengths.max() > 5 * each:
        return None
    keys = []
    for at in range(0, int(lengths.max()), each):
        key = np.zeros(len(marks), dtype=np.int64)
        for k in range(at, at + each):
            some = symbols[np.minimum(marks + k, len(s) - 1)]
            key = (key << bits) + np.where(k < lengths, some, 0)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(marks), dtype=bool)
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return marks[order], np.cumsum(new)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of integers >= 0 whose last symbol is the unique smallest."""
    s = np.asarray(s, dtype=np.int64)
    n = len(s)
    if n <= 2:
        return np.argsort(s, kind="stable") if n < 2 else np.array([1, 0])
    small = suffix_types(s)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    wide = int(s.max()) + 1 > max(1024, n // 64)
    loops = (*[np.append(np.where(own, s, -1), [-1, -1]).tolist() for own in (~small, small)], np.bincount(s)) if wide else ()

    def induced(order: np.ndarray) -> np.ndarray:
        return np.array(_induce_loops(*loops, order.tolist())) if wide else induce(s, small, order)

    found = _sorted_marks(s, small, marks)
    if found is not None:
        ranked, names = found
    else:  # induce once from any order: that sorts the substrings between marks
        sa = induced(marks)
        is_mark = np.zeros(n, dtype=bool)
        is_mark[marks] = True
        ranked = sa[is_mark[sa]]
        next_at = np.zeros(n, dtype=np.int64)
        next_at[marks[:-1]] = marks[1:]
        next_at[marks[-1]] = marks[-1]
        names = _names(s, ranked, next_at)
    if names[-1] + 1 < len(marks):
        named = np.zeros(n, dtype=np.int64)
        named[ranked] = names
        ranked = marks[suffix_array(named[marks])]
    return induced(ranked)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, upto: int) -> np.ndarray:
    """Common prefix of every suffix (in text order) with the one before it in ``sa``, counted up to ``upto``."""
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, dtype=np.int64)
    # several symbols at once, the first one highest; 0 stands for the end
    bits = int(s.max(initial=0) + 1).bit_length()
    each = max(1, min(upto, 52 // bits))  # a double holds the difference
    padded = np.concatenate((s + 1, np.zeros(upto + each, dtype=np.int64)))
    words = padded[:n + upto].copy()
    for k in range(1, each):
        words = (words << bits) | padded[k:n + upto + k]
    alive = np.flatnonzero(before >= 0)
    for k in range(0, upto, each):
        differ = words[alive + k] ^ words[before[alive] + k]
        # the highest bit that differs tells how many symbols agree before it
        out[alive] = k + np.where(differ == 0, each, each - 1 - (np.frexp(differ.astype(np.float64))[1] - 1) // bits)
        alive = alive[differ == 0]
    return np.minimum(out, upto)
