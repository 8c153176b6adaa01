"""Runs (maximal periodic stretches) in the words of a text, by difference-cover common extensions.

Extensions of two positions compare words directly until both reach positions sampled by a difference cover
(at most ``COVER_PERIOD - 1`` words); only sampled suffixes are sorted, by stride doubling, and the rest of the extension is a
range minimum over the common prefixes of neighbours in that order, from a sparse table. Candidates come from
the harmonic grid: a run of period q and exponent e or more holds a pair (i, i + q) with i on a grid of step
(e - 1) q, so all grids together have n / (e - 1) * ln n points, handled in array blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txmon.llm.common import ROW, pack, slices, text_of, unpack

#: A perfect difference cover: every difference modulo the period is one of two members.
COVER_PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

#: Grid points handled at once.
BLOCK = 1 << 18


def _shifts() -> np.ndarray:
    """[a, b] -> smallest d with a + d and b + d both in the cover (modulo the period)."""
    v = COVER_PERIOD
    member = np.zeros(v, dtype=bool)
    member[list(COVER)] = True
    at = np.arange(v)
    out = np.zeros((v, v), dtype=np.int64)
    for d in range(v - 1, -1, -1):
        out[np.ix_(member[(at + d) % v], member[(at + d) % v])] = d
    return out


SHIFTS = _shifts()


class Extensions:
    """Longest common extensions to the right of positions of ``words`` (positive integers)."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.n = len(words)
        self.rank: np.ndarray | None = None

    def _prepare(self) -> None:
        """Order of the sampled suffixes and the sparse table of their neighbours' common prefixes."""
        n, v = self.n, COVER_PERIOD
        width = -(-n // v)
        at = (np.arange(width)[:, None] * v + np.array(COVER)).ravel()
        at = at[at < n]
        padded = np.concatenate((self.words, np.zeros(v + 1, dtype=self.words.dtype)))
        first = padded[at[:, None] + np.arange(v)].astype(">u4")
        names = np.unique(np.ascontiguousarray(first).view(f"S{4 * v}").ravel(), return_inverse=True)[1].astype(np.int64) + 1
        del first
        rank = np.zeros(n + 1, dtype=np.int32)  # 0: no sample, or behind the end
        rank[at] = names
        levels, step = [rank], v
        while names.max(initial=0) < len(at) and step < n:
            behind = np.minimum(at + step, n)
            names = np.unique(rank[at].astype(np.int64) * (len(at) + 1) + rank[behind], return_inverse=True)[1].astype(np.int64) + 1
            rank = np.zeros(n + 1, dtype=np.int32)
            rank[at] = names
            levels.append(rank)
            step *= 2
        order = at[np.argsort(names)]
        self.rank = np.zeros(n + 1, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):  # whole blocks of v << k words, then single words
            i, j = np.minimum(a + common, n), np.minimum(b + common, n)
            same = (levels[k][i] == levels[k][j]) & (levels[k][i] > 0)
            common += same * (v << k)
        common = np.minimum(common, n - np.maximum(a, b))  # equal padding is no common word
        common += self._direct(a + common, b + common, np.full(len(a), v))
        self.table = [common]
        half = 1
        while 2 * half <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))
            half *= 2

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j, at most ``most`` of them."""
        out = np.zeros(len(i), dtype=np.int64)
        most = np.minimum(most, self.n - np.maximum(i, j))
        alive = np.flatnonzero(most > 0)
        k = 0
        while len(alive):
            alive = alive[self.words[i[alive] + k] == self.words[j[alive] + k]]
            k += 1
            out[alive] = k
            alive = alive[most[alive] > k]
        return out

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of the suffixes at i and j (i and j differ, both may be n)."""
        shift = SHIFTS[i % COVER_PERIOD, j % COVER_PERIOD]
        out = self._direct(i, j, shift)
        left = np.flatnonzero((out == shift) & (np.maximum(i, j) + shift < self.n))
        if len(left):
            if self.rank is None:
                self._prepare()
            a, b = self.rank[i[left] + shift[left]], self.rank[j[left] + shift[left]]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            k = np.frexp(hi - lo)[1].astype(np.int64) - 1
            for level in np.unique(k).tolist():
                at = np.flatnonzero(k == level)
                row = self.table[level]
                out[left[at]] += np.minimum(row[lo[at]], row[hi[at] - (1 << level)])
        return out


def grid(n: int, min_length: int, min_exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, period): every run of the wanted length and exponent holds one of its period's positions."""
    q = 1
    while q * min_exponent <= n and min_length <= n:
        upto, points = q, 0
        periods, counts = [], []
        while upto * min_exponent <= n and (points < BLOCK or not periods):
            step = max(min_length, min_exponent * upto) - upto
            many = -(-(n - upto) // step)
            periods.append(upto)
            counts.append(many)
            points += many
            upto += 1
        periods, counts = np.array(periods), np.array(counts)
        period = np.repeat(periods, counts)
        step = np.maximum(min_length, min_exponent * period) - period
        yield (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * step, period
        q = upto


def runs_of(words: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; period is the smallest of its stretch."""
    n = len(words)
    right, left = Extensions(words), Extensions(words[::-1].copy())
    found = []
    for i, q in grid(n, min_length, min_exponent):
        hit = words[i] == words[i + q]
        i, q = i[hit], q[hit]
        if not len(i):
            continue
        ahead = right.extend(i, i + q)
        back = left.extend(n - i, n - i - q)
        start, length = i - back, ahead + back + q
        long = length >= np.maximum(min_length, min_exponent * q)
        found.append(np.stack((start[long], length[long], q[long]), axis=1))
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)  # of one stretch the smallest period: it divides all others
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapse(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that no run contains after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def _documents(batches: Iterable[pa.RecordBatch], min_length: int, min_exponent: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in slices(batches, "_text"):
        all_runs, counts, texts = [], [], []
        for text in batch.column("_text"):
            words = text.as_py().split()  # bytes: splits at 0x09-0x0D and 0x20 only
            ids: dict[bytes, int] = {}
            numbered = np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), dtype=np.uint32, count=len(words))
            runs = runs_of(numbered, min_length, min_exponent)
            counts.append(len(words))
            all_runs.append([{"start": s, "length": m, "period": q} for s, m, q in runs.tolist()])
            if len(runs):
                words = [words[k] for k in np.flatnonzero(collapse(len(words), runs)).tolist()]
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column(ROW), pa.array(counts, pa.int64()), pa.array(all_runs, kind), pa.array(texts, pa.binary())],
            names=[ROW, "_n", "_runs", "_kept"])


def find_runs(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, min_length: int = 6,
              min_exponent: int = 4) -> DataFrame:
    """Carried columns plus n_words, runs (array of start, length, period by start and period) and collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with smallest period q (words q apart are
    identical) and at least ``max(min_length, min_exponent * q)`` words that cannot be extended by a word on either side
    keeping q. ``collapsed`` joins by one space the words that no run contains after its first q words.

    A null text counts as empty: 0 words, no runs, empty collapsed text. A document is handled whole in one task, whatever its
    length; its arrays take about 250 bytes a word while extensions run. Rows are independent: repeated rows repeat
    their result, an empty table gives no rows. Input columns named like the added ones are replaced.
    """
    shape = docs.schema
    kept = carry if carry is not None else docs.columns
    rows = pack(docs, kept, _text=text_of(f"`{text_col}`").cast("binary"))
    run = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    found = rows.mapInArrow(lambda batches: _documents(batches, min_length, min_exponent),
                            T.StructType([rows.schema[ROW], T.StructField("_n", T.LongType()), T.StructField("_runs", run),
                                          T.StructField("_kept", T.BinaryType())]))
    return unpack(found, T.StructType([shape[c] for c in kept]),
                  {"n_words": F.col("_n"), "runs": F.col("_runs"), "collapsed": F.col("_kept").cast("string")})
