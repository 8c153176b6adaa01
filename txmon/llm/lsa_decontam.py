"""Benchmark decontamination by latent semantic retrieval.

The benchmark is a stated query set. Documents are cut into words once; what later passes read is one small number a word
(its place in the benchmark's vocabulary, or none). Items are handled in blocks of at most ``BLOCK_ITEMS``, each against all
documents:

1. document frequencies of the block's words over all passages of all documents;
2. randomised SVD of the TF-IDF passages: one distributed pass multiplies the passages' Gram matrix with a seeded
   random test matrix (summed per word), to which the items' own Gram matrix is added; the driver gets one
   row a benchmark word and finishes the decomposition (Nystroem form);
3. search: a window's latent inner product with every item is linear in its words, so a table (word x item) of latent
   products scores windows of two lengths. The sum of each word's greatest product bounds a window's score;
   windows under the bound cannot be candidates, all others are scored, and cosines of ``MIN_COSINE`` or more are candidates.
   So are windows with ``MIN_SHARE`` of an item's own telling words, which is the same for rare and frequent items, and
   short items wherever their words follow each other. Items longer than a passage are cut: each piece is a query for the item;
4. candidates are checked word by word: longest common subsequence with the item, and the share of the item's
   answer words (its rarest quarter) found there.

Passes 1 and 2 shuffle one row a word and task, pass 3 nothing. A text is always read whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txmon.llm.common import ROW, materialize, pack, slices, text_of, unpack

STEP = 16  # words between windows
WINDOWS = (2, 4)  # window lengths in steps
PASSAGE = 4  # passage length in steps
BLOCK_ITEMS = 256
EXTRA = 32  # latent dimensions beyond the block's items
OVER = 8  # oversampling of the test matrix
MAX_DF = 0.02  # words of more passages than this carry no weight ...
KEEP_SHARE = 0.5  # ... unless an item would keep less than this share of its distinct words
MIN_COSINE = 0.3
#: This share of a query's telling words in one window makes it a candidate, however frequent the words are in the documents.
#: With half of all words and of the answer words there, or 70 % of all, no fewer can be (words not repeated, leak in one window).
MIN_SHARE = 0.2
MIN_LCS = 0.5
MIN_ANSWER = 0.5
SURE_LCS = 0.7  # this much of an item in order needs no answer words
#: Items of fewer words must be found whole.
SHORT_ITEM = 8
ITEM_WEIGHT = 8.0
_EDGE = ".,;:!?\"'()[]{}*#%&$|<>"
_SLICE = 1 << 20  # bytes of ids, four a word
_CHUNK = 2048  # words or windows multiplied at once
_WORDS = 1 << 16  # words whose Gram matrix is multiplied at once
_RUN = 32  # rows of a run summed at once
_PAIRS = 1 << 17  # (word, query) pairs counted at once


def normal(word: bytes) -> str:
    return word.decode().lower().strip(_EDGE)


def word_ids(texts: pa.Array, vocabulary: pa.Array) -> list[np.ndarray]:
    """Every text's words as ids of the benchmark's vocabulary, -1 for any other; words that are punctuation only are left out.

    ``vocabulary`` ends with the empty word. The words are made plain as ``normal`` does, as columns; those beyond ASCII are
    lower-cased in one string, with spaces between, so that a word's last letter stays its last.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words = split.flatten()
    odd = pc.invert(pc.string_is_ascii(words))
    if pc.any(odd).as_py():
        other = words.filter(odd)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(other)], other), " ")[0].as_py()
        words = pc.replace_with_mask(words, odd, pc.ascii_split_whitespace(pa.array([joined.lower()], pa.string())).flatten())
    ids = pc.index_in(pc.ascii_trim(words, characters=_EDGE), value_set=vocabulary).fill_null(-1).to_numpy()
    full = ids != len(vocabulary) - 1
    ends = np.concatenate(([0], np.cumsum(full)))[split.offsets.to_numpy()].tolist()
    ids = ids[full]
    return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


def places(docs: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in a row, the piece of ``size`` words every word lies in, and the first piece of every document (one more at the end)."""
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(-(-lengths // size))))
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(first[:-1], lengths) + within // size
    return (np.concatenate(docs) if docs else np.zeros(0, np.int32)), at, first


def id_rows(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in batch.column("_ids").to_pylist()]


def _sum_rows(parts: DataFrame) -> DataFrame:
    """Sum the vectors of (i, row) by i, as a stream over rows sorted by i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(row, np.float32).astype(np.float64)
                if i != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "row"])
                    now, total = i, x
                else:
                    total = total + x
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "row"])

    return parts.repartition("i").sortWithinPartitions("i").mapInArrow(run, "i int, row binary")


def by_word(own: np.ndarray, size: int) -> np.ndarray:
    """Stable order of ``own``, ids under ``size``; short ids are sorted by digits."""
    return np.argsort(own.astype(np.uint16) if size <= 1 << 16 else own, kind="stable")


def document_frequency(rows: DataFrame, here: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """(passages holding each of the block's words, passages) over all documents; ``here`` maps vocabulary to block ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size + 1, dtype=np.int64), 0
        for batch in slices(batches, "_ids", _SLICE):
            ids, at, first = places(id_rows(batch), STEP * PASSAGE)
            own = here[ids]
            known = np.flatnonzero(own >= 0)
            known = known[by_word(own[known], size)]
            own, at = own[known], at[known]
            new = np.concatenate((own[:1] >= 0, (own[1:] != own[:-1]) | (at[1:] != at[:-1])))  # once a passage
            df[:-1] += np.bincount(own[new], minlength=size)
            n += int(first[-1])
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df), dtype=np.int32)), pa.array(df)], ["i", "n"])

    got = rows.mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # a row a word
    out = np.zeros(size + 1, dtype=np.int64)
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def test_matrix(words: list[str], width: int) -> np.ndarray:
    """Seeded random signs, one row a word, the same in every task."""
    return np.stack([np.random.default_rng(crc32(w.encode())).choice(np.float32([-1, 1]), width) for w in words]) if words else np.zeros((0, width), np.float32)


def segment_sums(table: np.ndarray, index: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of ``table[index]`` over the runs of ``index`` that begin at ``heads``: the k-th rows of all runs are added at once.

    Long runs are summed in pieces, so one frequent word costs no step of its own for each of its places.
    """
    many = np.diff(np.append(heads, len(index)))
    cut = -(-many // _RUN)
    first = np.cumsum(cut) - cut
    within = (np.arange(int(cut.sum())) - np.repeat(first, cut)) * _RUN
    begin, size = np.repeat(heads, cut) + within, np.minimum(np.repeat(many, cut) - within, _RUN)
    order = np.argsort(-size, kind="stable")
    begin = begin[order]
    left = len(size) - np.cumsum(np.bincount(size, minlength=2))  # runs of more than k rows
    out = table[index[begin]]
    for k in range(1, int(size.max())):
        out[: left[k]] += table[index[begin[: left[k]] + k]]
    sums = np.empty_like(out)
    sums[order] = out
    if len(sums) == len(heads):
        return sums
    total, long = sums[first], np.flatnonzero(cut > 1)
    total[long] = segment_sums(sums, np.flatnonzero(np.repeat(cut > 1, cut)), np.cumsum(cut[long]) - cut[long])
    return total


def gram_times(ids: np.ndarray, at: np.ndarray, weight: np.ndarray, outside: float, omega: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
    """X'X omega for the unit-length TF-IDF rows X of passages ``at``, added to ``into``.

    A word's weight is a factor of its row of omega and of its row of the result, so what is summed in between are rows as they are.
    """
    out = np.zeros((len(weight), omega.shape[1]), dtype=np.float64) if into is None else into
    if not len(ids):
        return out
    energy = np.bincount(at, np.append(weight * weight, outside * outside)[ids])  # the last one is for words outside
    use = np.flatnonzero(np.append(weight > 0, False)[ids])
    if not len(use):
        return out
    ids, at = ids[use], at[use]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    cuts = np.unique(np.append(starts[np.searchsorted(starts, np.arange(0, len(ids), _WORDS), side="right") - 1], len(ids)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own, here = ids[a:b], at[a:b]
        order = by_word(own, len(weight))
        heads = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
        used = own[order[heads]]
        scale = weight[used].astype(np.float32)[:, None]
        place = np.empty(len(own), dtype=np.int64)
        place[order] = np.repeat(np.arange(len(used)), np.diff(np.append(heads, len(own))))
        begin = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
        rows = segment_sums(omega[used] * scale, place, begin) / energy[here[begin]].astype(np.float32)[:, None]
        owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(own))))
        out[used] += segment_sums(rows, owner[order], heads) * scale
    return out


def latent_basis(sketch: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a Gram matrix G from sketch = G omega (Nystroem, one pass)."""
    if not sketch.size or not np.any(sketch):
        return np.zeros((len(omega), 0))
    shift = 1e-6 * np.linalg.norm(sketch) / np.sqrt(len(omega))
    y = sketch + shift * omega
    core = omega.T.astype(np.float64) @ y
    vals, vecs = np.linalg.eigh((core + core.T) / 2)
    good = vals > 1e-9 * vals.max()
    u, s, _ = np.linalg.svd(y @ (vecs[:, good] / np.sqrt(vals[good])), full_matrices=False)
    return u[:, : min(rank, int((s > 1e-7 * s[0]).sum()))]


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence of two id rows, one array operation a word of ``a``."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def pieces(row: np.ndarray) -> list[np.ndarray]:
    """The queries of an item: itself, or pieces that fit in a window at any offset if it is longer than a passage."""
    return [row] if len(row) <= STEP * PASSAGE else np.array_split(row, -(-len(row) // (STEP * (PASSAGE - 1))))


def blocks(items: list[tuple[int, list[str]]]) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in blocks of ``BLOCK_ITEMS`` queries at most; an item with more than that is a block of its own."""
    block, size = [], 0
    for item in items:
        many = len(pieces(np.arange(len(item[1]))))
        if block and size + many > BLOCK_ITEMS:
            yield block
            block, size = [], 0
        block.append(item)
        size += many
    if block:
        yield block


class Block:
    """One block of items over the vocabulary: block ids, queries, weights, latent table, telling words and answer words."""

    def __init__(self, items: list[tuple[int, list[str]]], vocabulary: dict[str, int]):
        self.items = items
        self.words = sorted({w for _, ws in items for w in ws})
        ids = {w: i for i, w in enumerate(self.words)}
        self.rows = [np.array([ids[w] for w in ws], dtype=np.int64) for _, ws in items]
        self.queries = [q for row in self.rows for q in pieces(row)]
        self.owner = np.repeat(np.arange(len(self.rows)), [len(pieces(row)) for row in self.rows])
        self.here = np.full(len(vocabulary) + 1, -1, dtype=np.int64)  # the last one is for words outside
        self.here[[vocabulary[w] for w in self.words]] = np.arange(len(self.words))

    def weigh(self, df: np.ndarray, n: int) -> None:
        idf = np.log((n + 1) / (df + 1)) + 0.1
        rare = df - 3 * np.sqrt(df) <= MAX_DF * n  # common is a word whose count says so by three times its own error
        keep = rare.copy()
        telling = []  # of each query: its rare words and at least the rarest half
        for row in self.queries:
            distinct = np.unique(row)
            least = distinct[np.argsort(df[distinct], kind="stable")][: int(np.ceil(KEEP_SHARE * len(distinct)))]
            keep[least] = True
            telling.append(np.union1d(distinct[rare[distinct]], least))
        self.mark_query = np.repeat(np.arange(len(telling)), [len(x) for x in telling])
        self.mark_need = np.maximum(1, np.ceil(MIN_SHARE * np.array([len(x) for x in telling]))).astype(np.int64)
        marked = np.concatenate(telling)
        self.mark_of = np.argsort(marked, kind="stable")  # marks of word i: mark_of[mark_at[i]:mark_at[i + 1]]
        self.mark_at = np.searchsorted(marked[self.mark_of], np.arange(len(self.words) + 1))
        self.weight = np.where(keep, idf, 0.0)
        self.outside = float(np.median(idf[keep]))
        self.answers = []
        for row in self.rows:
            distinct = np.unique(row)
            self.answers.append(distinct[np.argsort(-idf[distinct], kind="stable")][: -(-len(distinct) // 4)])

    def learn(self, rows: DataFrame) -> None:
        df, n = document_frequency(rows, self.here, len(self.words))
        self.weigh(df, n)
        rank = len(self.queries) + EXTRA
        omega = test_matrix(self.words, min(rank + OVER, len(self.words)))
        # plain values for the tasks, not this object
        here, weight, outside = self.here, self.weight, self.outside
        shared = rows.sparkSession.sparkContext.broadcast(omega)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shared.value.shape)
            for batch in slices(batches, "_ids", _SLICE):
                ids, at, _ = places(id_rows(batch), STEP * PASSAGE)
                gram_times(here[ids], at, weight, outside, shared.value, total)
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([x.tobytes() for x in total[used].astype(np.float32)], pa.binary())], ["i", "row"])

        got = _sum_rows(rows.mapInArrow(run, "i int, row binary")).toArrow()  # a row a word of the block
        sketch = np.zeros(omega.shape)
        for i, row in zip(got.column("i").to_pylist(), got.column("row").to_pylist()):
            sketch[i] = np.frombuffer(row, np.float64)
        own_ids = np.concatenate(self.queries)
        own_at = np.repeat(np.arange(len(self.queries)), [len(r) for r in self.queries])
        # both Gram matrices have a trace near the number of their rows
        sketch = sketch / max(n, 1) + gram_times(own_ids, own_at, weight, outside, omega) * (ITEM_WEIGHT / len(self.queries))
        basis = latent_basis(sketch, omega, rank)
        unit = np.zeros((len(self.words), len(self.queries)))
        for k, row in enumerate(self.queries):
            np.add.at(unit[:, k], row, weight[row])
            size = np.linalg.norm(unit[:, k])
            unit[:, k] /= size if size > 0 else 1
        self.table = ((basis @ (basis.T @ unit)) * weight[:, None]).astype(np.float32)

    def state(self) -> dict:
        return {"here": self.here, "rows": self.rows, "answers": self.answers, "table": self.table, "weight": self.weight,
                "outside": self.outside, "names": [i for i, _ in self.items], "owner": self.owner, "mark_query": self.mark_query, "mark_need": self.mark_need,
                "mark_of": self.mark_of, "mark_at": self.mark_at}


def candidates(ids: np.ndarray, at: np.ndarray, first: np.ndarray, s: dict, min_cosine: float) -> Iterator[tuple[int, int, int, float]]:
    """(first step, steps, query, cosine) of the windows close enough to a query.

    ``at`` is the step of every word. Windows may run over the end of their document, never into the next one.
    """
    n = int(first[-1])
    w = np.where(ids >= 0, s["weight"][np.maximum(ids, 0)], s["outside"])
    use = np.flatnonzero((ids >= 0) & (w > 0))
    own, step = ids[use], at[use]
    # up to rounding of the 32-bit table, no item's product exceeds the sum of the words' greatest products
    bound = np.bincount(step, np.maximum(s["table"].max(axis=1), 0)[own] * (1 + 1e-5), n)
    energy = np.bincount(at, w * w, n)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    head = np.searchsorted(step, np.arange(n + 1))
    for size in WINDOWS:
        reach, energies = bound.copy(), energy.copy()
        end = np.minimum(np.arange(n) + size, first[owner + 1])
        for k in range(1, size):
            same = np.flatnonzero(np.arange(n) + k < end)
            reach[same] += bound[same + k]
            energies[same] += energy[same + k]
        norm = np.sqrt(energies)
        hopeful = np.flatnonzero((reach >= min_cosine * norm) & (head[end] > head[:-1]))
        for k in range(0, len(hopeful), _CHUNK // 8):
            some = hopeful[k:k + _CHUNK // 8]
            many = head[end[some]] - head[some]
            begin = np.cumsum(many) - many
            place = np.repeat(head[some] - begin, many) + np.arange(int(many.sum()))
            cosine = segment_sums(s["table"], own[place], begin) / norm[some][:, None]
            for r, item in zip(*np.nonzero(cosine >= min_cosine)):
                yield int(some[r]), size, int(item), float(cosine[r, item])


def sharing(ids: np.ndarray, at: np.ndarray, first: np.ndarray, s: dict) -> Iterator[tuple[int, int, int]]:
    """(first step, steps, query) of the windows that hold ``MIN_SHARE`` of a query's telling words, each word counted once."""
    n, size, marks = int(first[-1]), max(WINDOWS), len(s["mark_query"])
    known = np.flatnonzero(ids >= 0)
    many = (s["mark_at"][1:] - s["mark_at"][:-1])[ids[known]]
    known, many = known[many > 0], many[many > 0]
    own, step = ids[known], at[known]
    start_of = np.repeat(first[:-1], np.diff(first))  # of each step: the first step of its document
    work = np.cumsum(np.bincount(step, many, n)).astype(np.int64)
    cuts = np.unique(np.concatenate((np.searchsorted(work, np.arange(0, int(work[-1]) + 1, _PAIRS)), np.arange(0, n, _SLICE // 64), [n])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # windows that start in a <= step < b
        lo, hi = np.searchsorted(step, (a, b + size - 1))
        count = many[lo:hi]
        begin = np.cumsum(count) - count
        mark = s["mark_of"][np.repeat(s["mark_at"][own[lo:hi]] - begin, count) + np.arange(int(count.sum()))]
        # two neighbouring pieces of ``size`` steps hold every window: few get there, though words count as often as they stand
        here = np.repeat(step[lo:hi], count)
        query = s["mark_query"][mark]
        coarse = (here - a) // size + 1
        width = len(s["mark_need"])
        seen = np.bincount(coarse * width + query, minlength=((b - a) // size + 4) * width).reshape(-1, width)
        wanted = seen[:-1] + seen[1:] >= s["mark_need"]
        some = np.flatnonzero(wanted[coarse, query] | wanted[coarse - 1, query])
        here, mark = here[some], mark[some]
        windows = (here[:, None] - np.arange(size)).ravel()
        mark = np.repeat(mark, size)
        fits = (windows >= np.repeat(start_of[here], size)) & (windows >= a) & (windows < b)
        pair = np.unique(windows[fits] * marks + mark[fits])
        pair = pair // marks * width + s["mark_query"][pair % marks]  # sorted: marks are in the order of queries
        pair, found = np.unique(pair, return_counts=True)
        good = pair[found >= s["mark_need"][pair % width]]
        yield from zip((good // width).tolist(), [size] * len(good), (good % width).tolist())


def phrases(ids: np.ndarray, at: np.ndarray, first: np.ndarray, s: dict) -> Iterator[tuple[int, int, int]]:
    """(first step, steps, query) of the places of items under ``SHORT_ITEM`` words, word after word in one document."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for query, item in enumerate(s["owner"].tolist()):
        row = s["rows"][item]
        if len(row) >= SHORT_ITEM:
            continue
        hits = np.flatnonzero(ids[: max(0, len(ids) - len(row) + 1)] == row[0])
        for k in range(1, len(row)):
            hits = hits[ids[hits + k] == row[k]]
        hits = hits[owner[at[hits]] == owner[at[hits + len(row) - 1]]]
        _, once = np.unique(owner[at[hits]], return_index=True)
        yield from ((int(at[k]), min(WINDOWS), query) for k in hits[once])


def cosine_of(step: int, size: int, query: int, ids: np.ndarray, at: np.ndarray, first: np.ndarray, s: dict) -> float:
    end = min(step + size, int(first[np.searchsorted(first, step, side="right")]))
    own = ids[slice(*np.searchsorted(at, (step, end)))]
    known = own[own >= 0]
    norm = np.sqrt((s["weight"][known] ** 2).sum() + (len(own) - len(known)) * s["outside"] ** 2)
    return float(s["table"][known[s["weight"][known] > 0], query].sum() / norm) if norm > 0 else 0.0


def find_leaks(docs: list[np.ndarray], s: dict, min_cosine: float, min_lcs: float, min_answer: float) -> list[list[dict]]:
    """For every text (vocabulary ids) the items found in it, with the figures of the closest window that passes all checks."""
    out: list[list[dict]] = [[] for _ in docs]
    ids, at, first = places(docs, STEP)
    if not len(ids):
        return out
    ids = s["here"][ids]
    start_of = np.cumsum([0, *map(len, docs)]).tolist()
    heads = first.tolist()
    plain: dict[int, tuple[list[int], list[int]]] = {}

    def around(place: tuple[int, int, int]) -> tuple[int, int, int, int]:
        """(document, item, first word, end) of what is compared with the item of a candidate."""
        step, size, query = place
        doc, item = bisect_right(heads, step) - 1, int(s["owner"][query])
        start, edge = (step - heads[doc]) * STEP, max(STEP, len(s["rows"][item]))
        return doc, item, start_of[doc] + max(0, start - edge), min(start_of[doc + 1], start_of[doc] + start + size * STEP + edge)

    def hopeful(place: tuple[int, int, int]) -> bool:
        """Whether enough of the item's words are there at all, in whatever order."""
        _, item, lo, hi = around(place)
        if item not in plain:
            plain[item] = s["rows"][item].tolist(), s["answers"][item].tolist()
        (row, answers), there = plain[item], set(ids[lo:hi].tolist())
        least = min_lcs if sum(map(there.__contains__, answers)) >= min_answer * len(answers) else max(min_lcs, SURE_LCS)
        return sum(map(there.__contains__, row)) >= (1.0 if len(row) < SHORT_ITEM else least) * len(row)

    close = {c[:3]: c[3] for c in candidates(ids, at, first, s, min_cosine) if hopeful(c[:3])}
    for place in (*sharing(ids, at, first, s), *phrases(ids, at, first, s)):
        if place not in close and hopeful(place):
            close[place] = cosine_of(*place, ids, at, first, s)
    done = set()
    for place, cosine in sorted(close.items(), key=lambda c: (-c[1], c[0])):
        doc, item, lo, hi = around(place)
        if (doc, item) in done:
            continue
        row, wide = s["rows"][item], ids[lo:hi]
        share = lcs_length(row, wide) / len(row)
        answer = float(np.isin(s["answers"][item], wide).mean())
        if share >= (min_lcs if len(row) >= SHORT_ITEM else 1.0) and (answer >= min_answer or share >= SURE_LCS):
            done.add((doc, item))
            out[doc].append({"item_id": s["names"][item], "cosine": cosine, "lcs_share": share, "answer_share": answer})
    return out


FOUND = "array<struct<item_id:bigint,cosine:double,lcs_share:double,answer_share:double>>"


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               min_cosine: float = MIN_COSINE, min_lcs: float = MIN_LCS, min_answer: float = MIN_ANSWER,
               carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (``carry`` columns, default all) plus leaks: array of (item_id, cosine, lcs_share, answer_share).

    Null and empty texts hold no items; null or empty items (and an empty benchmark) are found nowhere; repeated
    items or documents each give their own entry. Items of fewer than ``SHORT_ITEM`` words count only when found whole. The
    benchmark is the query set and passes the driver; documents never do. An input column named leaks is replaced.
    """
    carry = docs.columns if carry is None else carry
    shape = docs.select(*[f"`{c}`" for c in carry]).schema
    given = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("t")).orderBy("i", "t")
    items = [(r["i"], [w for w in (normal(x) for x in r["t"].encode().split()) if w]) for r in given.toLocalIterator()]
    items = [(i, words) for i, words in items if words]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in items for w in words}))}
    shared_words = docs.sparkSession.sparkContext.broadcast(vocabulary)
    base = pack(docs, carry, _text=text_of(text_col).cast("binary"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([*shared_words.value, ""], pa.string())
        for batch in slices(batches, "_text"):
            ids = [x.tobytes() for x in word_ids(batch.column("_text"), known)]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(ids, pa.binary())], [ROW, "_ids"])

    rows = materialize(base.mapInArrow(number, base.select(ROW).schema.add("_ids", "binary")), "op4-words")
    out = rows.withColumn("_leaks", F.array().cast(FOUND))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64())]))

    def search(frame: DataFrame, block: list[tuple[int, list[str]]]) -> DataFrame:
        part = Block(block, vocabulary)
        part.learn(rows.select("_ids"))
        shared = docs.sparkSession.sparkContext.broadcast(part.state())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_ids", _SLICE):
                new = find_leaks(id_rows(batch), shared.value, min_cosine, min_lcs, min_answer)
                found = [(a or []) + b for a, b in zip(batch.column("_leaks").to_pylist(), new)]
                yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("_ids"), pa.array(found, kind)], [ROW, "_ids", "_leaks"])

        return frame.mapInArrow(run, StructType(frame.schema.fields))

    for block in blocks(items):
        out = search(out, block)
    return unpack(out, shape, {"leaks": F.col("_leaks")})
