"""Subword lattice likelihood: the probability of a text summed over all its segmentations.

The vocabulary (pieces and their scores) is an existing one and stays fixed. Its scores, turned into a rank
distribution, start the piece probabilities; ``rounds`` of expectation maximisation over all distinct training words
adapt them. A text is its lower-cased words and one end. Pieces never cross white space, so a text's log
probability is a sum over words, each a log-space forward recursion over the word's lattice; a training word also is an
arc of its own, over the whole word, with its absolutely discounted unigram score. The mass that the discount frees
goes to the paths of pieces, so words never seen have probability as well.

Corpus statistics are a written word-count table that grows with the input. The ``HEAD_WORDS`` most
frequent words up to ``HEAD_BYTES`` bytes are sent to every task (a bounded table); all other words get their counts by
a join, which adaptive execution can split.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, inf, log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txmon.llm.common import ROW, materialize, pack, slices, text_of, unpack

HEAD_WORDS = 100_000
HEAD_BYTES = 64
ROUNDS = 2
#: Longest text (characters) handled in arrays with others of its length.
VECTOR_CHARS = 40
_FLUSH = 500_000
MARK = "▁"
_LN10 = log(10)


class PieceTable:
    """Ids of pieces by a hash of their characters, looked up for whole arrays at once (open addressing)."""

    BASE, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.bits = max(10, (8 * len(pieces)).bit_length())
        base, mask, found = int(self.BASE), (1 << 64) - 1, []
        for piece in pieces:
            h = 0
            for c in piece:  # as step() does
                h = (h * base + ord(c) + 1) & mask
            found.append(h)
        keys = np.array(found, dtype=np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.keys = keys
        self.slots = np.full((1 << self.bits) + 64, -1, dtype=np.int32)
        for k, slot in enumerate(self.slot(keys).tolist()):
            while self.slots[slot] >= 0:
                slot += 1
            self.slots[slot] = k

    def step(self, h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The hash of a text longer by one character."""
        return h * self.BASE + codes + np.uint64(1)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * self.SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 for none."""
        slot = self.slot(h)
        ids = self.slots[slot]
        other = np.flatnonzero((ids >= 0) & (self.keys[ids] != h))
        while len(other):
            slot[other] += 1
            ids[other] = self.slots[slot[other]]
            other = other[(ids[other] >= 0) & (self.keys[ids[other]] != h[other])]
        return ids


class Lattice:
    """Log probabilities of paths of pieces; characters outside the vocabulary fall back to their bytes."""

    def __init__(self, pieces: list[str], logs: np.ndarray):
        self.longest = max(map(len, pieces))
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.table = PieceTable(pieces)
        self.logs = np.append(logs, -inf)  # id -1: no such piece
        self.byte_ids = [self.ids[f"<0x{b:02X}>"] for b in range(256)]

    def arcs(self, text: str) -> list[tuple[int, int, list[int]]]:
        """(from, to, piece ids) of every arc; an unknown character is one arc of byte pieces."""
        out = []
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                if (at := self.ids.get(text[i:j])) is not None:
                    out.append((i, j, [at]))
                elif j == i + 1:
                    out.append((i, j, [self.byte_ids[b] for b in text[i].encode()]))
        return out

    def one(self, text: str, into: np.ndarray | None = None) -> float:
        """Forward recursion over one text; with ``into``, also adds the expected uses of pieces."""
        arcs = self.arcs(text)
        alpha = [0.0] + [-inf] * len(text)
        terms: list[list[float]] = [[] for _ in range(len(text) + 1)]
        at = 0
        for i, j, ids in arcs:  # ordered by start: alpha[i] is complete when its first arc comes
            while at < i:
                at += 1
                alpha[at] = _log_sum(terms[at])
            terms[j].append(alpha[i] + sum(self.logs[k] for k in ids))
        while at < len(text):
            at += 1
            alpha[at] = _log_sum(terms[at])
        if into is not None:
            beta = [-inf] * len(text) + [0.0]
            back: list[list[float]] = [[] for _ in range(len(text) + 1)]
            for i, j, ids in sorted(arcs, key=lambda a: -a[0]):
                if beta[j] == -inf:
                    beta[j] = _log_sum(back[j])
                back[i].append(beta[j] + sum(self.logs[k] for k in ids))
                for k in ids:
                    into[k] += exp(alpha[i] + back[i][-1] - alpha[-1])
        return alpha[-1]

    def many(self, words: list[bytes], into: np.ndarray | None = None) -> np.ndarray:
        """The same for many words, those of one length together (a few array operations an arc)."""
        out = np.zeros(len(words))
        by: dict[int, list[int]] = {}
        texts = [MARK + w.decode() for w in words]
        for k, text in enumerate(texts):
            by.setdefault(len(text), []).append(k)
        for n, members in by.items():
            for start in range(0, len(members), 8192):
                some = members[start:start + 8192]
                own = [texts[k] for k in some]
                if n > VECTOR_CHARS or len(some) < 4 or any("\0" in t for t in own):  # arrays drop closing zeros
                    out[some] = [self.one(t, into) for t in own]
                else:
                    out[some] = self._column(own, n, into)
        return out

    def _column(self, texts: list[str], n: int, into: np.ndarray | None) -> np.ndarray:
        """Forward (and backward) recursion over texts of ``n`` characters at once."""
        size = len(texts)
        codes = np.ascontiguousarray(np.array(texts, dtype=f"<U{n}").view(np.uint32).reshape(size, n).T).astype(np.uint64)
        cells, odd = {}, np.zeros(size, dtype=bool)
        for i in range(n):
            h = np.zeros(size, dtype=np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = self.table.step(h, codes[j - 1])
                ids = self.table.find(h)
                if j == i + 1:
                    odd |= ids < 0
                if (ids >= 0).any():
                    cells[i, j] = ids, self.logs[ids]
        alpha = [np.zeros(size)]
        for j in range(1, n + 1):
            alpha.append(_log_sums([alpha[i] + cells[i, j][1] for i in range(max(0, j - self.longest), j) if (i, j) in cells], size))
        which = np.flatnonzero(odd)  # texts with characters outside the vocabulary
        alpha[n][which] = [self.one(texts[k], into) for k in which.tolist()]
        if into is not None:
            beta: list = [None] * n + [np.zeros(size)]
            used, uses = [], []
            for i in range(n - 1, -1, -1):
                terms = []
                for j in range(i + 1, min(n, i + self.longest) + 1):
                    if (i, j) in cells:
                        ids, logs = cells[i, j]
                        terms.append(logs + beta[j])
                        use = np.flatnonzero((ids >= 0) & ~odd)
                        used.append(ids[use])
                        uses.append(np.exp(alpha[i][use] + terms[-1][use] - alpha[n][use]))
                beta[i] = _log_sums(terms, size)
            into += np.bincount(np.concatenate(used), np.concatenate(uses), len(into)) if used else 0
        return alpha[n]


def _log_sum(terms: list[float]) -> float:
    top = max(terms, default=-inf)
    return top if top == -inf or len(terms) == 1 else top + log(sum([exp(t - top) for t in terms]))


def _log_sums(terms: list[np.ndarray], n: int) -> np.ndarray:
    if not terms:
        return np.full(n, -inf)
    top = terms[0]
    for t in terms[1:]:
        top = np.maximum(top, t)
    safe = np.where(top == -inf, 0.0, top)
    total = np.exp(terms[0] - safe)
    for t in terms[1:]:
        total += np.exp(t - safe)
    with np.errstate(divide="ignore"):
        return safe + np.log(total)


def read_vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece model and start probabilities from its scores.

    Scores of merge vocabularies are negative ranks, so piece of rank r starts in proportion to 1 / (r + 100);
    byte pieces share the weight of the last rank, which the bare word mark also gets. Control and never-used pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weights = [], []
    last = max(-model.get_score(i) for i in range(model.get_piece_size()) if model.get_score(i) > -1e8)
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or (score <= -1e8 and piece != MARK):
            continue
        pieces.append(piece)
        weights.append(1 / (256 * (last + 100)) if model.is_byte(i) else 1 / (100 + min(-score, last)))
    start = np.array(weights)
    return pieces, start / start.sum()


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of bytes other than space and 0x09-0x0D."""
    return text.lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """Written table (word, c): all words of ``_text``, counted where ``_train``; combined inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in slices(batches, "_text"):
            for text, train in zip(batch.column("_text").to_pylist(), batch.column("_train").to_pylist()):
                if train:
                    held.update(words_of(text))
                else:
                    for word in words_of(text):
                        if word not in held:
                            held[word] = 0
                if len(held) > _FLUSH:
                    yield flush()
        if held:
            yield flush()

    return materialize(texts.select("_text", "_train").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "op3-words")


def adapt(words: DataFrame, pieces: list[str], start: np.ndarray, rounds: int = ROUNDS, prior: float = 100.0) -> np.ndarray:
    """Piece log probabilities after ``rounds`` of expectation maximisation over every distinct word.

    Each distinct word counts once, as the paths of pieces stand in for words not seen before. ``prior`` pseudo-counts follow
    the vocabulary's own scores, so no piece has probability 0.
    """
    p = start
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(np.log(p))  # one number a piece

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, into = Lattice(pieces, shared.value), np.zeros(len(pieces))
            for batch in batches:
                lattice.many(batch.column(0).to_pylist(), into)
            used = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(into[used])], ["i", "x"])

        got = words.select("word").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()  # a row a piece at most
        into = prior * start
        np.add.at(into, got.column("i").to_numpy(), got.column("x").to_numpy())
        p = into / into.sum()
    return np.log(p)


def word_scores(words: DataFrame, pieces: list[str], logs: np.ndarray, whole: float, total: int, discount: float, free: float) -> DataFrame:
    """Written table (word, c, base, score): log10 probabilities under both models, once for every word there is."""
    model = words.sparkSession.sparkContext.broadcast((pieces, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for batch in batches:
            c = batch.column(1).to_numpy()
            path = lattice.many(batch.column(0).to_pylist()) / _LN10 + free
            with np.errstate(divide="ignore"):
                arc = np.log10(np.maximum(c - discount, 0) / max(total, 1))
            top = np.maximum(arc, path)
            score = top + np.log10(10 ** (arc - top) + 10 ** (path - top))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.log10((c + 0.1) / whole)), pa.array(score)], ["word", "c", "base", "score"])

    return materialize(words.mapInArrow(run, "word binary, c long, base double, score double"), "op3-scores")


def lattice_scores(docs: DataFrame, train: Column, vocabulary: str, text_col: str = "text",
                   carry: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``docs`` (``carry`` columns, default all) plus n_tokens, n_known, train_tokens, base_score, score.

    Rows where ``train`` is true give the statistics. ``score`` is the log10 probability of the text under the piece
    lattice, ``base_score`` under an additively smoothed (0.1) word unigram model with the same tokens. Null
    and empty texts are the end alone. With no training rows counts are zero and scores come from the vocabulary's own scores (the base
    score is then 0, the only event having all the mass). Repeated rows count each time. Input columns
    named like the added ones are replaced.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    shape = docs.select(*[f"`{c}`" for c in carry]).schema
    base = pack(docs, carry, _text=text_of(text_col).cast("binary"), _train=F.coalesce(train, F.lit(False)))
    words = count_words(base)
    ends = base.filter("_train").count()
    seen = words.filter("c > 0").agg(
        F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    distinct, total = seen["v"] + (ends > 0), seen["n"] + ends
    whole = total + 0.1 * (distinct + 1)
    # absolute discount from the counts of counts; what it frees is the mass of the paths of pieces
    discount = min(0.95, max(0.05, seen["n1"] / (seen["n1"] + 2 * seen["n2"]))) if seen["n1"] else 0.5
    free = log10(discount * seen["v"] / total) if seen["v"] else log10(0.99)
    end = log10(ends / total) if ends and seen["v"] else log10(0.01)
    base_end = log10((ends + 0.1) / whole)
    pieces, start = read_vocabulary(vocabulary)
    logs = adapt(words.filter("c > 0"), pieces, start, rounds)
    scored = word_scores(words, pieces, logs, whole, total, discount, free)
    head = scored.filter(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(HEAD_WORDS).toArrow()
    table = dict(zip(head.column("word").to_pylist(), zip(*(head.column(k).to_pylist() for k in ("c", "base", "score")))))
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, "_text"):
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("_text").to_pylist():
                counts = Counter(words_of(text))
                head_n, head_base, head_score, tail, times = int(ends > 0), base_end, end, [], []
                for word, n in counts.items():
                    own = known.get(word)
                    if own is None:
                        tail.append(word)
                        times.append(n)
                    else:
                        if own[0]:
                            head_n += n
                        head_base += n * own[1]
                        head_score += n * own[2]
                for at, x in enumerate((counts.total() + 1, head_n, head_base, head_score, tail, times)):
                    out[at].append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), *[pa.array(x, k) for x, k in zip(out, kinds)]],
                                             [ROW, "_n", "_known", "_base", "_score", "_words", "_times"])

    schema = StructType(base.select(ROW).schema.fields + StructType.fromDDL(
        "_n long, _known long, _base double, _score double, _words array<binary>, _times array<long>").fields)
    rows = materialize(base.select(ROW, "_text").mapInArrow(run, schema).withColumn("_uid", F.monotonically_increasing_id()), "op3-rows")
    tail = rows.select("_uid", F.explode(F.arrays_zip("_words", "_times")).alias("t")).select("_uid", F.col("t._words").alias("word"), F.col("t._times").alias("n"))
    rest = tail.join(scored, "word").groupBy("_uid").agg(
        F.sum(F.col("n") * F.col("base")).alias("_more"), F.sum(F.col("n") * F.col("score")).alias("_more_score"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_more_known"))
    out = rows.select(ROW, "_uid", "_n", "_known", "_base", "_score").join(rest, "_uid", "left")
    return unpack(out, shape, {
        "n_tokens": F.col("_n"), "n_known": F.col("_known") + F.coalesce("_more_known", F.lit(0)), "train_tokens": F.lit(total).cast("long"),
        "base_score": F.col("_base") + F.coalesce("_more", F.lit(0.0)), "score": F.col("_score") + F.coalesce("_more_score", F.lit(0.0))})
