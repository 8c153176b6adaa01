"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is computed in time linear in the
features of a text as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2 per factor.

* hashed words: counts of lower-cased words in ``2**WORD_BITS`` buckets, scaled to length one;
* structure: shares and sizes (letters, symbols, repeated lines, ...), each put in one of ``BINS`` bins;
* metadata: numeric columns named by the caller, put in bins by magnitude.

The model has a fixed size (``DIM`` x (FACTORS + 1) floats). It is fitted on at most ``max_train`` labelled rows,
chosen by hash of the row; scoring is one pass over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmon.llm.common import ROW, materialize, pack, slices, text_of, unpack

WORD_BITS = 16
FACTORS = 8
BINS = 24
STATS = 15
META_FIELDS = 4
DIM = (1 << WORD_BITS) + (STATS + META_FIELDS) * BINS
#: Most labelled rows that a model is fitted on.
MAX_TRAIN = 20_000
EPOCHS = 8
#: Small samples get more rounds, so that the model takes this many steps in all.
LEAST_STEPS = 200
_CACHE = 200_000

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_STOP = b".,;:?'\"()-"
_SYMBOL = bytes(c for c in range(33, 127) if c not in _UPPER + _LOWER + _DIGIT + _STOP)
_HIGH = bytes(range(128, 256))
_CONTROL = bytes(c for c in range(32) if c not in b"\t\n\r")


def _share_bin(part: float, whole: float) -> int:
    """Fine bins near zero: the square root of a share, in BINS - 1 steps."""
    return min(BINS - 1, int(math.sqrt(max(0.0, min(1.0, part / whole if whole else 0.0))) * (BINS - 1) + 0.5))


def _size_bin(x: float) -> int:
    return max(0, min(BINS - 1, int(1.5 * math.log2(1 + max(0.0, x)))))


def structure_bins(text: bytes, words: list[bytes]) -> list[int]:
    """One bin per statistic, from the whole text."""
    n, gone = len(text), len(text.translate(None, b" \t\n\r\x0b\x0c"))
    has = lambda chars: n - len(text.translate(None, chars))
    upper, lower, symbol = has(_UPPER), has(_LOWER), has(_SYMBOL)
    lines = text.split(b"\n")
    many = len(words)
    odd_end = sum(w[-1] in _SYMBOL for w in words)
    return [
        _size_bin(n), _size_bin(many), _size_bin(4 * gone / many if many else 0), _size_bin(len(lines)),
        _share_bin(upper, upper + lower), _share_bin(symbol, gone), _share_bin(has(_DIGIT), gone), _share_bin(has(_STOP), gone),
        _share_bin(has(_HIGH), gone), _share_bin(has(_CONTROL), n), _share_bin(odd_end, many),
        _share_bin(len(set(words)), many), _share_bin(len(set(lines)), len(lines)),
        _share_bin(sum(len(w) == 1 for w in words), many), _share_bin(sum(map(eq, words, words[1:])), many),
    ]


@dataclass
class Rows:
    """Sparse rows: row i holds idx[at[i]:at[i + 1]] with values val."""
    at: np.ndarray
    idx: np.ndarray
    val: np.ndarray


class Featurizer:
    def __init__(self) -> None:
        self.buckets: dict[bytes, int] = {}

    def rows(self, texts: list[bytes], metas: list[list[float | None]]) -> Rows:
        idx, val, at = [], [], [0]
        base, mask = 1 << WORD_BITS, (1 << WORD_BITS) - 1
        for text, meta in zip(texts, metas):
            words = text.split()
            seen = self.buckets
            found = [seen.get(w, -1) for w in words]
            if -1 in found:
                if len(seen) > _CACHE:
                    seen.clear()
                for w in words:
                    if w not in seen:
                        seen[w] = crc32(w.lower()) & mask
                found = [seen[w] for w in words]
            if found:
                bucket, count = np.unique(np.array(found, dtype=np.int64), return_counts=True)
                idx.append(bucket)
                val.append(count / math.sqrt(float((count.astype(np.float64) ** 2).sum())))
            bins = [base + k * BINS + b for k, b in enumerate(structure_bins(text, words))]
            for k, x in enumerate(meta[:META_FIELDS]):
                if x is not None and x == x:
                    bins.append(base + (STATS + k) * BINS + _size_bin(abs(x)))
            idx.append(np.array(bins))
            val.append(np.ones(len(bins)))
            at.append(at[-1] + len(bins) + (len(idx[-2]) if found else 0))
        return Rows(np.array(at), np.concatenate(idx) if idx else np.zeros(0, np.int64), np.concatenate(val) if val else np.zeros(0))


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, rows: Rows) -> np.ndarray:
        first = rows.at[:-1]
        vx = self.v[rows.idx] * rows.val[:, None].astype(np.float32)
        total = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat(vx * vx, first, axis=0)
        return self.w0 + np.add.reduceat(self.w[rows.idx] * rows.val, first) + 0.5 * (total * total - squares).sum(axis=1)

    def scores(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def fit(rows: Rows, labels: np.ndarray, epochs: int = EPOCHS, step: float = 0.1, l2: float = 2e-4, batch: int = 256, seed: int = 11) -> Model:
    """Logistic loss, AdaGrad over shuffled batches. Without both classes the score is the smoothed share of ones."""
    rng = np.random.default_rng(seed)
    ones, n = float(labels.sum()), len(labels)
    prior = (ones + 1) / (n + 2)
    model = Model(math.log(prior / (1 - prior)), np.zeros(DIM), np.zeros((DIM, FACTORS), dtype=np.float32))
    if not 0 < ones < n:
        return model
    model.v[:] = rng.normal(0, 0.02, model.v.shape)
    gw, gv, g0 = np.full(DIM, 1e-2), np.full((DIM, FACTORS), 1e-2, dtype=np.float32), 1e-2
    sizes = np.diff(rows.at)
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // n) if epochs == EPOCHS else 0)):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            some = order[k:k + batch]
            size = sizes[some]
            at = np.concatenate(([0], np.cumsum(size)))
            pick = np.repeat(rows.at[some] - at[:-1], size) + np.arange(at[-1])
            idx, val = rows.idx[pick], rows.val[pick]
            owner = np.repeat(np.arange(len(some)), size)
            vx = model.v[idx] * val[:, None].astype(np.float32)
            total = np.add.reduceat(vx, at[:-1], axis=0)
            margin = model.w0 + np.add.reduceat(model.w[idx] * val, at[:-1]) + 0.5 * (total * total - np.add.reduceat(vx * vx, at[:-1], axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) / len(some)
            pull = error[owner] * val
            g0 += error.sum() ** 2
            model.w0 -= step * error.sum() / math.sqrt(g0)
            touched, place = np.unique(idx, return_inverse=True)
            grad = np.bincount(place, pull, len(touched)) + l2 * model.w[touched]
            gw[touched] += grad ** 2
            model.w[touched] -= step * grad / np.sqrt(gw[touched])
            cross = (total[owner] - vx) * pull[:, None].astype(np.float32)
            grad = np.stack([np.bincount(place, cross[:, f], len(touched)) for f in range(FACTORS)], axis=1) + l2 * model.v[touched]
            gv[touched] += grad ** 2
            model.v[touched] -= step * grad / np.sqrt(gv[touched])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, meta_cols: list[str],
          max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` distinct rows of ``docs`` with a label of 0 or 1 (the lesser one if an id has both).

    Rows with the same id, text and metadata count once. The sample is chosen by hash of the whole row, whatever its label.
    """
    marks = (labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id"))
             .agg(F.min(label_col).cast("double").alias("_y")))
    base = pack(docs, [], _id=F.col(id_col), _text=text_of(text_col).cast("binary"),
                _meta=F.array(*[F.col(f"`{c}`").cast("double") for c in meta_cols]).cast("array<double>"))
    base = base.withColumn("_h", F.xxhash64("_text", "_meta"))
    have = materialize(base.select("_id", "_h").join(marks, "_id").distinct().withColumn("_order", F.xxhash64("_id", "_h")), "op1-labelled")
    # the least hashes: only rows under a threshold that max_train of them pass (six errors to spare) are sorted, whatever the number of rows
    share = min(1.0, (max_train + 6 * max_train ** 0.5) / max(1, have.count()))
    least = have.filter(F.col("_order") <= int(-(2 ** 63) + share * (2 ** 64 - 1))) if share < 1 else have
    sample = least.orderBy("_order", "_id", "_h").limit(max_train).drop("_order")  # at most max_train rows of 24 bytes
    rows = base.join(F.broadcast(sample), ["_id", "_h"]).select("_id", "_h", "_y", "_text", "_meta")
    key = rows.select("_id", "_h").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, done = Featurizer(), set()  # at most max_train keys
        for batch in slices(batches, "_text"):
            keys = list(zip(batch.column("_id").to_pylist(), batch.column("_h").to_pylist()))
            fresh = [k not in done and not done.add(k) for k in keys]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            if not batch.num_rows:
                continue
            made = maker.rows(batch.column("_text").to_pylist(), batch.column("_meta").to_pylist())
            cut = [slice(a, b) for a, b in zip(made.at[:-1], made.at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_h"), batch.column("_y"), pa.array([made.idx[c].astype(np.int32).tobytes() for c in cut], pa.binary()),
                 pa.array([made.val[c].astype(np.float32).tobytes() for c in cut], pa.binary())], ["_id", "_h", "y", "idx", "val"])

    made = rows.mapInArrow(run, key.add("y", "double").add("idx", "binary").add("val", "binary"))
    # a row a key of the sample: max_train at most; order fixed so that a rerun fits the same model
    got = made.dropDuplicates(["_id", "_h"]).select("y", "idx", "val").toArrow()
    got = got.take(pc.sort_indices(got, sort_keys=[("y", "ascending"), ("idx", "ascending"), ("val", "ascending")]))
    idx = [np.frombuffer(x, np.int32) for x in got.column("idx").to_pylist()]
    val = [np.frombuffer(x, np.float32) for x in got.column("val").to_pylist()]
    at = np.concatenate(([0], np.cumsum([len(x) for x in idx], dtype=np.int64)))
    flat = Rows(at, np.concatenate(idx).astype(np.int64) if idx else np.zeros(0, np.int64), np.concatenate(val).astype(np.float64) if val else np.zeros(0))
    return fit(flat, got.column("y").to_numpy())


def quality_scores(docs: DataFrame, model: Model, text_col: str = "text", meta_cols: list[str] | None = None,
                   threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (``carry`` columns, default all) plus score (0 to 1) and predicted (1 if score >= threshold).

    Null texts score as empty ones, null metadata is an absent feature; equal texts and metadata
    score alike. Texts of any length are read whole. Input columns named like the added ones are replaced.
    """
    carry = docs.columns if carry is None else carry
    shape = docs.select(*[f"`{c}`" for c in carry]).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x (FACTORS + 1) floats, about 3 MB
    base = pack(docs, carry, _text=text_of(text_col).cast("binary"),
                _meta=F.array(*[F.col(f"`{c}`").cast("double") for c in meta_cols or []]).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Featurizer()
        for batch in slices(batches, "_text", 2 << 20):
            rows = maker.rows(batch.column("_text").to_pylist(), batch.column("_meta").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(shared.value.scores(rows), pa.float64())], [ROW, "_score"])

    scored = base.mapInArrow(run, base.select(ROW).schema.add("_score", "double"))
    return unpack(scored, shape, {"score": F.col("_score"), "predicted": (F.col("_score") >= threshold).cast("int")})
