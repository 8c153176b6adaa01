"""Removal of repeated byte strings: induced-sorting suffix arrays over shards of candidate text.

A byte goes when a ``MATCH``-byte string covering it also starts in a document with a smaller id. No task can hold the suffix
array of a corpus, so strings that could repeat are brought together in bounded shards first:

1. Anchors. Of the 25 grams (26 bytes) of a 50-byte string the one with the least hash is its anchor; equal strings have equal
   anchors at equal places, so strings can be dealt to shards by their anchor. Documents are dealt to groups of about
   ``GROUP_BYTES``; a group sends each anchor once, delta-coded, to the anchor's bucket.
2. A bucket replies to every group which of its anchors occur in two documents or more, and which are very frequent.
3. Groups send the strings around repeated anchors as segments (for very frequent anchors every string on its own, by its
   own hash, so no shard gathers a hot anchor's surroundings). Equal segments of a group travel once, with the smallest id;
   they are equal by 112 bits of hashes, and a shard compares their bytes.
4. A shard joins its different segments into one text, builds the suffix array by induced sorting and the permuted
   common prefixes; suffixes in a row with common prefixes of ``MATCH`` or more are one string, with one smallest id. It replies
   that id for every string to the groups.
5. Groups mark the strings that have a smaller id elsewhere, and cut the covered bytes.

Groups and buckets grow in number with the text, not in size. What a group and a bucket tell each other is one parcel: many
records compressed, few as they are, so that a parcel of a single record is not much larger than the record.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from txmon.llm.common import ROW, lean, materialize, pack, release, slices, text_of, unpack
from txmon.llm.suffix_array import permuted_prefixes, suffix_array

MATCH = 50
GRAM = 26
REACH = MATCH - GRAM + 1  # grams in a string
GROUP_BYTES = 24 << 20
BUCKET_BYTES = 32 << 20
CHUNK = 1 << 16  # window starts handled in one array operation
SHARD_BYTES = 2 << 20  # text of one suffix array
#: Documents (of all groups, counted in classes) from which an anchor's strings travel one by one.
HOT_DOCS = 256
_CLASSES = np.array([1, 2, 16, 128])  # documents of one group, rounded down
LEAST = -(1 << 63)


# --- parcels ------------------------------------------------------------------------------------

#: Records from which a parcel is compressed.
SMALL = 64
PARCEL = "n int, rec binary, more binary"
# routes come first and rise within a parcel; size counts the bytes of a record that stand in more
KEYS = np.dtype([("route", "<u8"), ("kind", "u1")])
TOLD = np.dtype([("route", "<u8"), ("hot", "u1")])
SEGMENTS = np.dtype([("route", "<u8"), ("seg", "<u8"), ("ord", "<i8"), ("at", "u1"), ("size", "u1")])
OWNERS = np.dtype([("route", "<u8"), ("seg", "<u8"), ("first", "<i8"), ("size", "u1")])
NOTHING = np.zeros(0, np.uint8)


def ranges(lo: np.ndarray, many: np.ndarray) -> np.ndarray:
    """lo, lo + 1, .. (``many`` of them) for every entry, in a row."""
    ends = np.cumsum(many)
    return np.repeat(lo - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)


def edges(rec: np.ndarray) -> np.ndarray:
    """Where each record's bytes begin in more, and where the last ones end."""
    sizes = rec["size"] if "size" in rec.dtype.names else np.zeros(len(rec), np.uint8)
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def squeezed(rec: np.ndarray, more: np.ndarray) -> bytes:
    """Records by column, routes as differences, and their bytes, compressed."""
    columns = [np.ascontiguousarray(rec[f]) for f in rec.dtype.names]
    columns[0] = np.diff(columns[0], prepend=np.uint64(0))
    raw = b"".join([*[c.tobytes() for c in columns], more.tobytes()])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def swelled(blob: bytes, n: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    rec, at = np.empty(n, kind), 0
    for f in kind.names:
        rec[f] = np.frombuffer(raw, kind[f], n, at)
        at += n * kind[f].itemsize
    rec["route"] = np.cumsum(rec["route"])
    return rec, np.frombuffer(raw, np.uint8, offset=at)


def parcels(rec: np.ndarray, more: np.ndarray, starts: np.ndarray, **head: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (``head``, n, rec, more): parcel k holds the records from ``starts[k]`` on; n is negative if it is compressed."""
    many = np.diff(np.append(starts, len(rec)))
    edge = edges(rec)
    names = [*head, "n", "rec", "more"]

    def rows(which: np.ndarray, n: np.ndarray, *values: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(x[which], pa.int32()) for x in head.values()], pa.array(n, pa.int32()), *values], names)

    for k in np.flatnonzero(many >= SMALL):
        a, b = starts[k], starts[k] + many[k]
        blob = squeezed(rec[a:b], more[edge[a]:edge[b]])
        yield rows(np.array([k]), -many[k:k + 1], pa.array([blob], pa.binary()), pa.array([b""], pa.binary()))
    few = np.flatnonzero(many < SMALL)
    for c in range(0, len(few), CHUNK // SMALL):
        which = few[c:c + CHUNK // SMALL]
        n, lo = many[which], edge[starts[which]]
        size = edge[starts[which] + n] - lo
        own = np.ascontiguousarray(rec[ranges(starts[which], n)]).view(np.uint8)
        yield rows(which, n, binary(own, np.concatenate(([0], np.cumsum(n * rec.dtype.itemsize)))),
                   binary(more[ranges(lo, size)], np.concatenate(([0], np.cumsum(size)))))


def opened(rows: list[tuple], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(records, their bytes, sender) of parcels, by sender (second column); ``rows`` is emptied."""
    rows.sort(key=lambda row: row[1])
    sender = np.repeat(np.array([row[1] for row in rows], np.int64), np.array([abs(row[2]) for row in rows], np.int64))
    parts: list[tuple] = []
    few: list[tuple] = []

    def plain() -> None:
        if few:
            parts.append((np.frombuffer(b"".join([row[3] for row in few]), kind), np.frombuffer(b"".join([row[4] for row in few]), np.uint8)))
            few.clear()

    for row in rows:
        if row[2] > 0:
            few.append(row)
        else:
            plain()
            parts.append(swelled(row[3], -row[2], kind))
    plain()
    rows.clear()  # only what is unpacked is still needed
    if not parts:
        return np.zeros(0, kind), NOTHING, sender
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), sender


def heads_of(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


# --- documents in groups ------------------------------------------------------------------------

def packed(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def grouped_docs(base: DataFrame, groups: int) -> DataFrame:
    """(g, kind = 1, n = 0, rec = packed rows, more = nothing) of the rows (ROW, _ord, _text) dealt to groups by hash of id and text."""
    dealt = base.withColumn("_g", F.pmod(F.xxhash64("_ord", "_text"), F.lit(groups)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows = pa.Table.from_batches([batch]).sort_by("_g").combine_chunks()
            g = rows.column("_g").to_numpy()
            heads = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            for a, b in zip(heads.tolist(), np.append(heads[1:], len(g)).tolist()):
                some = rows.slice(a, b - a).drop_columns(["_g"]).combine_chunks().to_batches()[0]
                blob = packed(dict(zip(some.schema.names, [pa.concat_arrays([c]) for c in some.columns])))
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in (int(g[a]), 1, 0)], *[pa.array([x], pa.binary()) for x in (blob, b"")]],
                                                 ["g", "kind", "n", "rec", "more"])

    return dealt.mapInArrow(run, f"g int, kind int, {PARCEL}")


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with the same first column; rows come sorted by it."""
    lean()
    now, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != now:
                if held:
                    yield now, held
                now, held = row[0], []  # the finished run is let go before the next one grows
            held.append(row)
    if held:
        yield now, held


# --- anchors ------------------------------------------------------------------------------------

def _mix(h: np.ndarray, factor: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(factor)
    return h


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number."""
    return np.ndarray(len(data) - 7, np.uint64, data, 0, (1,)) if len(data) >= 8 else np.zeros(0, np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 26 bytes from every position of ``data`` on (len - 25 of them)."""
    x = eight_bytes(data).copy()  # aligned
    n = len(data) - GRAM + 1
    h = _mix(x[:n] * np.uint64(0x9E3779B97F4A7C15), 0xBF58476D1CE4E5B9)
    h = _mix(h ^ x[8:8 + n], 0x94D049BB133111EB)
    h = _mix(h ^ x[16:16 + n], 0xD6E8FEB86659FD93)
    h = _mix(h ^ x[18:18 + n], 0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(29))


def window_least(h: np.ndarray) -> np.ndarray:
    """The least of h[a:a + REACH] for every a."""
    least, span = h, 1
    while span * 2 <= REACH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    shift = REACH - span
    return np.minimum(least[:len(least) - shift], least[shift:]) if shift else least


def first_least(h: np.ndarray) -> np.ndarray:
    """Position of the first least of h[a:a + REACH] for every a (slow; for stretches with equal hashes close together)."""
    grid = np.lib.stride_tricks.sliding_window_view(h, REACH)
    return np.concatenate([np.argmin(grid[k:k + 8192], axis=1) + np.arange(k, min(k + 8192, len(grid))) for k in range(0, len(grid), 8192)])


def runs(h: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): runs of valid string starts with the same first least gram."""
    least = window_least(h)

    def cut(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = np.concatenate(([False], valid[:-1]))
        heads = valid & (~before | new)
        tails = valid & np.concatenate((~valid[1:] | heads[1:], [True]))
        return np.flatnonzero(heads), np.flatnonzero(tails)

    first, last = cut(np.concatenate(([True], least[1:] != least[:-1])))
    if not len(first):
        return first, first, last
    place, value = first.copy(), least[first]
    alive = np.flatnonzero(h[place] != value)
    while len(alive):
        place[alive] += 1
        alive = alive[h[place[alive]] != value[alive]]
    odd = np.flatnonzero(place < last)  # an equal hash follows where the first one has left the string
    if not len(odd):
        return place, first, last
    parts = [np.delete(np.stack([place, first, last]), odd, axis=1)]
    for x, y in zip(first[odd].tolist(), last[odd].tolist()):
        at = first_least(h[x:y + REACH])
        heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        parts.append(np.stack([at[heads] + x, heads + x, np.append(heads[1:], len(at)) - 1 + x]))
    joined = np.concatenate(parts, axis=1)
    return tuple(joined[:, np.argsort(joined[1], kind="stable")])


class Anchors:
    """Anchors of texts in a row: place, first and last string start, and hashes.

    ``key`` is the anchor gram's hash, ``seg`` one of all bytes from the first string's start to the last one's end
    (the grams at its start, anchor and end cover it).
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        parts: list[tuple] = []
        starts = len(self.data) - MATCH + 1
        valid = np.ones(max(0, starts), dtype=bool)
        for end in self.start[1:].tolist():
            valid[max(0, end - MATCH + 1):end] = False  # strings that would run over their document's end
        for c in range(0, max(0, starts), CHUNK):
            end = min(starts, c + CHUNK)
            h = gram_hashes(self.data[c:end + MATCH - 1])
            p, a, b = runs(h, valid[c:end])
            if len(p):
                doc = np.searchsorted(self.start, a + c, side="right") - 1
                parts.append((p + c, a + c, b + c, doc, h[p], h[a], h[b + REACH - 1]))
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 3
        p, a, b, doc, key, first, last = cols
        if len(p):  # one anchor cut by a chunk's end
            cut = np.concatenate(([True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])))
            heads = np.flatnonzero(cut)
            tails = np.append(heads[1:], len(p)) - 1
            p, a, b, doc, key, first, last = p[heads], a[heads], b[tails], doc[heads], key[heads], first[heads], last[tails]
        self.p, self.a, self.b, self.doc, self.key = p, a, b, doc, key
        shape = (self.p - self.a).astype(np.uint64) * np.uint64(128) + (self.b - self.a).astype(np.uint64)
        seg = _mix(first ^ _mix(shape, 0x9E3779B97F4A7C15), 0xBF58476D1CE4E5B9)
        seg = _mix(seg ^ key, 0x94D049BB133111EB)
        self.seg = _mix(seg ^ last, 0xD6E8FEB86659FD93)
        # anchors are least hashes: mixed again, they spread evenly over the buckets
        self.route = _mix(self.key, 0x9E3779B97F4A7C15) >> np.uint64(16)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, anchor) of every string of the anchors ``which``."""
        many = self.b[which] - self.a[which] + 1
        owner = np.repeat(which, many)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        return self.a[owner] + within, owner

    def string_hashes(self, at: np.ndarray, first: int = 0x9E3779B97F4A7C15, factors: tuple = (0x94D049BB133111EB, 0xD6E8FEB86659FD93)) -> np.ndarray:
        """64-bit hashes of the strings starting at ``at``, from seven (overlapping) words of eight bytes."""
        out = np.zeros(len(at), dtype=np.uint64)
        if not len(at):
            return out
        words = eight_bytes(self.data)
        for c in range(0, len(at), CHUNK):
            some = at[c:c + CHUNK]
            h = _mix(words[some] * np.uint64(first), 0xBF58476D1CE4E5B9)
            for k, factor in zip((8, 16, 24, 32, 40, MATCH - 8), factors * 3):
                h = _mix(h ^ words[some + k], factor)
            out[c:c + CHUNK] = h ^ (h >> np.uint64(29))
        return out

    def string_routes(self, at: np.ndarray) -> np.ndarray:
        """48 more bits of the strings' hashes, by other numbers."""
        return self.string_hashes(at, 0xC2B2AE3D27D4EB4F, (0x9FB21C651E98DF25, 0xA0761D6478BD642F)) >> np.uint64(16)


# --- steps 1 and 2: repeated anchors ------------------------------------------------------------

def _deal(route: np.ndarray, bits: int) -> np.ndarray:
    return (route >> np.uint64(48 - bits)).astype(np.int64) if bits else np.zeros(len(route), np.int64)


def anchor_keys(docs: DataFrame, bits: int) -> DataFrame:
    """(b, g, parcel): each group's distinct anchors by bucket, sorted, with the class of their document counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, rows in by_key(batches):
            found = [_unique_keys(t) for t in _texts(rows)]
            route = np.concatenate([f[0] for f in found])
            count = np.concatenate([f[1] for f in found])
            order = np.argsort(route, kind="stable")
            route, count = route[order], count[order]
            if not len(route):
                continue
            heads = heads_of(route)
            rec = np.empty(len(heads), KEYS)
            rec["route"] = route[heads]
            rec["kind"] = np.searchsorted(_CLASSES, np.add.reduceat(count, heads), side="right") - 1
            bucket = _deal(rec["route"], bits)
            starts = heads_of(bucket)
            yield from parcels(rec, NOTHING, starts, b=bucket[starts], g=np.full(len(starts), g))

    return docs.mapInArrow(run, f"b int, g int, {PARCEL}")


def _texts(rows: list[tuple]) -> Iterator[list[bytes]]:
    """Texts of packed rows, a few megabytes at once."""
    held, size = [], 0
    for row in rows:
        for text in unpacked(row[3]).column("_text").to_pylist():
            held.append(text)
            size += len(text)
            if size >= 4 << 20:
                yield held
                held, size = [], 0
    yield held


def _unique_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors and in how many of the texts they occur."""
    found = Anchors(texts)
    order = np.lexsort((found.doc, found.route))
    route, doc = found.route[order], found.doc[order]
    if not len(route):
        return route, np.zeros(0, np.int64)
    new = np.concatenate(([True], route[1:] != route[:-1]))
    once = new | np.concatenate(([True], doc[1:] != doc[:-1]))
    return route[new], np.add.reduceat(once.astype(np.int64), np.flatnonzero(new))


def repeated_anchors(keys: DataFrame, buckets: int) -> DataFrame:
    """(g, kind = 0, parcel): to every group its anchors that occur in other documents too, and whether they are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            rec, _, sender = opened(rows, KEYS)
            route = np.ascontiguousarray(rec["route"])
            order = np.argsort(route, kind="stable")
            heads = heads_of(route[order])
            total = np.add.reduceat(_CLASSES[rec["kind"]][order], heads)
            every = np.zeros(len(route), np.int64)
            every[order] = np.repeat(total, np.diff(np.append(heads, len(route))))
            again = np.flatnonzero(every > 1)
            out = np.empty(len(again), TOLD)
            out["route"], out["hot"] = route[again], every[again] >= HOT_DOCS
            starts = heads_of(sender[again])
            yield from parcels(out, NOTHING, starts, g=sender[again][starts], kind=np.zeros(len(starts), np.int64))

    return keys.repartition(buckets, "b").sortWithinPartitions("b").mapInArrow(run, f"g int, kind int, {PARCEL}")


class Repeated:
    """A group's repeated anchors, sorted."""

    def __init__(self, rows: list[tuple]):
        told, _, _ = opened([row for row in rows if row[1] == 0], TOLD)
        order = np.argsort(told["route"])
        self.route, self.hot = told["route"][order], told["hot"][order].astype(bool)

    def split(self, found: Anchors) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the repeated anchors: ordinary ones and hot ones."""
        if not len(self.route) or not len(found.route):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.route, found.route), len(self.route) - 1)
        again = self.route[at] == found.route
        hot = self.hot[at]
        return np.flatnonzero(again & ~hot), np.flatnonzero(again & hot)


# --- step 3: segments ---------------------------------------------------------------------------

RESULT = "_bytes long, _removed long, _sha string, _spans array<struct<start:bigint,end:bigint>>, _kept binary"


def finish(rows: pa.Table, found: Anchors, gone: np.ndarray, with_text: bool) -> list[pa.Array]:
    """Result columns of whole documents, ``gone`` marking the bytes to remove."""
    size, removed, digest, spans, kept = [], [], [], [], []
    for k in range(rows.num_rows):
        lo, hi = int(found.start[k]), int(found.start[k + 1])
        mask = gone[lo:hi]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
        left = found.data[lo:hi][~mask].tobytes() if len(edge) else found.data[lo:hi].tobytes()
        size.append(hi - lo)
        removed.append(hi - lo - len(left))
        digest.append(sha256(left).hexdigest())
        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
        kept.append(left if with_text else None)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, kinds), pa.array(kept, pa.binary())]


def segment_columns(found: Anchors, ords: np.ndarray, plain: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(route, seg, ord, first byte, end, place of the anchor) of the segments to compare."""
    at, owner = found.windows(hot)
    return (np.concatenate([found.route[plain], found.string_routes(at)]), np.concatenate([found.seg[plain], found.string_hashes(at)]),
            np.concatenate([ords[found.doc[plain]], ords[found.doc[owner]]]),
            np.concatenate([found.a[plain], at]), np.concatenate([found.b[plain], at]) + MATCH,
            np.concatenate([found.p[plain] - found.a[plain], np.zeros(len(at), np.int64)]).astype(np.uint8))


def segments(both: DataFrame, bits: int) -> DataFrame:
    """(b, g, parcel): each group's distinct segments by bucket, with the smallest id that holds them in the group."""

    def distinct(route, seg, ords) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ords, seg, route))
        r, s = route[order], seg[order]
        return order, np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])))) if len(r) else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, rows in by_key(batches):
            repeated = Repeated(rows)
            held: list[tuple] = []
            for docs in _doc_slices(rows):
                found = Anchors(docs.column("_text").to_pylist())
                plain, hot = repeated.split(found)
                cols = segment_columns(found, docs.column("_ord").to_numpy(), plain, hot)
                order, new = distinct(*cols[:3])
                route, seg, ords, lo, hi, place = (x[order[new]] for x in cols)
                held.append((route, seg, ords, place, cut_out(found.data, lo, hi)))
            route, seg, ords, place = (np.concatenate([h[k] for h in held]) for k in range(4)) if held else (np.zeros(0, np.uint64),) * 4
            if not len(route):
                continue
            order, new = distinct(route, seg, ords)
            pick = order[new]
            text = pa.concat_arrays([h[4] for h in held]).take(pa.array(pick))
            offsets = np.frombuffer(text.buffers()[1], np.int32)[:len(pick) + 1]
            rec = np.empty(len(pick), SEGMENTS)
            rec["route"], rec["seg"], rec["ord"], rec["at"], rec["size"] = route[pick], seg[pick], ords[pick], place[pick], np.diff(offsets)
            bucket = _deal(rec["route"], bits)
            starts = heads_of(bucket)
            yield from parcels(rec, np.frombuffer(text.buffers()[2], np.uint8), starts, b=bucket[starts], g=np.full(len(starts), g))

    return both.mapInArrow(run, f"b int, g int, {PARCEL}")


def cut_out(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The stretches lo:hi of ``data`` as binary values."""
    return binary(data[ranges(lo, hi - lo)], np.concatenate(([0], np.cumsum(hi - lo))))


def _doc_slices(rows: list[tuple]) -> Iterator[pa.Table]:
    """The packed documents of a group, about four megabytes of text at once."""
    held, size = [], 0
    for row in rows:
        if row[1] != 1:
            continue
        docs = unpacked(row[3])
        lengths = pc.binary_length(docs.column("_text")).to_pylist()
        start = 0
        for k, length in enumerate(lengths):
            size += length
            if size >= 4 << 20:
                yield pa.concat_tables([*held, docs.slice(start, k + 1 - start)]).combine_chunks()
                held, size, start = [], 0, k + 1
        if start < docs.num_rows:
            held.append(docs.slice(start))
    if held:
        yield pa.concat_tables(held).combine_chunks()


# --- step 4: shards -----------------------------------------------------------------------------

def string_owners(texts: list[bytes], ords: np.ndarray) -> list[np.ndarray]:
    """For every string start in each text, the smallest ord of any text holding that string.

    One suffix array over all texts; neighbours with a common prefix of MATCH bytes hold the same string.
    """
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 2
    owner = np.repeat(np.arange(len(texts)), sizes)
    joined = np.ones(len(data) + len(texts) + 1, dtype=np.int64)  # 1 parts the texts, 0 ends all
    joined[np.arange(len(data)) + owner] = data
    joined[-1] = 0
    start = np.concatenate(([0], np.cumsum(sizes + 1)))
    sa = suffix_array(joined)
    prefix = permuted_prefixes(joined, sa, MATCH)
    run = np.cumsum(prefix[sa] < MATCH)  # same number: same string
    names = np.empty(len(sa), dtype=np.int64)
    names[sa] = run
    many = sizes - MATCH + 1
    first = np.cumsum(many) - many
    at = np.repeat(start[:-1] - first, many) + np.arange(int(many.sum()))
    least = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, names[at], np.repeat(ords, many))
    return np.split(least[names[at]], np.cumsum(many)[:-1])


def shard_owners(route: np.ndarray, texts: list[bytes], ords: np.ndarray) -> list[np.ndarray]:
    """The same for many segments sorted by route; whole routes go into one suffix array."""
    out: list[np.ndarray] = []
    sizes = np.cumsum([0, *map(len, texts)])
    ends = np.append(np.flatnonzero(route[1:] != route[:-1]) + 1, len(route))
    begin = 0
    for end in ends.tolist():
        if sizes[end] - sizes[begin] >= SHARD_BYTES or end == len(route):
            out.extend(string_owners(texts[begin:end], ords[begin:end]))
            begin = end
    return out


def _reach(route: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Longest run of equal bytes each context shares with another one of its route.

    ``words`` hold a context's 24 bytes, nearest to the anchor first, as three big-endian numbers; contexts are
    sorted, and of a sorted row only neighbours need comparing.
    """
    order = np.lexsort((*words[::-1], route))
    r = route[order]
    same = r[1:] == r[:-1]
    shared = np.zeros(max(0, len(r) - 1), dtype=np.int64)
    going = same.copy()
    for w in words:
        differ = w[order][1:] ^ w[order][:-1]
        equal = np.full(len(differ), 8)
        some = np.flatnonzero(differ)
        # leading zero bytes of the difference; doubles would round, so by halves
        high = (differ[some] >> np.uint64(32)).astype(np.float64)
        low = (differ[some] & np.uint64(0xFFFFFFFF)).astype(np.float64)
        bits = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
        equal[some] = (64 - bits) // 8
        shared += np.where(going, equal, 0)
        going &= equal == 8
    shared[~same] = -1
    best = np.full(len(r), -1, dtype=np.int64)
    best[1:] = shared
    best[:-1] = np.maximum(best[:-1], shared)
    out = np.empty(len(r), dtype=np.int64)
    out[order] = best
    return out


def may_share(route: np.ndarray, text: pa.Array, place: np.ndarray) -> np.ndarray:
    """Which segments can hold a string that another segment of their route holds too.

    Seen from the anchor, a shared string needs as many equal bytes to the left and right, together, as it has beyond
    the anchor gram; the greatest such runs over all others bound both sides, so none is missed. ``place`` is
    the anchor's place in each segment.
    """
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    data = np.concatenate((np.frombuffer(text.buffers()[2], np.uint8), np.zeros(64, np.uint8)))
    size = np.diff(ends)
    reach = REACH - 1

    def words(at: np.ndarray, step: int, room: np.ndarray) -> list[np.ndarray]:
        out = []
        for k in range(0, reach, 8):
            word = np.zeros(len(at), dtype=np.uint64)
            for j in range(k, k + 8):
                byte = data[np.maximum(at + step * j, 0)]
                word = (word << np.uint64(8)) | np.where(j < room, byte, 0).astype(np.uint64)
            out.append(word)
        return out

    left_room, right_room = place, size - place - GRAM
    left = _reach(route, words(ends[:-1] + place - 1, -1, left_room))
    right = _reach(route, words(ends[:-1] + place + GRAM, 1, right_room))
    return np.minimum(left, left_room) + np.minimum(right, right_room) + GRAM >= MATCH


def check_bytes(text: pa.Array, order: np.ndarray, heads: np.ndarray) -> None:
    """Raises unless all segments of one pair of hashes (from each of ``heads`` on, in ``order``) have the same bytes."""
    many = np.diff(np.append(heads, len(order)))
    model = np.repeat(heads, many)
    others = np.flatnonzero(model != np.arange(len(order)))
    for c in range(0, len(others), 4 * CHUNK):
        some = others[c:c + 4 * CHUNK]
        if not pc.all(pc.equal(text.take(pa.array(order[some])), text.take(pa.array(order[model[some]])))).as_py():
            raise ValueError("different segments have the same 112 bits of hashes")


def resolve(shards: DataFrame, buckets: int) -> DataFrame:
    """(g, kind = 3, parcel): to every group the smallest id for each string of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            rec, more, sender = opened(rows, SEGMENTS)
            text = binary(more, edges(rec))
            route, ords = np.ascontiguousarray(rec["route"]), rec["ord"]
            order = np.lexsort((rec["seg"], route))
            r, s = route[order], rec["seg"][order]
            new = np.concatenate(([True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])))
            heads = np.flatnonzero(new)
            check_bytes(text, order, heads)
            least = np.minimum.reduceat(ords[order], heads)
            routes = r[heads]
            twin = np.flatnonzero(routes[1:] == routes[:-1])
            alone = np.ones(len(heads), dtype=bool)  # a lone segment's strings all have the segment's smallest id
            alone[twin] = alone[twin + 1] = False
            mixed = np.flatnonzero(~alone)
            if len(mixed):  # segments that can share no string with another one are as good as alone
                able = may_share(routes[mixed], text.take(pa.array(order[heads[mixed]])), rec["at"][order[heads[mixed]]].astype(np.int64))
                alone[mixed[~able]] = True
                mixed = mixed[able]
            found = shard_owners(routes[mixed], text.take(pa.array(order[heads[mixed]])).to_pylist(), least[mixed]) if len(mixed) else []
            many = np.ones(len(heads), dtype=np.int64)
            many[mixed] = [len(x) for x in found]
            offset = np.zeros(len(heads), dtype=np.int64)
            offset[mixed] = np.cumsum(many[mixed]) - many[mixed]
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            least[mixed] = flat[offset[mixed]] if len(mixed) else least[mixed]
            listed = np.where(alone, 0, many)
            place = np.empty(len(route), dtype=np.int64)
            place[order] = np.cumsum(new) - 1
            out = np.empty(len(rec), OWNERS)
            out["route"], out["seg"], out["first"], out["size"] = route, rec["seg"], least[place], 8 * listed[place]
            del rec, more, text
            told = flat[ranges(offset[place], listed[place])]
            starts = heads_of(sender)
            yield from parcels(out, told.astype("<i8").view(np.uint8), starts, g=sender[starts], kind=np.full(len(starts), 3))

    return shards.repartition(buckets, "b").sortWithinPartitions("b").mapInArrow(run, f"g int, kind int, {PARCEL}")


# --- step 5: cuts -------------------------------------------------------------------------------

class Answers:
    """The smallest ids that a group was told for its segments."""

    def __init__(self, rows: list[tuple]):
        rec, more, _ = opened(rows, OWNERS)
        order = np.argsort(rec["seg"], kind="stable")
        self.seg, self.route, self.first = (rec[f][order] for f in ("seg", "route", "first"))
        self.listed, self.offset, self.flat = rec["size"][order] > 0, edges(rec)[:-1][order] // 8, more.view("<i8")
        self.twins = bool((self.seg[1:] == self.seg[:-1]).any())

    def least(self, seg: np.ndarray, within: np.ndarray, route) -> np.ndarray:
        """The smallest id for each string, ``within`` being its place in its segment; every segment has been answered."""
        k = np.searchsorted(self.seg, seg)
        if self.twins:  # segments with equal first hashes differ in the second one
            own = route()
            other = np.flatnonzero(self.route[k] != own)
            while len(other):
                k[other] += 1
                other = other[self.route[k[other]] != own[other]]
        value = self.first[k]
        listed = self.listed[k]
        value[listed] = self.flat[self.offset[k[listed]] + within[listed]]
        return value


def cuts(both: DataFrame, row_schema: StructType, with_text: bool) -> DataFrame:
    row_type = row_schema[ROW].dataType
    schema = StructType(StructType().add(ROW, row_type).fields + StructType.fromDDL(RESULT).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            repeated = Repeated(rows)
            answers = Answers([row for row in rows if row[1] == 3])
            rows = [row for row in rows if row[1] == 1]
            for docs in _doc_slices(rows):
                found = Anchors(docs.column("_text").to_pylist())
                ords = docs.column("_ord").to_numpy()
                plain, hot = repeated.split(found)
                gone = np.zeros(len(found.data), dtype=bool)
                for at, owner, seg, within, route in _strings(found, plain, hot):
                    if not len(at):
                        continue
                    marked = at[answers.least(seg, within, route) < ords[found.doc[owner]]]
                    step = np.zeros(len(gone) + 1, dtype=np.int32)
                    np.add.at(step, marked, 1)
                    np.add.at(step, marked + MATCH, -1)
                    gone |= np.cumsum(step[:-1]) > 0
                yield pa.RecordBatch.from_arrays([docs.column(ROW).combine_chunks(), *finish(docs, found, gone, with_text)], schema.names)

    return both.mapInArrow(run, schema)


def _strings(found: Anchors, plain: np.ndarray, hot: np.ndarray) -> Iterator[tuple]:
    """(start, anchor, first hash of the segment, place in it, its second hash when asked for) of all repeated anchors' strings."""
    at, owner = found.windows(plain)
    yield at, owner, found.seg[owner], at - found.a[owner], lambda: found.route[owner]
    some, whose = found.windows(hot)
    yield some, whose, found.string_hashes(some), np.zeros(len(some), np.int64), lambda: found.string_routes(some)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                 with_text: bool = False) -> DataFrame:
    """Rows of ``docs`` (``carry`` columns, default all) plus n_bytes, n_removed, spans, kept_sha256 (and kept, if ``with_text``).

    Strings are judged on the input. spans are the maximal removed runs (byte offsets); kept holds the remaining bytes. Null
    texts are empty; texts under ``MATCH`` bytes are never touched. Ids must be integers; a null id is smaller than any other,
    and rows with the same id (or both null) do not remove from each other. Extra columns are carried, input columns
    named like the added ones are replaced; an empty table gives an empty result.
    """
    carry = docs.columns if carry is None else carry
    shape = docs.select(*[f"`{c}`" for c in carry]).schema
    base = pack(docs, carry, _ord=F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)), _text=text_of(text_col).cast("binary"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-total // GROUP_BYTES))
    bits = max(0, int(-(-total // BUCKET_BYTES) - 1).bit_length())
    buckets = 1 << bits
    by_group = grouped_docs(base, groups)
    keys = anchor_keys(by_group.repartition(groups, "g").sortWithinPartitions("g"), bits)
    again = materialize(repeated_anchors(keys, buckets), "op9-anchors", "none")
    del keys
    release(docs.sparkSession)
    told = by_group.unionByName(again)
    owners = materialize(resolve(segments(told.repartition(groups, "g").sortWithinPartitions("g", "kind"), bits), buckets), "op9-owners", "none")
    release(docs.sparkSession)
    done = cuts(told.unionByName(owners).repartition(groups, "g").sortWithinPartitions("g", "kind"), base.schema, with_text)
    added = {"n_bytes": F.col("_bytes"), "n_removed": F.col("_removed"), "spans": F.col("_spans"), "kept_sha256": F.col("_sha")}
    return unpack(done, shape, added | ({"kept": F.col("_kept")} if with_text else {}))
