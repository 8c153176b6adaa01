"""SimHash near-duplicates searched by the generalised pigeonhole principle.

1. Fingerprints: one pass over the texts, vectorised bit counting inside Arrow batches.
2. Correlated bits are grouped into partitions (64x64 covariances, summed over all fingerprints).
3. Thresholds: two fingerprints at most ``max_bits`` apart must agree within ``t_i`` bits on some
   partition i whenever sum(t_i + 1) = max_bits + 1 (t_i = -1 skips a partition). Dynamic programming picks the t_i
   with the fewest estimated candidates and probes, over several partition counts: more fingerprints lead to
   fewer, wider partitions by themselves.
4. Probe: each distinct fingerprint joins the cell of its own value on i, and the cells of greater
   values within t_i bits. Cells beyond ``block`` rows are cut into blocks, and pairs of blocks are
   separate tasks' work, so no group is unbounded.
5. Verify: full Hamming distance in every cell; a cell returns a spanning forest of its links (never
   all pairs), which has the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmon.llm.common import ROW, materialize, pack, slices, text_of, unpack
from txmon.llm.components import connected_components

BITS = 64
SEED = 42
BLOCK = 4096
#: Partition counts that the threshold allocation chooses from.
PARTITIONINGS = (2, 3, 4, 5)


# --- fingerprints -------------------------------------------------------------------------------

def fingerprint_batch(texts: list[bytes], shingle: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints; words are runs of bytes other than space and 0x09-0x0D."""
    from xxhash import xxh64_intdigest as digest

    hashes, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: only A-Z and ASCII white space
        if not words:
            continue
        line = b" ".join(words)
        n = max(1, len(words) - shingle + 1)
        if len(words) <= shingle:
            own = np.array([digest(line, SEED)], dtype=np.uint64)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
            own = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:].tolist())), np.uint64, n)
        hashes.append(own)
        sizes[i] = n
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    values = np.concatenate(hashes)
    # byte lanes of at most 255 ones: cut every text's hashes into chunks of 255
    owner_first = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    chunks = -(-sizes[full] // 255)
    owner = np.repeat(np.arange(len(full)), chunks)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = owner_first[owner] + within * 255
    text_first = np.cumsum(chunks) - chunks
    lanes = np.uint64(0x0101010101010101)
    found = np.zeros(len(full), dtype=np.uint64)
    for k in range(8):
        sums = np.add.reduceat((values >> np.uint64(k)) & lanes, first)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), text_first, axis=0)
        ones = counts * 2 > sizes[full][:, None]
        for byte in range(8):
            found |= ones[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = found
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, carry: list[str]) -> DataFrame:
    """Written table of the carried columns, id, signed fingerprint and a row number."""
    base = pack(docs, carry, _id=F.col(id_col), _text=text_of(text_col).cast("binary"))
    schema = base.drop("_text").schema.add("_fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            prints = fingerprint_batch(batch.column("_text").to_pylist(), shingle)
            kept = [batch.column(ROW), batch.column("_id"), pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(kept, [ROW, "_id", "_fp"])

    return materialize(base.mapInArrow(run, schema).withColumn("_uid", F.monotonically_increasing_id()), "op5-prints")


# --- partitions and thresholds ------------------------------------------------------------------

def bit_moments(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64x64 counts of bits set together, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = ((values[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            both += (bits.T @ bits).astype(np.float64)
            n += len(values)
        yield pa.RecordBatch.from_pydict({"i": list(range(BITS)), "n": [n] * BITS, "row": list(both)},
                                         schema=pa.schema([("i", pa.int32()), ("n", pa.int64()), ("row", pa.list_(pa.float64()))]))

    parts = distinct.select("_fp").mapInArrow(run, "i int, n long, row array<double>")
    rows = (parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(BITS)])
            .orderBy("i").collect())  # 64 rows of 64 sums, whatever the input
    both = np.array([[r[f"c{j}"] for j in range(BITS)] for r in rows]) if rows else np.zeros((BITS, BITS))
    return (int(rows[0]["n"]) if rows else 0), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy grouping: each partition starts at a free bit and takes the free bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        own = [max(sorted(free), key=lambda b: spread[b])]
        free.discard(own[0])
        while len(own) < size:
            best = max(sorted(free), key=lambda b: corr[b, own].mean())
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def distance_odds(p: np.ndarray, upto: int) -> np.ndarray:
    """P(two fingerprints differ in exactly d of these bits), d = 0..upto, bits taken as independent."""
    odds = np.zeros(upto + 1)
    odds[0] = 1
    for q in 2 * p * (1 - p):
        odds[1:] = odds[1:] * (1 - q) + odds[:-1] * q
        odds[0] *= 1 - q
    return odds


def allocate(costs: list[list[float]], max_bits: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = max_bits + 1 and the least cost; costs[i][t + 1]."""
    best = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for extra in range(min(len(own) - 1, max_bits + 1 - used) + 1):
                new = (cost + own[extra], [*ts, extra - 1])
                if used + extra not in step or new[0] < step[used + extra][0]:
                    step[used + extra] = new
        best = step
    return best[max_bits + 1]


def plan_search(n: int, both: np.ndarray, max_bits: int, probe_cost: float = 8.0) -> list[tuple[list[int], int]]:
    """(bits, threshold) of every partition probed: the cheapest plan over all partition counts.

    Cost of a threshold: estimated candidate pairs it lets through, and ``probe_cost`` for each
    signature written (a shuffled row costs about as much as comparing eight pairs).
    """
    p = np.diag(both) / max(n, 1)
    plans = []
    for parts in PARTITIONINGS:
        groups = group_bits(n, both, parts)
        costs = []
        for bits in groups:
            odds = np.cumsum(distance_odds(p[bits], max_bits))
            own = [0.0]
            for t in range(max_bits + 1):
                probes = sum(comb(len(bits), d) for d in range(1, t + 1)) / 2 + 1
                own.append(n * n / 2 * odds[t] + probe_cost * n * probes)
            costs.append(own)
        cost, ts = allocate(costs, max_bits)
        plans.append((cost, parts, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(plans)[2]


# --- probe and verify ---------------------------------------------------------------------------

def signatures(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp, own): own value, and greater values within the threshold as probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fps = batch.column(0).slice(at, 2048).to_numpy(zero_copy_only=False).astype(np.int64)
                for part, (bits, t) in enumerate(plan):
                    mask = np.uint64(sum(1 << b for b in bits)).view(np.int64)
                    values = fps & mask
                    out_v, out_f, out_o = [values], [fps], [np.ones(len(fps), dtype=bool)]
                    for d in range(1, t + 1):
                        for flips in combinations(bits, d):
                            flip = np.uint64(sum(1 << b for b in flips)).view(np.int64)
                            near = values ^ flip
                            up = near.view(np.uint64) > values.view(np.uint64)  # each pair from its smaller side only
                            out_v.append(near[up])
                            out_f.append(fps[up])
                            out_o.append(np.zeros(int(up.sum()), dtype=bool))
                    v = np.concatenate(out_v)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), part, dtype=np.int32)), pa.array(v), pa.array(np.concatenate(out_f)), pa.array(np.concatenate(out_o))],
                        ["part", "value", "fp", "own"])

    return distinct.select("_fp").mapInArrow(run, "part int, value long, fp long, own boolean")


def forest(fps: np.ndarray, own: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell (own-own and own-probe pairs) as (node, root) edges of a spanning forest."""
    n = len(fps)
    label = np.arange(n)
    rows = np.flatnonzero(own)
    for at in range(0, len(rows), 512):
        some = rows[at:at + 512]
        near = np.bitwise_count(fps[some][:, None] ^ fps[None, :]) <= max_bits
        i, j = np.nonzero(near)
        i = some[i]
        label = _merge(label, i, j)
    root = label
    linked = root != np.arange(n)
    return np.flatnonzero(linked), root[linked]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of all pairs (i, j); label[x] is the smallest member of x's class."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j = i[differ], j[differ]
        low, high = np.minimum(a[differ], b[differ]), np.maximum(a[differ], b[differ])
        np.minimum.at(label, high, low)
        while True:
            new = label[label]
            if (new == label).all():
                break
            label = new


def cell_links(cells: DataFrame, max_bits: int, keys: list[str]) -> DataFrame:
    """Forest edges of every cell; rows come sorted by cell, one bounded cell is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            key = np.stack(cols[:-2])
            cuts = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
            bounds = np.concatenate(([0], cuts, [key.shape[1]]))
            fps, own, out = cols[-2], cols[-1], []
            sizes = np.diff(bounds)
            for size in (2, 3):  # nearly all cells: pairs and triples at once
                at = bounds[:-1][sizes == size]
                for x, y in combinations(range(size), 2):
                    near = (np.bitwise_count((fps[at + x] ^ fps[at + y]).view(np.uint64)) <= max_bits) & (own[at + x] | own[at + y])
                    out.append((fps[at + x][near], fps[at + y][near]))
            for k in np.flatnonzero(sizes > 3):
                a, b = bounds[k], bounds[k + 1]
                node, root = forest(fps[a:b].view(np.uint64), own[a:b], max_bits)
                if len(node):
                    out.append((fps[a:b][node], fps[a:b][root]))
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]))], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = np.ones(len(cols[0]), dtype=bool)
            for c in cols[:-2]:
                last &= c == c[-1]
            tail = len(last) - int(last.sum())  # the open cell is contiguous at the end
            held = [c[tail:] for c in cols]
            if tail and (out := flush([c[:tail] for c in cols])) is not None:
                yield out
        if held is not None and len(held[0]) and (out := flush(held)) is not None:
            yield out

    return cells.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp", "own").mapInArrow(run, "a long, b long")


def near_links(distinct: DataFrame, max_bits: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components equal those of all links."""
    n, both = bit_moments(distinct)
    plan = plan_search(n, both, max_bits)
    signs = signatures(distinct, plan)
    sizes = materialize(
        signs.groupBy("part", "value").agg(F.count("*").alias("n"), F.count_if("own").alias("own_n"))
        .filter("own_n >= 1 AND n >= 2").select("part", "value", F.ceil(F.col("n") / F.lit(float(block))).cast("int").alias("blocks")),
        "op5-cells")
    rows = signs.join(sizes, ["part", "value"])
    spread = rows.withColumn("i", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread.select("part", "value", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp", "own")
    return cell_links(cells, max_bits, ["part", "value", "lo", "hi"])


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                       max_bits: int = 4, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (``carry`` columns, default all) plus fingerprint, component_id, stays.

    Two rows are linked when their fingerprints differ in at most ``max_bits`` bits; component_id
    is the smallest id reachable. Null and empty texts have fingerprint zero and link like any
    other; texts shorter than a shingle hash as one shingle. Null ids order after all others when the
    component's id and staying row are chosen (component_id is null only if all ids are); of repeated rows one stays.
    An empty table gives an empty result; columns named like the added ones are replaced.
    """
    carry = docs.columns if carry is None else carry
    shape = docs.select(*[f"`{c}`" for c in carry]).schema
    prints = fingerprints(docs, id_col, text_col, shingle, carry)
    distinct = materialize(
        prints.groupBy("_fp").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_uid")).alias("_first")),
        "op5-distinct")
    edges = near_links(distinct, max_bits)
    roots = materialize(connected_components(edges), "op5-roots")
    member = distinct.join(roots, distinct["_fp"] == roots["node"], "left").select(
        "_fp", "_first", F.coalesce("root", "_fp").alias("_root"))
    member = materialize(member, "op5-members")
    best = materialize(member.groupBy("_root").agg(F.min("_first").alias("_best")), "op5-best")
    lookup = materialize(member.join(best, "_root").select("_fp", "_best"), "op5-lookup")
    out = prints.join(lookup, "_fp")
    return unpack(out, shape, {
        "fingerprint": F.lower(F.lpad(F.hex("_fp"), 16, "0")),
        "component_id": F.col("_best._id"),
        "stays": F.col("_uid") == F.col("_best._uid"),
    })
