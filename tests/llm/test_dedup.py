"""Exact and near de-duplication and byte-level removal against brute force."""
import hashlib
import random

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import CLASHES, ODD


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# --- exact dedup --------------------------------------------------------------------------------

def test_exact_dedup_matches_brute_force(make_docs, sample):
    from txmon.llm.exact_dedup import exact_dedup

    rows = sample + [(i + 10_000, t) for i, t in sample[::3]] + [(i + 20_000, t + " ") for i, t in sample[::5]]
    got = {r.doc_id: r for r in exact_dedup(make_docs(rows), carry=["doc_id"]).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(groups[t]), len(groups[t]), i == max(groups[t]))
        assert r.full_hash in (None, sha(t.encode())) and (r.full_hash is not None or len(groups[t]) == 1)


def test_exact_dedup_same_prefix_and_length_differ_later(make_docs):
    from txmon.llm.exact_dedup import exact_dedup

    got = exact_dedup(make_docs([(1, "p" * 300 + "a"), (2, "p" * 300 + "b"), (3, "p" * 300 + "a")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [(1, 3, False), (2, 2, True), (3, 3, True)]


def test_exact_dedup_odd_rows(make_docs):
    from txmon.llm.exact_dedup import exact_dedup

    got = exact_dedup(make_docs(ODD, clash=True))
    assert set(CLASHES) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if not r.text]
    assert {r.keep_id for r in empty} == {8} and [r.doc_id for r in empty if r.kept] == [8] and {r.group_size for r in empty} == {4}
    tied = [r for r in rows if r.text == "a b c d e"]
    assert {r.group_size for r in tied} == {4} and [r.doc_id for r in tied if r.kept] == [9]
    twice = exact_dedup(make_docs([(5, "t"), (5, "t"), (None, "u"), (None, "u")])).collect()
    assert sum(r.kept for r in twice if r.text == "t") == 1 and sum(r.kept for r in twice if r.text == "u") == 1
    assert exact_dedup(make_docs([])).count() == 0


# --- simhash ------------------------------------------------------------------------------------

def fingerprint(text: str) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(prints: dict[int, int], max_bits: int) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin(prints[i] ^ prints[j]).count("1") <= max_bits and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(make_docs, sample):
    from txmon.llm.simhash import simhash_components

    rng = random.Random(2)
    rows = list(sample)
    for i, t in sample[::2]:  # near copies: a word changed, some words dropped
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((i + 1000, " ".join(words)))
        rows.append((i + 2000, " ".join(words[2:])))
    got = simhash_components(make_docs(rows), carry=["doc_id"]).collect()
    prints = {i: fingerprint(t) for i, t in rows}
    want = components(prints, 4)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(rows) - 50
    assert sorted(r.doc_id for r in got if r.stays) == sorted(set(want.values()))


def test_simhash_odd_rows(make_docs):
    from txmon.llm.simhash import simhash_components

    out = simhash_components(make_docs(ODD, clash=True)).collect()
    assert len(out) == len(ODD)
    blank = [r for r in out if not (r.text or "").split()] + [r for r in out if r.text and not r.text.encode().split()]
    assert {r.fingerprint for r in out if r.text in (None, "")} == {"0" * 16} and blank
    tied = [r for r in out if r.text == "a b c d e"]
    assert {r.component_id for r in tied} == {5} and sum(r.stays for r in tied) == 1
    assert simhash_components(make_docs([])).count() == 0
    nulls = simhash_components(make_docs([(None, "x"), (None, "x")])).collect()
    assert [r.component_id for r in nulls] == [None, None] and sum(r.stays for r in nulls) == 1


@pytest.mark.parametrize("block", [4, 4096])
def test_simhash_links_in_blocks_have_the_same_components(spark, block):
    """A dense cluster of fingerprints: cells are cut into blocks and no link is lost."""
    from txmon.llm.components import connected_components
    from txmon.llm.simhash import near_links

    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 62, 3)
    values = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centre for _ in range(60)}
    values |= {int(v) for v in rng.integers(0, 1 << 62, 200)}
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "_fp long")
    roots = {r.node: r.root for r in connected_components(near_links(df, 4, block)).collect()}
    got = {v: roots.get(s, s) for v, s in zip(values, signed)}
    want = components({v: v for v in values}, 4)
    classes = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert classes(got) == classes(want)


def test_thresholds_keep_the_pigeonhole_promise():
    from txmon.llm.simhash import BITS, allocate, group_bits, plan_search

    rng = np.random.default_rng(1)
    bits = rng.random((500, BITS)) < 0.5
    bits[:, 1] = bits[:, 0]  # fully correlated: one partition
    both = bits.T.astype(float) @ bits
    groups = group_bits(500, both, 4)
    assert sorted(b for g in groups for b in g) == list(range(BITS))
    assert any({0, 1} <= set(g) for g in groups)
    for n in (10, 10**5, 10**8, 10**10):
        plan = plan_search(n, both * (n / 500), 4)
        assert sum(t + 1 for _, t in plan) == 5
    assert len(plan_search(10**10, both * (10**10 / 500), 4)) <= len(plan_search(10**5, both * 200, 4))
    assert allocate([[0, 1, 10, 100], [0, 2, 3, 50]], 2) == (4, [0, 1])


# --- connected components -----------------------------------------------------------------------

def test_components_of_a_chain_and_a_star(spark):
    from txmon.llm.components import connected_components

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(200, 260)] + [(3, 3), (9, 8), (8, 9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[j] for j in range(200, 260)} == {7} and got[9] == 8
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- suffix array and byte removal --------------------------------------------------------------

def test_suffix_array_and_prefixes_match_brute_force():
    from txmon.llm.suffix_array import permuted_prefixes, suffix_array

    rng = np.random.default_rng(0)
    for _ in range(150):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)), 0)
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        prefix = permuted_prefixes(s, sa, 5)
        for i, j in zip(sa[1:], sa[:-1]):
            n = next((k for k in range(5) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), 5)
            assert prefix[i] == n


def brute_removal(rows, match=50):
    first = {}
    for i, t in rows:
        for k in range(len(t) - match + 1):
            w = t[k:k + match]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - match + 1):
            if first[t[k:k + match]] < i:
                gone[k:k + match] = b"\1" * match
        spans = [(k, next((e for e in range(k, len(t)) if not gone[e]), len(t))) for k in range(len(t)) if gone[k] and not (k and gone[k - 1])]
        out.append((i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))))
    return sorted(out)


def removal(df, **kw):
    from txmon.llm.suffix_dedup import suffix_dedup

    rows = suffix_dedup(df, carry=["doc_id"], **kw).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], r.kept_sha256) for r in rows)


def test_suffix_dedup_matches_brute_force_on_documents(make_docs, sample):
    assert removal(make_docs(sample)) == brute_removal([(i, t.encode()) for i, t in sample])


@pytest.mark.parametrize("hot,size", [(256, 12 << 20), (3, 4000)])
def test_suffix_dedup_on_overlaps_and_periodic_text(make_docs, monkeypatch, hot, size):
    """Many groups and buckets, hot anchors, periodic bytes and repeated ids."""
    from txmon.llm import suffix_dedup as module

    monkeypatch.setattr(module, "HOT_DOCS", hot)
    monkeypatch.setattr(module, "GROUP_BYTES", size)
    monkeypatch.setattr(module, "BUCKET_BYTES", size)
    rng = random.Random(3)
    base = "".join(rng.choice("abc ") for _ in range(400))
    rows = []
    for _ in range(150):
        text = ""
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 390)
            text += base[a:a + rng.randint(1, 120)] + rng.choice(["", "x" * rng.randint(0, 130), "ab" * rng.randint(0, 60)])
        rows.append((rng.randint(0, 120), text))
    assert removal(make_docs(rows)) == brute_removal([(i, t.encode()) for i, t in rows])


def test_suffix_dedup_odd_rows(make_docs):
    from txmon.llm.suffix_dedup import suffix_dedup

    got = suffix_dedup(make_docs(ODD + [(3, "word " * 60000), (None, "word " * 100)], clash=True), with_text=True).collect()
    assert len(got) == len(ODD) + 2
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[12].n_removed == 0 and by_id[3].n_removed == by_id[11].n_removed == 300000  # the null id is smaller
    assert by_id[3].kept == b"" and [(s.start, s.end) for s in by_id[3].spans] == [(0, 300000)]
    assert by_id[7].n_bytes == 0 and by_id[7].kept_sha256 == sha(b"")
    assert suffix_dedup(make_docs([])).count() == 0


def test_parcels_round_trip_and_stay_small():
    """Few records travel as they are, many compressed; a parcel of one record is not much larger than the record."""
    from txmon.llm.suffix_dedup import KEYS, NOTHING, SEGMENTS, SMALL, opened, parcels

    rng = np.random.default_rng(1)
    counts = [1, 3, SMALL - 1, SMALL, 5 * SMALL, 1, 2000, 2] + [1] * 3000
    n = sum(counts)
    rec = np.zeros(n, SEGMENTS)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    rec["route"] = np.sort(rng.integers(0, 1 << 48, n, dtype=np.uint64))
    rec["seg"], rec["ord"], rec["at"], rec["size"] = rng.integers(0, 1 << 62, n), rng.integers(-5, 5, n), rng.integers(0, 25, n), rng.integers(0, 75, n)
    more = rng.integers(0, 256, int(rec["size"].sum()), dtype=np.uint8)
    batches = list(parcels(rec, more, starts, b=np.zeros(len(counts), np.int64), g=np.arange(len(counts))))
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert all((r[2] < 0) == (abs(r[2]) >= SMALL) for r in rows) and len(rows) == len(counts)
    single = [len(r[3]) + len(r[4]) for r in rows if r[2] == 1]
    assert max(single) <= SEGMENTS.itemsize + 74
    random.Random(1).shuffle(rows)
    got, data, sender = opened(rows, SEGMENTS)
    assert (got == rec).all() and (data == more).all() and rows == []
    assert (sender == np.repeat(np.arange(len(counts)), counts)).all()
    # bytes a key hardly depend on how many parcels they are cut into
    keys = np.zeros(4096, KEYS)
    keys["route"] = np.sort(rng.integers(0, 1 << 48, 4096, dtype=np.uint64))
    sizes = []
    for step in (1, 8, 4096):
        cut = np.arange(0, 4096, step)
        sizes.append(sum(len(x) for b in parcels(keys, NOTHING, cut, b=cut, g=cut) for x in b.column("rec").to_pylist()))
    assert max(sizes) < 2 * min(sizes)
    assert len(opened([], KEYS)[0]) == 0 and not list(parcels(np.zeros(0, KEYS), NOTHING, np.zeros(0, np.int64), g=np.zeros(0, np.int64)))


def test_equal_first_hashes_are_told_apart():
    """Two segments of a group with one first hash get their own answers; equal hashes of different bytes raise."""
    import pyarrow as pa

    from txmon.llm.suffix_dedup import OWNERS, Answers, check_bytes, parcels

    rec = np.array([(5, 7, 100, 0), (6, 7, 200, 16), (9, 8, 300, 0)], OWNERS)
    rows = [tuple(r.values()) for b in parcels(rec, np.array([1, 2], "<i8").view(np.uint8), np.array([0]), g=np.array([0]), kind=np.array([3])) for r in b.to_pylist()]
    got = Answers(rows).least(np.array([7, 7, 7, 8], np.uint64), np.array([0, 0, 1, 4]), lambda: np.array([5, 6, 6, 9], np.uint64))
    assert got.tolist() == [100, 1, 2, 300]
    text = pa.array([b"a", b"b", b"a"], pa.binary())
    check_bytes(text, np.array([0, 2, 1]), np.array([0, 2]))
    with pytest.raises(ValueError):
        check_bytes(text, np.array([0, 1, 2]), np.array([0, 2]))


def test_string_owners_match_brute_force():
    from txmon.llm.suffix_dedup import MATCH, shard_owners

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(4)) * rng.randint(13, 20) for _ in range(30)]
    texts = [t.encode() for t in texts]
    ords = np.array([rng.randint(0, 50) for _ in texts])
    got = shard_owners(np.zeros(len(texts), np.uint64), texts, ords)
    for k, t in enumerate(texts):
        for a in range(len(t) - MATCH + 1):
            assert got[k][a] == min(o for o, u in zip(ords, texts) if t[a:a + MATCH] in u)


def test_segments_that_share_a_string_are_never_left_out():
    """The bound on shared context may let too much through, never too little."""
    import pyarrow as pa

    from txmon.llm.suffix_dedup import GRAM, MATCH, REACH, may_share

    rng = random.Random(6)
    routes, texts, places, spared = [], [], [], 0
    for route in range(60):
        gram = bytes(rng.choice(b"xyz") for _ in range(GRAM))
        near = [bytes(rng.choice(b"ab") for _ in range(REACH - 1)) for _ in range(2)]
        for _ in range(rng.randint(2, 6)):
            left, right = bytearray(rng.choice(near)), bytearray(rng.choice(near))
            for side in (left, right):
                if rng.random() < 0.7:
                    side[rng.randrange(len(side))] ^= 3
            before = rng.randint(0, REACH - 1)
            after = rng.randint(REACH - 1 - before, REACH - 1)
            routes.append(route)
            texts.append(bytes(left[len(left) - before:]) + gram + bytes(right[:after]))
            places.append(before)
    got = may_share(np.array(routes, np.uint64), pa.array(texts, pa.binary()), np.array(places))
    windows = [{t[a:a + MATCH] for a in range(len(t) - MATCH + 1)} for t in texts]
    for k, (r, w) in enumerate(zip(routes, windows)):
        shares = any(routes[j] == r and j != k and texts[j] != texts[k] and w & windows[j] for j in range(len(texts)))
        assert got[k] or not shares
        spared += not got[k]
    assert spared > 20


def test_released_steps_leave_no_shuffle_files(spark):
    from txmon.llm.common import materialize, release

    materialize(spark.range(1000).repartition(5, "id"), "release")
    release(spark)


def test_added_columns_replace_own_ones_in_any_case(spark, make_docs):
    from pyspark.sql import functions as F

    from txmon.llm.exact_dedup import exact_dedup
    from txmon.llm.simhash import simhash_components
    from txmon.llm.token_count import token_counts

    import public_tokenizers

    docs = make_docs([(1, "a b"), (2, "a b")]).select("*", *[F.lit("own").alias(c) for c in ("Kept", "KEEP_ID", "Stays", "N_Tokens", "Fingerprint")])
    for found, added in ((exact_dedup(docs), ["keep_id", "kept"]), (simhash_components(docs), ["fingerprint", "stays"]),
                         (token_counts(docs, public_tokenizers.path("word_bpe_49k.json")), ["n_tokens"])):
        names = [c.lower() for c in found.columns]
        assert len(names) == len(set(names)) and set(added) <= set(found.columns)
        assert found.select(*added).count() == 2
