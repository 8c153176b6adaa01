"""Runs in word sequences against brute force."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.conftest import ODD
from txmon.llm.queries import op12_run_finder
from txmon.llm.run_finder import COVER, COVER_PERIOD, SHIFTS, Extensions, collapse, find_runs, grid, runs_of

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(words, min_length=6, min_exponent=4):
    """(start, length, period): for every period the maximal stretches, of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(min_length, min_exponent * q):
                found.setdefault((s, length), q)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(words, runs):
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    return [w for i, w in enumerate(words) if i not in dropped]


def shaped(rng, most):
    n, letters = rng.randint(0, most), rng.choice([1, 2, 3, 8])
    words = [rng.randint(1, letters) for _ in range(n)]
    if n > 5 and rng.random() < 0.6:  # a planted repeat, sometimes with one fault
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if rng.random() < 0.4:
            words[rng.randrange(n)] = 9
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(250):
        words = shaped(rng, 150)
        for least, exponent in ((6, 4), (2, 2), (1, 3)):
            got = [tuple(r) for r in runs_of(np.array(words, dtype=np.uint32), least, exponent).tolist()]
            assert got == brute(words, max(least, 1), exponent), (words, least, exponent)
        runs = runs_of(np.array(words, dtype=np.uint32))
        assert [words[i] for i in np.flatnonzero(collapse(len(words), runs))] == kept_words(words, runs.tolist())


def test_cover_and_extensions():
    assert len({(a - b) % COVER_PERIOD for a in COVER for b in COVER}) == COVER_PERIOD and SHIFTS.max() < COVER_PERIOD
    rng = random.Random(5)
    for _ in range(60):
        words = np.array(shaped(rng, 700), dtype=np.uint32)
        n = len(words)
        if n < 2:
            continue
        i, j = np.array([[rng.randint(0, n), rng.randint(0, n)] for _ in range(300)]).T
        i, j = i[i != j], j[i != j]
        e = Extensions(words)
        expect = []
        for a, b in zip(i.tolist(), j.tolist()):
            k = 0
            while max(a, b) + k < n and words[a + k] == words[b + k]:
                k += 1
            expect.append(k)
        assert e.extend(i, j).tolist() == expect
        if e.rank is not None:  # sorted are the sampled suffixes, all of them and no others
            at = np.flatnonzero(e.rank[:n] > 0)
            assert set((at % COVER_PERIOD).tolist()) <= set(COVER) and len(e.table[0]) < n * len(COVER) / COVER_PERIOD + len(COVER)


def test_grid_is_harmonic():
    for n in (40, 5000):
        points = sum(len(i) for i, _ in grid(n, 6, 4))
        assert points <= n * (1 + np.log(n)) / 3 + 2 * n


def test_long_periodic_text_is_quick():
    import time

    words = np.random.default_rng(3).integers(1, 5000, 300_000).astype(np.uint32)
    for p in (1, 7, 40_000):
        t0 = time.perf_counter()
        again = np.concatenate((words[:50], words[50 + (np.arange(len(words) - 50) % p)]))
        runs = runs_of(again).tolist()
        assert [50, len(words) - 50, p] in runs and time.perf_counter() - t0 < 20


def test_odd_documents(make_docs):
    rows = [*ODD, (20, "a b " * 9 + "c"), (21, "x  x\tx\nx\rx\x0bx\x0cx"), (22, "é\u00a0é é\u00a0é " * 8), (23, "a\u2003a a\u2003a b")]
    out = {}
    for r in find_runs(make_docs(rows, clash=True)).collect():
        out.setdefault((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed, r["a.b"]), []).append(1)
    expect = {}
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        runs = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        expect.setdefault((doc_id, len(words), tuple(runs), " ".join(kept_words(words, runs)), "own a.b"), []).append(1)
    assert out == expect
    assert find_runs(make_docs([(1, "x")]).limit(0)).count() == 0


def test_query_against_brute_force(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expect, planted = {}, 0
    for r in rows:
        words = WORD.findall(r["text"] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        expect[r["doc_id"]] = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                               hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept_words(words, runs)).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in op12_run_finder(spark, "/root/testdata/sf0.001").select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert got == expect and planted > 5 and sum(v[0] > 0 for v in got.values()) > 5
