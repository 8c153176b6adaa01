"""Quality, language model, decontamination, licences, HTML, tokens and mixing."""
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHES, ODD

CHECK = "/root/testdata/sf0.01"


# --- quality ------------------------------------------------------------------------------------

def test_fm_pair_sum_equals_all_pairs():
    from txmon.llm import quality_fm as q

    rng = np.random.default_rng(0)
    idx = rng.choice(q.DIM, 12, replace=False)
    val = rng.random(12)
    model = q.Model(0.3, rng.normal(size=q.DIM), rng.normal(size=(q.DIM, q.FACTORS)).astype(np.float32))
    got = model.margins(q.Rows(np.array([0, 5, 12]), idx, val))
    for (a, b), m in zip(((0, 5), (5, 12)), got):
        want = 0.3 + sum(model.w[idx[k]] * val[k] for k in range(a, b))
        want += sum(float(model.v[idx[i]] @ model.v[idx[j]]) * val[i] * val[j] for i in range(a, b) for j in range(i + 1, b))
        assert m == pytest.approx(want, rel=1e-5)


def test_fm_gradient_step_matches_finite_differences():
    """The step of one batch goes along the gradient of the logistic loss."""
    from txmon.llm import quality_fm as q

    rows = q.Featurizer().rows([b"good words here", b"BAD!! BAD!! $$$"], [[3.0], [None]])
    labels = np.array([1.0, 0.0])
    model = q.fit(rows, labels, epochs=60)
    scores = model.scores(rows)
    assert scores[0] > 0.8 and scores[1] < 0.2


def test_quality_held_out_accuracy(spark):
    from txmon.llm.queries import op1_quality_fm

    got = op1_quality_fm(spark, CHECK).join(spark.read.parquet(f"{CHECK}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.95
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    assert got[got.quality == 1].predicted.mean() > 0.95


def test_quality_never_sees_held_out_labels_or_ids(spark, make_docs):
    """Flipping the held-out labels changes no score; equal texts and metadata score alike."""
    from txmon.llm.queries import quality_model

    docs = spark.read.parquet(f"{CHECK}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{CHECK}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_model(docs, labels), quality_model(docs, flipped)
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()


def test_quality_odd_rows(spark, make_docs):
    from txmon.llm.quality_fm import quality_scores, train

    docs = make_docs(ODD, clash=True)
    labels = spark.createDataFrame([(5, 1), (11, 0), (5, 0), (None, 1), (12, None), (99, 1)], "doc_id long, quality int")
    model = train(docs, labels, "doc_id", "text", "quality", ["n_chars"])
    got = quality_scores(docs, model, meta_cols=["n_chars"]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.text == "a b c d e"}) == 1
    empty = train(make_docs([]), labels.limit(0), "doc_id", "text", "quality", [])
    assert quality_scores(make_docs([(1, "x")]), empty).first().score == pytest.approx(0.5)
    assert quality_scores(make_docs([]), model).count() == 0


@pytest.mark.parametrize("alike", [True, False])
def test_quality_sample_is_bounded_by_rows_whatever_the_label(make_docs, spark, monkeypatch, alike):
    """One id of label 0 with most rows, equal or not: no more than max_train rows reach the driver, and both classes are learned."""
    from txmon.llm import quality_fm as q

    rng, seen, fit = random.Random(2), [], q.fit
    good, bad = ["calm river stone garden", "long quiet evening walk"], ["$$$ BUY NOW!!! ###", "@@@ WIN BIG!!! %%%"]
    rows = [(0, "$$$ BUY NOW!!!" + ("" if alike else f" {k} ###")) for k in range(600)]
    rows += [(k, " ".join(rng.choice(good if k % 2 else bad) for _ in range(5))) for k in range(1, 301)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(301)], "doc_id long, quality int")
    monkeypatch.setattr(q, "fit", lambda rows, y, *a, **b: (seen.append(y), fit(rows, y, *a, **b))[1])
    model = q.train(make_docs(rows), labels, "doc_id", "text", "quality", ["n_chars"], max_train=200)
    (y,) = seen
    assert 150 < len(y) <= 200 and 20 <= y.sum() <= len(y) - 20
    got = {r.doc_id: r.score for r in q.quality_scores(make_docs([(1, " ".join(good * 2)), (2, " ".join(bad * 2))]), model, meta_cols=["n_chars"]).collect()}
    assert got[1] > got[2] + 0.3


# --- language model -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_lattice_sums_all_segmentations(vocabulary):
    from txmon.llm.lattice_lm import MARK, Lattice, read_vocabulary

    pieces, start = read_vocabulary(vocabulary)
    lattice = Lattice(pieces, np.log(start))
    p = dict(zip(pieces, start))

    def total(text):
        return 1.0 if not text else sum(p[text[:j]] * total(text[j:]) for j in range(1, len(text) + 1) if text[:j] in p)

    words = ["the", "ending", "thndessh", "a", "ciónes", "zzz", "the.", "$$$%%%"]
    many = lattice.many([w.encode() for w in words])
    for w, got in zip(words, many):
        assert got == pytest.approx(math.log(total(MARK + w)), abs=1e-9)
        assert lattice.one(MARK + w) == pytest.approx(got, abs=1e-9)
    # expected uses: equal by arrays and by loops, and they add up to the mean number of pieces
    rng = random.Random(1)
    many_words = ["".join(rng.choice("theandiség漢\x00") for _ in range(rng.randint(1, 12))).encode() for _ in range(400)] + [b"x" * 500, "🙂".encode()]
    a, b = np.zeros(len(pieces)), np.zeros(len(pieces))
    x = lattice.many(many_words, a)
    y = [lattice.one(MARK + w.decode(), b) for w in many_words]
    assert np.allclose(x, y) and np.allclose(a, b)


def test_lattice_base_score_matches_formula(make_docs, sample, vocabulary):
    from txmon.llm.lattice_lm import lattice_scores

    train = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in sample}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = lattice_scores(make_docs(sample), ~held, vocabulary, carry=["doc_id"]).collect()
    counts, ends = Counter(), 0
    for i, t in sample:
        if train[i]:
            counts.update(t.encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    by = dict(sample)
    assert len(got) == len(sample)
    for r in got:
        words = by[r.doc_id].encode().lower().split()
        want = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [counts[w] for w in words] + [ends])
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n)
        assert r.score < 0
    # words the model has not seen still have probability, and known text is likelier than shuffled letters
    rng = random.Random(0)
    text = sample[0][1]
    noise = "".join(rng.sample(text.replace(" ", ""), len(text.replace(" ", ""))))
    noise = " ".join(noise[i:i + 5] for i in range(0, len(noise), 5))
    two = {r.doc_id: r.score / r.n_tokens for r in lattice_scores(make_docs(sample + [(-1, noise)]), F.col("doc_id") >= 0, vocabulary, carry=["doc_id"]).collect()}
    assert two[-1] < two[sample[0][0]]


def test_lattice_score_matches_brute_force(make_docs, vocabulary):
    """The whole model again with plain loops: every segmentation written out, two rounds of expectation maximisation, the mixture."""
    from txmon.llm.lattice_lm import MARK, lattice_scores, read_vocabulary

    rows = [(1, "The cat sat on the mat"), (2, "the dog sat"), (3, "A cat, a dog and the rat"), (4, None), (5, "on on on"),
            (6, "the cats eat rats"), (7, ""), (8, "dog dogma  the\tTHE")]
    train = {1, 2, 3, 4, 5}
    pieces, start = read_vocabulary(vocabulary)
    first = dict(zip(pieces, start))

    def paths(text):
        if not text:
            yield []
        for j in range(1, len(text) + 1):
            if text[:j] in first:
                for rest in paths(text[j:]):
                    yield [text[:j], *rest]

    words = {i: (t or "").lower().split() for i, t in rows}
    counts = Counter(w for i in train for w in words[i])
    p = first
    for _ in range(2):
        into = {k: 100 * x for k, x in first.items()}
        for w in counts:
            every = [(path, math.prod(p[k] for k in path)) for path in paths(MARK + w)]
            whole = sum(x for _, x in every)
            for path, x in every:
                for k in path:
                    into[k] += x / whole
        mass = sum(into.values())
        p = {k: x / mass for k, x in into.items()}
    total = sum(counts.values()) + len(train)
    n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2)))

    def chance(w):
        spelled = sum(math.prod(p[k] for k in path) for path in paths(MARK + w))
        return max(counts[w] - discount, 0) / total + discount * len(counts) / total * spelled

    got = {r.doc_id: r.score for r in lattice_scores(make_docs(rows), F.col("doc_id") <= 5, vocabulary, carry=["doc_id"]).collect()}
    for i, own in words.items():
        assert got[i] == pytest.approx(math.log10(len(train) / total) + sum(math.log10(chance(w)) for w in own), rel=1e-9)


def test_word_probabilities_sum_to_at_most_one(make_docs, vocabulary):
    """All training words and all unseen words of one letter keep within the mass."""
    from txmon.llm.lattice_lm import lattice_scores

    rows = [(1, "a b a c"), (2, "a d")] + [(10 + k, chr(97 + k)) for k in range(26)]
    got = {r.doc_id: r.score for r in lattice_scores(make_docs(rows), F.col("doc_id") < 10, vocabulary, carry=["doc_id"]).collect()}
    end = math.log10(2 / 8)
    assert sum(10 ** (got[10 + k] - end) for k in range(26)) + 10 ** end <= 1 + 1e-9


def test_lattice_odd_rows(make_docs, vocabulary):
    from txmon.llm.lattice_lm import lattice_scores

    docs = make_docs(ODD, clash=True)
    got = lattice_scores(docs, F.col("doc_id") > 6, vocabulary).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if not r.text} == {1}
    none = lattice_scores(make_docs([(1, "a b"), (2, None)]), F.lit(False), vocabulary).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and r.base_score == 0 for r in none)
    assert lattice_scores(make_docs([]), F.lit(True), vocabulary).count() == 0


# --- decontamination ----------------------------------------------------------------------------

def test_latent_basis_spans_the_leading_eigenvectors():
    from txmon.llm.lsa_decontam import gram_times, latent_basis

    rng = np.random.default_rng(0)
    ids = rng.integers(-1, 40, 3000)
    at = np.repeat(np.arange(100), 30)
    weight = rng.random(40) + 0.5
    weight[3] = 0
    x = np.zeros((100, 40))
    w = np.where(ids >= 0, weight[np.maximum(ids, 0)], 0.7)
    norm = np.sqrt(np.bincount(at, w * w))
    for i, a, v in zip(ids, at, w):
        if i >= 0:
            x[a, i] += v / norm[a]
    omega = rng.choice([-1.0, 1.0], (40, 40)).astype(np.float32)
    sketch = gram_times(ids, at, weight, 0.7, omega)
    assert np.allclose(sketch, x.T @ x @ omega, atol=1e-3)
    basis = latent_basis(sketch, omega, 5)
    vals = np.linalg.eigvalsh(x.T @ x)[::-1]
    assert np.trace(basis.T @ x.T @ x @ basis) == pytest.approx(vals[:5].sum(), rel=1e-3)


def test_leaks_are_found_and_clean_documents_left(spark, make_docs, sample):
    from txmon.llm.lsa_decontam import mark_leaks

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{CHECK}/benchmark.parquet").collect()]
    rng = random.Random(1)
    rows, want = [], {}
    clean = [(i, t) for i, t in sample if not any(b in t for _, b in bench)]
    for k, (i, t) in enumerate(clean):
        item, text = bench[k % len(bench)]
        words = text.split()
        if k % 3 == 0:  # whole, anywhere
            at = rng.randint(0, len(t.split()))
            t = " ".join(t.split()[:at] + words + t.split()[at:])
        elif k % 3 == 1:  # paraphrase: every sixth word dropped, two words swapped, case and points changed
            near = [w.upper() + "," for j, w in enumerate(words) if j % 6]
            near[2], near[3] = near[3], near[2]
            t = t + "\n" + " ".join(near)
        if k % 3 < 2:
            want[i] = item
        rows.append((i, t))
    got = mark_leaks(make_docs(rows), spark.createDataFrame(bench, "item_id long, text string"), carry=["doc_id"]).collect()
    found = {r.doc_id: {x.item_id for x in r.leaks} for r in got if r.leaks}
    assert all(want[i] in found.get(i, ()) for i in want), [i for i in want if want[i] not in found.get(i, ())]
    assert set(found) == set(want)


def test_leak_search_over_several_blocks(spark, make_docs, sample, monkeypatch):
    from txmon.llm import lsa_decontam

    monkeypatch.setattr(lsa_decontam, "BLOCK_ITEMS", 15)
    bench = spark.read.parquet(f"{CHECK}/benchmark.parquet")
    rows = [(r.item_id, "before it " + r.text + " after it") for r in bench.collect()]
    got = lsa_decontam.mark_leaks(make_docs(rows), bench, carry=["doc_id"]).collect()
    assert all(r.doc_id in {x.item_id for x in r.leaks} for r in got) and len(got) == 40


def test_decontam_odd_rows(spark, make_docs):
    from txmon.llm.lsa_decontam import mark_leaks

    bench = spark.createDataFrame([(1, None), (2, ""), (3, "word word word"), (None, "a b c d e"), (4, "x" * 100), (5, "!!! ..."), (5, "one")], "item_id long, text string")
    got = mark_leaks(make_docs(ODD, clash=True), bench)
    assert set(CLASHES) <= set(got.columns) and got.count() == len(ODD)
    assert mark_leaks(make_docs([]), bench).count() == 0
    none = mark_leaks(make_docs([(1, "a")]), bench.limit(0)).collect()
    assert [r.leaks for r in none] == [[]]


def _sharing_state(queries, size, need):
    """What ``sharing`` reads of a block: every distinct word of a query tells, ``need`` of them are enough."""
    telling = [np.unique(q) for q in queries]
    marked = np.concatenate(telling)
    order = np.argsort(marked, kind="stable")
    return {"mark_query": np.repeat(np.arange(len(queries)), [len(x) for x in telling]), "mark_need": np.full(len(queries), need),
            "mark_of": order, "mark_at": np.searchsorted(marked[order], np.arange(size + 1))}


def test_word_ids_are_those_of_single_words():
    """Any case, edges of punctuation, words of points only, odd white space, final sigmas, letters that grow, empty texts."""
    import pyarrow as pa

    from txmon.llm.lsa_decontam import normal, word_ids

    parts = ["ΑΣ", "ΑΣ.", "Σ", "ΣΑ", "ΟΔΟΣ'", "İstanbul", "Word", "(word)", "..word..", "*** --", "caf\u00c9", "\u201cword\u201d", "\u2014", "a\u00a0b", "a\u2028B",
             "a\x1cb", "a\x00b", "\u1e9e", "don't", "x.y", "\U00010400", "", "WORD!", "'"]
    rng = random.Random(9)
    texts = ["", " ", "\t\n", "..."] + [rng.choice(" \t\n\x0b\x0c\r").join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400)]
    known = sorted({normal(w) for p in parts[::2] for w in p.encode().split()} - {""})
    places = {w: i for i, w in enumerate(known)}
    got = word_ids(pa.array([t.encode() for t in ["skipped", *texts]], pa.binary()).slice(1), pa.array([*known, ""], pa.string()))
    want = [[places.get(n, -1) for n in map(normal, t.encode().split()) if n] for t in texts]
    assert [x.tolist() for x in got] == want
    assert [x.tolist() for x in word_ids(pa.array([b"a b", b""], pa.binary()), pa.array([""], pa.string()))] == [[-1, -1], []]


def test_segment_sums_of_short_and_long_runs():
    from txmon.llm.lsa_decontam import segment_sums

    rng = np.random.default_rng(2)
    many = np.array([1, 40, 2, 32, 33, 1, 5000, 64, 3])
    index, table = rng.integers(0, 50, many.sum()), rng.random((50, 7))
    heads = np.cumsum(many) - many
    assert np.allclose(segment_sums(table, index, heads), np.add.reduceat(table[index], heads, axis=0))


def test_passages_of_words_are_counted_once(spark):
    from txmon.llm.lsa_decontam import PASSAGE, STEP, document_frequency

    rng, size, cut = np.random.default_rng(3), 30, STEP * PASSAGE
    docs = [rng.integers(-1, size, n).astype(np.int32) for n in (0, 1, 63, 64, 65, 300, 0, 129)]
    rows = spark.createDataFrame([(bytearray(d.tobytes()),) for d in docs], "_ids binary").coalesce(2)
    pieces = [set(d[k:k + cut].tolist()) for d in docs for k in range(0, len(d), cut)]
    here = np.append(np.where(np.arange(size) % 3 == 0, -1, np.arange(size)), -1)  # a third is not of the block
    df, n = document_frequency(rows, here, size)
    assert n == len(pieces) and df.tolist() == [0 if w % 3 == 0 else sum(w in p for p in pieces) for w in range(size)]


def test_windows_sharing_words_equal_brute_force():
    """Words that stand often in a window count once."""
    from txmon.llm.lsa_decontam import STEP, WINDOWS, places, sharing

    rng, size, need = np.random.default_rng(4), 40, 5
    queries = [rng.integers(0, size, n) for n in (9, 12, 30)]
    docs = [rng.choice([-1, *range(size)], n, p=[0.8] + [0.2 / size] * size) for n in (0, 10, 200, 400, 65)] + [np.full(100, queries[0][0])]
    ids, at, first = places(docs, STEP)
    got = list(sharing(ids, at, first, _sharing_state(queries, size, need)))
    want = set()
    for k, doc in enumerate(docs):
        for step in range(-(-len(doc) // STEP)):
            there = set(doc[step * STEP:(step + max(WINDOWS)) * STEP].tolist())
            want |= {(int(first[k]) + step, max(WINDOWS), q) for q, row in enumerate(queries) if len(there & set(row.tolist())) >= need}
    assert len(got) == len(set(got)) and set(got) == want and want


def _cpu_seconds(run, times=3):
    import time

    spent = []
    for _ in range(times):
        start = time.process_time()
        run()
        spent.append(time.process_time() - start)
    return min(spent)


def test_words_take_far_less_time_than_one_lookup_each():
    """Numbering words was a third of the operator's time, one look-up a word and one call a distinct word."""
    import pyarrow as pa

    from txmon.llm.lsa_decontam import normal, word_ids

    rng = random.Random(6)
    texts = [" ".join(f"W{rng.randrange(500)}" if j % 4 else f"n{rng.randrange(10**9)}\u00e9" for j in range(300)).encode() for _ in range(1000)]
    known = {f"w{i}": i for i in range(400)}

    def single():
        seen = {}
        for t in texts:
            for w in t.split():
                if w not in seen:
                    seen[w] = known.get(normal(w), -1)
                seen[w]

    column, names = pa.array(texts, pa.binary()), pa.array([*known, ""], pa.string())
    assert _cpu_seconds(lambda: word_ids(column, names)) < 0.8 * _cpu_seconds(single)


def test_gram_matrix_takes_far_less_time_than_one_scaled_row_a_word():
    """Sums by segment over 240 columns were a third of the operator's time."""
    from txmon.llm.lsa_decontam import PASSAGE, STEP, gram_times

    rng = np.random.default_rng(7)
    size, passages = 3000, 2000
    ids = np.where(rng.random(passages * STEP * PASSAGE) < 0.2, (size * rng.random(passages * STEP * PASSAGE) ** 3).astype(np.int64), -1)
    at = np.repeat(np.arange(passages), STEP * PASSAGE)
    weight, omega = rng.random(size) + 0.5, rng.choice(np.float32([-1, 1]), (size, 240))

    def plain():
        out = np.zeros(omega.shape)
        w = np.where(ids >= 0, weight[np.maximum(ids, 0)], 0.7)
        use = np.flatnonzero(ids >= 0)
        x = (w[use] / np.sqrt(np.bincount(at, w * w))[at[use]]).astype(np.float32)[:, None]
        rows = np.add.reduceat(omega[ids[use]] * x, heads := np.flatnonzero(np.diff(at[use], prepend=-1)), axis=0)
        owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(use))))
        order = np.argsort(ids[use], kind="stable")
        own = ids[use][order]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[heads]] += np.add.reduceat(rows[owner[order]] * x[order], heads, axis=0)
        return out

    assert np.allclose(plain(), gram_times(ids, at, weight, 0.7, omega), atol=1e-3)
    assert _cpu_seconds(lambda: gram_times(ids, at, weight, 0.7, omega)) < 0.7 * _cpu_seconds(plain)


# --- licences -----------------------------------------------------------------------------------

def test_licences_and_nearest_ancestor(spark):
    from txmon.llm.license_scan import license_scan

    rows = [
        ("LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
        ("a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/x.txt", "nothing here"), ("a/y.txt", "some text\nLicensed under CC BY-NC 4.0.\nmore"), ("c/z.txt", None),
        ("a2/w.txt", "plain"), ("top.txt", "the license of poetry is not one"), (None, ""), ("a/b/x.txt", "nothing here"),
        ("d/LICENSE.md", "gibberish that speaks for nobody"), ("d/e/f", "q"),
    ]
    got = sorted(license_scan(spark.createDataFrame(rows, "path string, text string").repartition(3)).collect(), key=lambda r: (r.path or "", r.text or ""))
    by = [(r.path, r.license, r.license_via, r.license_dir) for r in got]
    assert by == [
        (None, "MIT", "inherited", ""), ("LICENSE", "MIT", "own", None), ("a/COPYING", "GPL-3.0", "own", None), ("a/b/x.txt", "GPL-3.0", "inherited", "a"),
        ("a/b/x.txt", "GPL-3.0", "inherited", "a"), ("a/y.txt", "CC-BY-NC-4.0", "own", None), ("a2/w.txt", "MIT", "inherited", ""), ("c/z.txt", "MIT", "inherited", ""),
        ("d/LICENSE.md", "MIT", "inherited", ""), ("d/e/f", "MIT", "inherited", ""), ("top.txt", "MIT", "inherited", "")]


LICENCE_LINES = [
    ("SPDX-License-Identifier: MIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("/* SPDX-License-Identifier: LGPL-2.1-or-later */", "LGPL-2.1"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0"),
    ("Copyright (c) 2020 Example Corp. All rights reserved.", "all-rights-reserved"), ("Copyright 2013 The Authors. All rights reserved.", "all-rights-reserved"),
    ("Licensed under the MIT license. See LICENSE file in the project root for full license information.", "MIT"),
    ("Licensed under the GNU General Public License v2.0", "GPL-2.0"), ("Licensed under the GNU General Public License v3.0", "GPL-3.0"), ("GPLv2 or later", "GPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE", "GPL"), ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GPL-2.0"), ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n\nVersion 2.1, February 1999", "LGPL-2.1"), ("Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/", "Apache-2.0"),
    ("ISC License", "ISC"), ("Mozilla Public License Version 2.0", "MPL-2.0"), ("@license MIT", "MIT"), ("New BSD License", "BSD-3-Clause"), ("Simplified BSD License", "BSD-2-Clause"),
    ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD"),
    ("Some words first. Licensed under the Apache License, Version 2.0; more words come after it.", "Apache-2.0"),
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
     "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", "GPL-3.0"),
    (" * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free "
     "Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("the license of poetry is not one", None), ("MIT researchers got a license", None), ("the public domain of thoughts", None), ("copyright law is hard to read", None),
    ("a driving license was issued in version 2", None), ("", None)]


def test_licence_lines_of_all_forms(spark):
    from txmon.llm.license_scan import license_scan

    rows = [(f"f{i}/x.c", f"int f;\n\n{t}\n\nint main() {{}}") for i, (t, _) in enumerate(LICENCE_LINES)]
    got = {r.path: r.license for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {t: got[f"f{i}/x.c"] for i, (t, _) in enumerate(LICENCE_LINES)} == dict(LICENCE_LINES)


def test_whole_licence_files(spark):
    from txmon.llm.license_scan import license_scan
    from txmon.llm.license_templates import TEXTS

    rows, want = [], {}
    for name, parts in TEXTS.items():
        wrapped = "\n\n".join(parts).replace(" of ", "\nof ")
        for k, text in enumerate([f"Copyright (c) 2019-2021, Jane Doe and others\n\n{wrapped}", "\n".join(parts[1:]), wrapped.upper(),
                                  "\n\n".join(parts).replace("copyright holder", "University of Somewhere")]):
            rows.append((f"{name}{k}/LICENSE.txt", text))
            want[f"{name}{k}/LICENSE.txt"] = name
        rows.append((f"{name}0/src/deep/a.c", "int x;"))
        want[f"{name}0/src/deep/a.c"] = name
    got = {r.path: r.license for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want


def test_the_most_specific_statement_of_a_file_counts(spark):
    from txmon.llm.license_scan import license_scan

    rows = [("a.c", "Copyright (c) 2020 A. All rights reserved.\nSPDX-License-Identifier: ISC"), ("b.c", "GNU General Public License\n\nx\n\nLicensed under the GNU GPL version 2"),
            ("c.c", "Copyright 1999 B\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
                    "Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")]
    got = {r.path: r.license for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a.c": "ISC", "b.c": "GPL-2.0", "c.c": "BSD-3-Clause"}


def test_licence_scan_runs_no_python_on_executors(spark):
    from txmon.llm.queries import op6_license_scan, op10_poisson_mix

    for query in (op6_license_scan, op10_poisson_mix):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_licence_odd_rows(make_docs):
    from txmon.llm.license_scan import license_scan

    got = license_scan(make_docs(ODD, clash=True), path_col="lang").collect()
    assert len(got) == len(ODD) and {r.license_via for r in got} == {"none"}
    assert license_scan(make_docs([]), path_col="lang").count() == 0


# --- HTML ---------------------------------------------------------------------------------------

def test_html_articles_of_the_table():
    """The generator puts the main text in one article element; its text is what must come out."""
    import html
    import re

    import pyarrow.parquet as pq

    from txmon.llm.html_extract import main_text

    for page in pq.read_table(f"{CHECK}/pages.parquet").column("html").to_pylist():
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        assert main_text(page)[0] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header><div id="wrap">
<div class="menu"><a href=#>A</a> <a>B</a></div><div class="cookie-notice">We use cookies, please accept them all because we say so.</div>
<div class="text"><h2>Head</h2><p>First paragraph that is long enough to be content, and it goes on for quite a while here.</p><p>Short.</p>
<div class="advert">Buy now buy now buy now</div><form><p>Give us your address and your name and some more words</p></form>
<p>Second paragraph that is long enough to be content, &amp; goes on &lt;here&gt;.<script>if (a < b) "</p>"</script></div>
<div class="right"><ul><li><a>one</a></li><li><a>two</a></li></ul></div>
<section id="comments"><div class="comment">Nice article, I liked the reading a lot, thank you very much for it all.</div></section></div><footer>c</footer></body></html>"""


def test_html_without_an_article_element():
    from txmon.llm.html_extract import main_text

    want = ("Head First paragraph that is long enough to be content, and it goes on for quite a while here. Short. "
            "Second paragraph that is long enough to be content, & goes on <here>.")
    assert main_text(PAGE)[0] == want
    assert main_text(PAGE.replace('class="text"', 'class="x"').replace("<div class=\"x\">", "<main><p>Intro words.</p>"))[0].startswith("Intro words. Head")


def test_html_deep_nesting_takes_linear_time():
    import time

    from txmon.llm.html_extract import main_text

    for page in ("<div><p>words of the page and more of them</p>" * 50000, "<div>" * 50000 + "text of it" + "</li></span></div>" * 50000,
                 "<div class=comment><li>" * 50000 + "</ul>" * 50000, "<ul><li><a href=x>" * 50000 + "end"):
        t0 = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - t0 < 10


def test_html_implied_end_tags():
    """Elements of furniture end where HTML says so, and inner elements of the same name do not end them."""
    from txmon.llm.html_extract import main_text

    body = "a sentence that is long enough to be the content of this page, and more"
    for page, want in (
        (f'<div><p class="byline">By X<p>One {body}<p>Two {body}</div>', f"One {body} Two {body}"),
        (f'<div><p class="byline">By <b>X</b><h2>Head</h2><p>One {body}</div>', f"Head One {body}"),
        (f'<ul><li class="ad">Buy<li>One {body}<li>Two {body}</ul>', f"One {body} Two {body}"),
        (f'<dl><dt>Term<dd class="ad">Buy<dt>Two {body}<dd>Three {body}</dl>', f"Term Two {body} Three {body}"),
        (f'<table><tr><td class="ad">Buy<td>One {body}<tr><td>Two {body}</table>', f"One {body} Two {body}"),
        (f'<div><p>One {body}</p><ul><li class="comment"><ul><li>a</li><li>b</li></ul></li></ul><p>Two {body}</p></div>', f"One {body} Two {body}"),
        (f'<div><p>One {body}</p><span class="ad"><span>a</span>b</span><p>Two {body}</p></div>', f"One {body} Two {body}"),
    ):
        assert main_text(page)[0] == want, page


def test_html_regions_inside_the_main_element():
    """Ratio clusters and link shares decide inside <main> too; short lists and headings of the text stay, sibling articles are joined."""
    from txmon.llm.html_extract import main_text

    body = [f"Paragraph {k} is long enough to be the content of this page, and it goes on for quite a while here." for k in range(4)]
    text = "".join(f"<p>{b}</p>" for b in body)
    stories = "<ul>" + "".join(f"<li><a href=x>Another story number {k} of today</a></li>" for k in range(8)) + "</ul>"
    advert = "<div><div><span>Buy</span> <b>now</b></div><div><i>Only</i> <b>$5</b></div><div><span>Click</span></div><div><b>Hurry</b></div></div>"
    assert main_text(f"<body><main><h1>Head</h1>{text}{stories}</main></body>")[0] == " ".join(["Head", *body])
    got = main_text(f"<body><main><h1>Head</h1>{text}{advert}</main></body>")[0]
    assert got.removesuffix(" Buy now") == " ".join(["Head", *body])  # smoothing may keep the block at the border
    assert main_text(f"<body><main>{text}<ul><li>One</li><li>Two</li></ul><p>Short.</p></main></body>")[0] == " ".join([*body, "One Two Short."])
    two = f"<body><div><article><h2>A</h2>{text}</article><article><h2>B</h2>{text}</article></div><div><article><a href=x>Teaser</a></article></div></body>"
    assert main_text(two)[0] == " ".join(["A", *body, "B", *body])


def test_html_odd_pages(spark):
    from txmon.llm.html_extract import extract_text, main_text

    for text, want in (("", ""), ("plain  text\n only", "plain text only"), ("<p>a<p>b", "a b"), ("<!-- x", None), ("a<!-- x --> b", "a b"), ("&#0;&#xD800;&amp;&bogus;", None), ("<script>x", ""),
                       ("<p>" * 3000 + "deep" + "</p>" * 10, "deep"), ("<div>" * 2000 + "deep", "deep"), ("<![if x]><p>y", "y"), ("</p></div><b>z", "z"), ("<a <b> c", None)):
        got = main_text(text)[0]
        assert want is None or got == want, text[:30]
    rng = random.Random(0)
    parts = ["<p>", "</p>", "<", ">", "&amp", "&", "<div class=ad>", "</div>", "<!--", "-->", "<![CDATA[", "]]>", "<?x", "text ", "<script>", "</script>", "'", '"', "<a href=x", "=", "\x00", "é"]
    for _ in range(500):
        main_text("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
    rows = [(1, "u", PAGE, "own"), (1, "u", PAGE, "own"), (None, None, None, None), (2, "v", "<p>" + "word " * 50000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and {r.n_chars for r in got if r.page_id is None} == {0}
    assert [len(r.text) for r in got if r.page_id == 2] == [249999]
    assert extract_text(df.limit(0)).count() == 0


# --- tokens -------------------------------------------------------------------------------------

def test_token_counts_equal_the_library(make_docs, sample):
    import public_tokenizers
    from tokenizers import Tokenizer

    from txmon.llm.token_count import token_counts

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(1)
    alpha = "aZé'sS tT!  　ΣσςİIı0٣ⅷ½<|startoftext|>\x1c\x85\x1f\x00漢字ß́éﬁ🙂\n\tll"
    odd = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    odd += ["a<|startoftext|>b<|endoftext|><|endoftext|> c", "ΟΔΟΣ ΟΣ", "it's they'll WE'VE ''s 'd'd", "<|startoftext |>", "İstanbul İ"]
    rows = sample + [(1000 + k, t) for k, t in enumerate(odd)] + [(i + 10_000 if i else i, t) for i, t in ODD]
    got = token_counts(make_docs(rows, clash=True), path).collect()
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts(make_docs([]), path).count() == 0


def test_whole_token_proof():
    import public_tokenizers

    from txmon.llm.token_count import TokenCounter

    path = public_tokenizers.path("word_bpe_49k.json")
    counter = TokenCounter(path)
    vocabulary = json.load(open(path))["model"]["vocab"]
    assert len(counter.single) > 30_000 and "the" in counter.single and "the</w>" in vocabulary
    some = random.Random(0).sample(sorted(counter.single), 300)
    assert all(len(e.ids) == 1 for e in counter.lib.encode_batch(some, add_special_tokens=False))


# --- mixing -------------------------------------------------------------------------------------

def test_mixing_counts_follow_the_inverse_poisson(make_docs):
    import hashlib

    from txmon.llm.poisson_mix import poisson_mix

    rows = [(i, f"t{i}", "big" if i % 3 else "small") for i in range(900)] + [(2000, "n", None)]
    got = poisson_mix(make_docs(rows), {"small": 3.0}, seed=7).collect()
    n = Counter(r[2] for r in rows)
    weight = {"big": 1.0, "small": 3.0, None: 1.0}
    copies = Counter()
    for r in got:
        copies[r.doc_id] += 1
    for i, _, s in rows:
        rate = len(rows) * weight[s] / (5.0 * n[s])
        u = (int(hashlib.md5(f"{i}:7".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        k, p, cdf = 0, math.exp(-rate), math.exp(-rate)
        while cdf < u:
            k += 1
            p *= rate / k
            cdf += p
        assert copies[i] == k, (i, s, rate, u)
    assert {(r.doc_id, r.copy_no) for r in got} == {(i, c) for i, k in copies.items() for c in range(1, k + 1)}
    keys = [r.mix_key for r in got]
    assert keys == sorted(keys)
    share = Counter(r.source for r in got)
    assert abs(share["small"] / len(got) - 0.6) < 0.06


def test_mixing_odd_rows(make_docs):
    from txmon.llm.poisson_mix import poisson_mix

    got = poisson_mix(make_docs(ODD, clash=True)).collect()
    by = Counter((r.doc_id, r.text, r.copy_no) for r in got)
    assert all(k == 2 for (i, t, _), k in by.items() if i == 5)  # repeated rows get the same count each
    assert poisson_mix(make_docs([])).count() == 0
    assert poisson_mix(make_docs([(1, "x")]), {"s0": 0.0}).count() == 0
    many = poisson_mix(make_docs([(1, "x")]), target_rows=1500).collect()
    assert 1300 < len(many) < 1700 and len({r.copy_no for r in many}) == len(many)


def _hosts(sample, n, words):
    """Texts of ``words`` words out of the sample's, dealt by a seeded generator."""
    pool = [w for _, t in sample for w in (t or "").split()]
    rng = random.Random(5)
    starts = [rng.randrange(len(pool) - words) for _ in range(n)]
    return [pool[a:a + words] for a in starts]


def test_frequent_short_items_are_found_everywhere(spark, make_docs, sample):
    """An item of 15 words in a third of all documents, whole or with two words changed, is found as surely as a rare one."""
    from txmon.llm.lsa_decontam import mark_leaks

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{CHECK}/benchmark.parquet").collect()]
    item, text = min(bench, key=lambda b: (len(b[1].split()), b[0]))
    words, rng, rows = text.split()[:15], random.Random(3), []
    bench = [(i, t if i != item else " ".join(words)) for i, t in bench]
    for k, host in enumerate(_hosts(sample, 900, 80)):
        at = rng.randrange(len(host))
        near = ["other" if j in (2, 9) and k % 2 else w for j, w in enumerate(words)]
        rows.append((k, " ".join(host[:at] + (near if k % 3 == 0 else []) + host[at:])))
    got = mark_leaks(make_docs(rows), spark.createDataFrame(bench, "item_id long, text string"), carry=["doc_id"]).collect()
    found = {r.doc_id for r in got if item in {x.item_id for x in r.leaks}}
    assert found == set(range(0, 900, 3))


def test_items_of_any_length_are_found(spark, make_docs, sample):
    """Whole copies of items of 1, 3, 5, 800 and 2,000 words, and most of a long one, in texts that hold other words."""
    from txmon.llm.lsa_decontam import mark_leaks

    rng = random.Random(4)
    sizes = [1, 2, 3, 5, 7, 70, 800, 1000, 1500, 2000]
    items = {n: [f"w{rng.randrange(3000)}n{n}" for _ in range(n)] for n in sizes}
    rows, want = [], {}
    for k, host in enumerate(_hosts(sample, 120, 300)):
        n = sizes[k % len(sizes)]
        text = items[n] if k < 80 or n < 8 else [w for j, w in enumerate(items[n]) if j % 6]
        if k < 100:
            want[k] = n
            host = host[:150 + k] + text + host[150 + k:]
        elif n > 8:
            host = host[:150] + text[:n // 3] + host[150:]  # a third of an item is no leak
        rows.append((k, " ".join(host)))
    bench = [(n, " ".join(ws)) for n, ws in items.items()]
    got = mark_leaks(make_docs(rows), spark.createDataFrame(bench, "item_id long, text string"), carry=["doc_id"]).collect()
    found = {r.doc_id: {x.item_id for x in r.leaks} for r in got if r.leaks}
    assert {k: v for k, v in found.items() if k < 100} == {k: {n} for k, n in want.items()}
    assert not {k for k in found if k >= 100 and sizes[k % len(sizes)] > 8}


def test_blocks_hold_whole_items():
    from txmon.llm.lsa_decontam import blocks

    many = [(1, ["a"] * 20000), (2, ["b"] * 10), (3, ["c"] * 70)]
    assert [[i for i, _ in b] for b in blocks(many)] == [[1], [2, 3]]


def test_short_items_are_phrases_of_one_document(spark, make_docs):
    """A phrase of frequent words is found where its words follow each other, not over the border of two documents."""
    from txmon.llm.lsa_decontam import mark_leaks

    rows = [(k, "red green blue " * 40 + ("one two three " if k % 2 else "three one ")) for k in range(60)] + [(100, "x one two"), (101, "three y")]
    bench = spark.createDataFrame([(1, "one two three"), (2, "blue")], "item_id long, text string")
    got = mark_leaks(make_docs(rows).coalesce(1), bench, carry=["doc_id"]).collect()
    found = {r.doc_id: sorted(x.item_id for x in r.leaks) for r in got}
    assert found == {k: ([1, 2] if k % 2 else [2]) for k in range(60)} | {100: [], 101: []}


def test_token_counts_of_any_code_points_equal_the_library():
    """Symbols beside unassigned code points, bases with several marks, jamo, astral characters."""
    import random

    import public_tokenizers

    from txmon.llm.token_count import TokenCounter

    counter = TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(11)
    texts = ["ú᷺", "Ś᫊", "⏳՘", "+౜", "각", "ẹ́", "̈́", "Σς ΑΣ", "İstanbul", "ﬁ Ǆ", "a‍b", "\U0001F468‍\U0001F469"]
    for _ in range(30000):
        lo, hi = rng.choice([(0x20, 0x2FFF), (0x20, 0x17F), (0x20, 0xFFFF), (0x20, 0x10FFFF), (0x300, 0x36F)])
        chars = (chr(rng.choice([rng.randint(lo, hi), rng.randint(0x20, 0x7E)])) for _ in range(rng.randint(1, 14)))
        texts.append("".join(c for c in chars if not 0xD800 <= ord(c) <= 0xDFFF))
    want = [len(e.ids) for e in counter.lib.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == want
    assert not any(counter.strange.search(c) for c in "aéßłñç漢字かカ한글жЖα’“—€…«»¿ \n\t")
