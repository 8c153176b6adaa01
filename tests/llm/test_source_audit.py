"""Source audit against brute force, with small tiles and blocks, and exact arithmetic on large counts."""
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHES, ODD
from txmon.llm import source_audit as sa

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, weight, ranks):
    occurs, holds, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        langs[lang].add(source)
        occurs[lang, source].update(terms)
        holds[lang].update(set(terms))
    out = set()
    for lang, sources in langs.items():
        kept = sorted(t for t, n in holds[lang].items() if n >= min_docs)
        whole = sum((occurs[lang, s] for s in sources), Counter())

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + weight) // (total + weight * len(kept)) for t in kept}

        p, q = {s: share(occurs[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if occurs[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms[:ranks])}
    return out


def invented(seed, n):
    rng = random.Random(seed)
    words = [rng.choice("abcéßÄZ漢") + rng.choice(["", "x", "Y", "ﬁ"]) + str(k) * (k % 7 == 0) + rng.choice("qrstuv") for k in range(60)]
    rows = []
    for _ in range(n):
        source = f"s{rng.choice([0, 0, 0, 1, 2, 3, 4, 5])}"
        pool = words[int(source[1]):40] if rng.random() < 0.5 else words
        rows.append((" ".join(rng.choice(pool) for _ in range(rng.randint(0, 20))), rng.choice(["en", "en", "de"]), source))
    return rows


@pytest.mark.parametrize("seed,tile,block,held", [(1, 512, 2048, 400_000), (2, 2, 5, 10), (3, 1, 1, 3)])
def test_against_brute_force(spark, monkeypatch, seed, tile, block, held):
    monkeypatch.setattr(sa, "TILE", tile)
    monkeypatch.setattr(sa, "BLOCK_TERMS", block)
    monkeypatch.setattr(sa, "HELD", held)
    rows = [*invented(seed, 300), (None, "en", None), ("A1b b", None, "s0"), ("", "fr", "s1"), ("lone", "xx", "s1"), ("b " * 5, "fr", "s2")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    docs = docs.select("*", *[F.lit("own").alias(c) for c in [*CLASHES, "term", "n", "docs", "item", "rank"]])
    got = [tuple(r) for r in sa.source_audit(docs, min_docs=8, ranks=7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 8, 5, 7)


def test_ties_fill_ranks_in_byte_order(spark):
    terms = ["b", "é", "z", "ab", "漢", "\U0001F600x", "aa"]
    rows = [(" ".join(terms), "en", "s0")] * 3 + [("other " * 9, "en", "s1")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sa.source_audit(docs, min_docs=2, ranks=4).filter("part = 'term' AND source = 's0'").orderBy("rank").collect()
    assert [(r.rank, r.item) for r in got] == [(1, "aa"), (2, "ab"), (3, "b"), (4, "z")] and len({r.value for r in got}) == 1
    assert {tuple(r) for r in sa.source_audit(docs, min_docs=2, ranks=4).collect()} == brute(rows, 2, 5, 4)


def test_odd_rows_and_empty_tables(spark, make_docs):
    rows = [(r[1], "en", "s0") for r in ODD] + [("word a b", "en", "s1")] * 2
    docs = make_docs([*ODD, (50, "word a b", "s1"), (50, "word a b", "s1")], clash=True)
    assert {tuple(r) for r in sa.source_audit(docs, min_docs=2).collect()} == brute(rows, 2, 5, 50)
    assert {tuple(r) for r in sa.source_audit(docs, min_docs=99).collect()} == brute(rows, 99, 5, 50)  # no kept term: values 0
    assert sa.source_audit(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_doubles(spark):
    n, total, terms = 9_007_199_254_740_993, 9_007_199_254_999_999_7, 12_345_678
    row = spark.range(1).select(sa.smoothed(F.lit(n), F.lit(total), F.lit(terms), 5).alias("p"), sa.smoothed(F.lit(0), F.lit(total), F.lit(terms), 5).alias("z")).first()
    assert row.p == 1 + 10 ** 9 * (n + 5) // (total + 5 * terms) and row.z == 1
