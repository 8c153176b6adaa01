"""URL rules against brute force over all pairs of pages and rules."""
import random

import pytest
from pyspark.sql import functions as F

from txmon.llm.queries import URL_RULES
from txmon.llm.url_filter import SAMPLE_PER_RANGE, after, ranges_of_rule, url_verdicts
from tests.llm.conftest import CLASHES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def judge(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[:1:-1] if fits else (None, default)))


def check(spark, urls, rules, ranges=7, default="allow"):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages, table, carry=["page_id"], default=default, ranges=ranges).collect()}
    assert got == {k: judge(u, rules, default) for k, u in enumerate(urls)}


ODD_URLS = [None, "", "no scheme", "://", "http://", "http://com", "http://COM/x", "https://a.b.com:8080/p?q#f", "http://x.com?u=http://net/es/",
            "http://net#/es/", "http://u@net/es/x", "http://.com/", "http://com./", "http://ÄB.com/É", "http://example.com/en", "ftp://www.example.com/en/../x",
            "http://example.com//en/", "http://EXAMPLE.com/EN/", "http://notexample.com/en/", "a://b://net/es/", "http://\n/x", "http://x.net/es/\ny"]


def test_contract_rules_on_odd_urls(spark):
    check(spark, ODD_URLS * 3, URL_RULES, ranges=5)


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 4), (3, 13), (4, 40)])
def test_random_nested_rules(spark, seed, ranges):
    rng = random.Random(seed)
    label = lambda: rng.choice(["a", "b", "ab", "a-b", "com", "é", "\U0001F600"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/a", "/ab", "b", "é", "\uffff", "\U0010ffff"]) for _ in range(rng.randint(0, 4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(120))}.values())
    # a third of all pages on one host, another part all the same
    urls = [f"http://{host()}{path()}" for _ in range(500)] + [f"http://a.com{path()}{k % 9}" for k in range(400)] + ["http://b.a.com/a/ab"] * 300
    check(spark, urls, rules, ranges=ranges, default="block")


def test_hot_host_and_hot_url_are_spread(spark):
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.lit("http://hot.com/one")).when(
        F.col("id") % 3 == 1, F.concat(F.lit("http://hot.com/p/"), "id")).otherwise(F.concat(F.lit("http://h"), "id", F.lit(".net/"))).alias("url"))
    rules = spark.createDataFrame([("com", "/p/", "block"), ("hot.com", "/one", "block")], "host string, path string, verdict string")
    out = url_verdicts(pages, rules, ranges=12).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    assert max(sizes) < 3 * 6000 / 12 and sum(sizes) == 6000
    assert {tuple(r) for r in out.groupBy("rule", "verdict").count().collect()} == {("com/p/", "block", 2000), ("hot.com/one", "block", 2000), (None, "allow", 2000)}


def test_rule_reaches_only_ranges_it_meets():
    hot = ("com.hot.", "/p")
    splits = [("com.a.", "/")] + [("com.hot.", f"/p/{k:03}") for k in range(100)] + [("net.x.", "/")]
    assert ranges_of_rule(splits, "com.hot.", "/p/050") == [51, 52, 101]  # 101 may hold subdomains
    assert ranges_of_rule(splits, "net.", "/") == [101, 102]
    assert ranges_of_rule(splits, "org.", "/") == [102]
    assert ranges_of_rule(splits, *hot) == list(range(1, 102))
    # a rule of the domain above is needed where a range's paths may fit, not in all ranges of the hot host
    assert ranges_of_rule(splits, "com.", "/p/050") == [0, 1, 51, 52, 101]
    assert ranges_of_rule([], "com.", "/") == [0]
    assert after("a") == "b" and after("\U0010ffff") is None and after("a\U0010ffff") == "b" and after("\ud7ff") == "\ue000"


def test_ties_duplicates_nulls_and_empty_tables(spark):
    rules = [("com", "/a", "allow"), ("com", "/a", "block"), ("COM", "/b", "block"), ("x.com", "/", "allow"), ("com", "/abc", "block"), ("net", "/", None)]
    urls = ["http://com/a", "http://com/b", "http://x.com/abc", "http://net/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_verdicts(pages, table).collect()}
    assert got == {0: ("com/a", "block"), 1: ("com/b", "block"), 2: ("com/abc", "block"), 3: (None, "allow"), 4: (None, "allow")}
    # equally long texts: the longer host
    same = spark.createDataFrame([("com", "/abcd", "allow"), ("x.com", "/ab", "block")], table.schema)
    assert url_verdicts(spark.createDataFrame([(1, "http://x.com/abcd")], pages.schema), same).first().rule == "x.com/ab"
    assert url_verdicts(pages.limit(0), table).count() == 0
    none = url_verdicts(pages, table.limit(0), default="block").collect()
    assert [r.verdict for r in none] == ["block"] * 5


def test_extra_columns_and_long_urls(spark):
    long = "http://hot.com/" + "x" * 300000
    pages = spark.createDataFrame([(1, long, None), (1, long, None), (2, "http://hot.com/y", "h")], "page_id long, url string, html string")
    pages = pages.select("*", *[F.lit(f"own {c}").alias(c) for c in [*CLASHES, "host", "path", "rule", "verdict", "_key", "_range"]],
                         F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    rules = spark.createDataFrame([("hot.com", "/" + "x" * 299999, "block")], "host string, path string, verdict string")
    rows = url_verdicts(pages, rules, ranges=SAMPLE_PER_RANGE).collect()
    assert sorted((r.page_id, r.verdict, r["a.b"], r["_key"], r.m["k"]) for r in rows) == [
        (1, "block", "own a.b", "own _key", 1), (1, "block", "own a.b", "own _key", 1), (2, "allow", "own a.b", "own _key", 1)]
