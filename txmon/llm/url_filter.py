"""URL filter rules applied to pages by a sort-merge range join.

A host becomes a canonical key: its labels in reverse, each closed by a dot (``www.a.com`` -> ``com.a.www.``).
A rule's host is a prefix of the keys of that host and all its subdomains, so it covers one interval of keys,
and any two intervals are nested or disjoint; the same holds for path prefixes below one host. Pages and rules
are dealt to the same key ranges (a rule to every range its interval meets) and sorted by key, rules before the
pages they may cover; one sweep over a range keeps the stack of rule hosts that are open at the current key.

Ranges are cut at split points from a bounded sample of keys (``SAMPLE_PER_RANGE`` a range, ``SPLIT_CHARS`` of each
host and path), which decides the balance and nothing else. A key that holds many rows is a run of equal split
points and its rows are spread over the run by a hash of the row. The rows that cross the shuffle are the carried columns,
host and path; page bodies do not move unless they are carried.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txmon.llm.common import ROW, lean, pack, unpack

#: Keys sampled for each range when the split points are chosen, and how much of a long host or path they keep.
SAMPLE_PER_RANGE = 20
SPLIT_CHARS = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Key = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased, port and user kept), path up to query or fragment; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def after(prefix: str) -> str | None:
    """The smallest text above all texts that start with ``prefix``; None if there is none."""
    while prefix:
        code = ord(prefix[-1]) + 1
        if code <= 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if 0xD800 <= code <= 0xDFFF else code)
        prefix = prefix[:-1]
    return None


def ranges_of_rule(splits: list[Key], host: str, path: str) -> list[int]:
    """Ranges that may hold a page under the rule (host key, path prefix); range i lies between splits i-1 and i."""
    end = after(path)
    below = after(host)
    lo = bisect_left(splits, (host, path))
    hi = bisect_left(splits, (host, end) if end is not None else (host + "\x00", ""))
    found = set(range(lo, hi + 1))
    # subdomains: keys longer than the rule's; a range that lies inside one host is met only where its paths are
    lo, hi = bisect_left(splits, (host + "\x00", "")), bisect_left(splits, (below, "")) if below else len(splits)
    for i in range(lo, hi + 1):
        if 0 < i < len(splits) and splits[i - 1][0] == splits[i][0]:
            if splits[i][1] < path or (end is not None and splits[i - 1][1] >= end):
                continue
        found.add(i)
    return sorted(found)


class Level(NamedTuple):
    """The open rules of one host: paths ascending, each with the nearest path that encloses it."""

    key: str
    paths: list[str]
    parents: list[int]
    rules: list[str]
    verdicts: list[str]

    def add(self, path: str, rule: str, verdict: str) -> None:
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.parents[at]
        self.parents.append(at)
        self.paths.append(path)
        self.rules.append(rule)
        self.verdicts.append(verdict)

    def find(self, path: str) -> int:
        """The longest rule path that ``path`` starts with, or -1: the predecessor or one that encloses it."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.parents[at]
        return at


def sweep(batches: Iterable[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order of (range, key, rules first, path): pages leave with rule and verdict."""
    lean()
    stack: list[Level] = []
    here = None
    for batch in batches:
        keys, paths = batch.column("_key").to_pylist(), batch.column("_path").to_pylist()
        rules, verdicts = batch.column("_rule").to_pylist(), batch.column("_verdict").to_pylist()
        kinds, ranges = batch.column("_kind").to_pylist(), batch.column("_range").to_pylist()
        pages, out_rule, out_verdict = [], [], []
        for n, key in enumerate(keys):
            if ranges[n] != here:
                here, stack = ranges[n], []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            path = paths[n]
            if kinds[n] == 0:
                if not stack or stack[-1].key != key:
                    stack.append(Level(key, [], [], [], []))
                stack[-1].add(path, rules[n], verdicts[n])
                continue
            rule, verdict = None, default
            for level in stack:
                at = level.find(path)
                if at >= 0 and (rule is None or len(level.rules[at]) >= len(rule)):
                    rule, verdict = level.rules[at], level.verdicts[at]
            pages.append(n)
            out_rule.append(rule)
            out_verdict.append(verdict)
        if pages:
            kept = batch.select([ROW, "_host", "_path"]).take(pa.array(pages, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(out_rule, pa.string()), pa.array(out_verdict, pa.string())],
                names=[ROW, "_host", "_path", "_rule", "_verdict"])


def split_points(points: DataFrame, ranges: int) -> list[Key]:
    """At most ``ranges - 1`` ascending (key, path) cuts from a bounded sample; equal cuts mark a key with many rows."""
    rows = points.count()
    if not rows:
        return []
    share = min(1.0, ranges * SAMPLE_PER_RANGE / rows)
    cut = [F.substring(c, 1, SPLIT_CHARS) for c in ("_key", "_path")]
    sample = sorted((r[0], r[1]) for r in points.sample(share, seed=11).select(*cut).collect())
    return [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []


def url_verdicts(pages: DataFrame, rules: DataFrame, url_col: str = "url", carry: list[str] | None = None,
                 default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Carried columns (all by default) plus host, path, rule and verdict of every page.

    ``rules`` has text columns host, path and verdict. A rule fits its host and all subdomains of it where the url's path
    starts with the rule's path. Of the rules that fit, the one with the longest text ``host + path`` (code points)
    wins, among equally long ones that of the longer host; of equal rules with different verdicts the alphabetically last (block).
    Without a rule the verdict is ``default`` and rule is null.

    A null url, or one without ``://``, has empty host and path; so has a page no label, and only a rule with empty
    host fits it. Rows with null host or path in ``rules`` count as empty texts; with null verdict they are ignored. Repeated
    rows are judged one by one, an empty table of pages gives no rows, an empty table of rules gives ``default`` everywhere.
    Input columns named like the four added ones are replaced.
    """
    spark = pages.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shape = pages.schema
    kept = carry if carry is not None else pages.columns
    plain = [c for c in kept if not isinstance(shape[c].dataType, (T.MapType, T.VariantType))]
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    points = pack(pages, kept, _host=host, _path=path, _salt=F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in plain]))
    points = points.withColumn("_key", host_key(F.col("_host")))
    splits = split_points(points, n)

    @F.pandas_udf("int")
    def range_of(keys, paths, salts):
        import pandas as pd

        out = np.empty(len(keys), dtype=np.int32)
        for i, (k, p, s) in enumerate(zip(keys, paths, salts)):
            lo, hi = bisect_left(splits, (k, p)), bisect_right(splits, (k, p))
            out[i] = lo + s % (hi - lo + 1)
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def ranges_of(keys, paths):
        import pandas as pd

        return pd.Series([np.array(ranges_of_rule(splits, k, p), dtype=np.int32) for k, p in zip(keys, paths)])

    empty = F.lit(None).cast("string")
    told = (
        rules.filter("verdict IS NOT NULL")
        .select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("_host"),
                F.coalesce("path", F.lit("")).alias("_path"), F.col("verdict").alias("_verdict"))
        .groupBy("_host", "_path").agg(F.max("_verdict").alias("_verdict"))
        .withColumn("_key", host_key(F.col("_host")))
        .select(F.lit(None).cast(points.schema[ROW].dataType).alias(ROW), "_host", "_path", "_key",
                F.concat("_host", "_path").alias("_rule"), "_verdict", F.lit(0).alias("_kind"),
                F.explode(ranges_of("_key", "_path")).alias("_range")))
    dealt = points.select(ROW, "_host", "_path", "_key", empty.alias("_rule"), empty.alias("_verdict"), F.lit(1).alias("_kind"),
                          range_of("_key", "_path", "_salt").alias("_range"))
    found = (
        dealt.unionByName(told)
        .repartitionById(n, F.col("_range"))
        .sortWithinPartitions("_range", "_key", "_kind", "_path")
        .mapInArrow(lambda batches: sweep(batches, default),
                    T.StructType([T.StructField(ROW, points.schema[ROW].dataType),
                                  *[T.StructField(c, T.StringType()) for c in ("_host", "_path", "_rule", "_verdict")]])))
    return unpack(found, T.StructType([shape[c] for c in kept]),
                  {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule"), "verdict": F.col("_verdict")})
