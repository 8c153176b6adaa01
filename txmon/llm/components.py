"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a group-by minimum (map-side combine) and a join back on the same key, so a node with very many
neighbours is only a split join key, never one group in one task. Rounds are written to the shared
folder; the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmon.llm.common import materialize


def _star(pairs: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """pairs(a, b) with the smallest of a and its partners as ``m``."""
    pairs = materialize(pairs, f"cc-{tag}")
    low = materialize(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"cc-{tag}-min")
    return pairs.join(low, "a"), low


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the smallest node reachable.

    Self loops, repeated and reversed edges are allowed; nulls must be filtered before. Raises if
    ``max_rounds`` are not enough (rounds grow with the logarithm of a component's diameter).
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, _low = _star(both, "large")
        down = large.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small, low = _star(down, "small")
        now = materialize(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.filter("a <> m").select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
