"""Connected components by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafuse.session import discard, stored

#: Each round at least halves the longest path of what isn't a star yet.
ROUNDS = 64


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the undirected edges (a, b). Rounds of two aggregates and two
    joins, each stored in the shared folder, until nothing changes; RuntimeError after ROUNDS of them."""
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    alone = edges.where("a = b").select("a")
    now = stored(both.where("a <> b").distinct())
    before = _signature(now)
    for _ in range(ROUNDS):
        # every node's larger neighbours point to the smallest node around it
        way = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = way.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stored(way.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # and its smaller neighbours and itself do
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        following = stored(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        discard(now)
        discard(large)
        now, after = following, _signature(following)
        if after == before:
            roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
            joined = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
            lone = alone.distinct().join(joined, alone["a"] == joined["node"], "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
            return joined.union(lone)
        before = after
    raise RuntimeError(f"components are open after {ROUNDS} rounds")
