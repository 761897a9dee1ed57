"""Connected components of an undirected graph, by alternating large-star and small-star rounds.

Each round is two grouped minima (with map-side combine) and two joins; a node with very many neighbours is split by
Spark's skew join, since the minima stand on the other, unique side.  Rounds grow with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.plans.iterate import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: greater neighbours move to the least node about ``u``.  Small: lesser neighbours (and ``u``) do."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its least node.

    Self-loops keep their node; null ends are ignored.  Raises if ``max_rounds`` don't suffice.
    """
    pairs = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null"))  # read twice
    alone = pairs.where("u = v").select("u")
    now = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = cut(_star(_star(now, True).where("u <> v").distinct(), False).where("u <> v").distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component")
    lone = alone.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return found.unionByName(roots).unionByName(lone).groupBy("node").agg(F.min("component").alias("component"))
