"""Connected components of a graph given as links, by alternating star contraction.

Each round joins the links with the least neighbour of each node and writes the
new links to the shared folder. The number of rounds grows with the logarithm
of the size; no node's neighbours meet in one task (minima are pre-aggregated,
a hub's links stay spread by the other end when its minimum is joined on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node goes to the node's least neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u > v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lesser neighbours go to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links of longs -> (node, root): the least node that each linked node reaches."""
    now = keep(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
               .filter("u > v").distinct(), "links")
    state = None
    for _ in range(max_rounds):
        now = keep(_small_star(_large_star(now)), "links")
        # two figures tell whether the links still change
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(seen)
    raise RuntimeError(f"the links still change after {max_rounds} rounds")
