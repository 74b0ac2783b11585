"""Similarity join of token sets with an exact bound, and the groups that links make.

Two sets are alike by 2 |A ∩ B| / (|A| + |B|) (the Dice measure, F1 of tokens).
If that is at least ``floor``, they share at least ceil(floor |A| / (2 - floor))
tokens of A; so of A's tokens in any order common to all sets the first
|A| - ceil(...) + 1 hold one that is among the first ones of B as well. Only
these prefixes are joined (an equi-join on the token), with the lengths as a
further condition, and every pair met is verified: no pair is lost, none is
too many. With the rarest tokens first the lists that meet are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def rare_first(df: DataFrame, ids: list[str], toks: str = "toks") -> DataFrame:
    """``ids, toks`` with the tokens of each row ordered by the number of rows that hold them, the rarest first."""
    one = df.select(*ids, F.explode(toks).alias("tok"))
    n = one.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    # a row's tokens are those of one name
    return (one.join(n, "tok").groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("n", "tok"))).alias("t"))
               .select(*ids, F.transform("t", lambda s: s["tok"]).alias(toks)))


def _prefix(toks: Column, floor: float) -> Column:
    n = F.size(toks)
    # a little less than the bound, so that rounding loses nothing
    least = F.greatest(F.ceil(n * F.lit(floor / (2.0 - floor)) - F.lit(1e-9)), F.lit(1)).cast("int")
    return F.slice(toks, 1, F.greatest(n - least + 1, F.lit(0)))


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def dice_pairs(left: DataFrame, right: DataFrame, lid: str, rid: str, floor: float) -> DataFrame:
    """``lid, rid`` of all pairs whose token sets have a Dice measure of at least ``floor`` (> 0).

    ``left(lid, toks)`` and ``right(rid, toks)``: arrays without repeats, in one order common to both.
    """
    if not 0 < floor <= 1:
        raise ValueError("the floor lies above 0 and at most at 1")
    l = left.select(lid, F.col("toks").alias("la"), F.explode(_prefix(F.col("toks"), floor)).alias("tok"))
    r = right.select(rid, F.col("toks").alias("ra"), F.explode(_prefix(F.col("toks"), floor)).alias("tok"))
    near = ((2.0 - floor) * F.least(F.size("la"), F.size("ra")) + 1e-9 >= floor * F.greatest(F.size("la"), F.size("ra")))
    met = l.join(r, "tok").where(near & (dice(F.col("la"), F.col("ra")) + 1e-9 >= floor))
    return met.select(lid, rid).distinct()


def groups(links: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """``node, root``: the least node that each node reaches by the ``links(a, b)``.

    Each round takes the least label among a node's own and its neighbours' and
    then that label's label; rounds grow with the logarithm of the longest
    path, each is written. Minima are pre-aggregated, so a hub's neighbours do
    not meet in one task.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialize(nodes.select(F.col(node).alias("v"), F.col(node).alias("root")), "labels")
    while True:
        by = both.join(label, F.col("b") == F.col("v")).groupBy("a").agg(F.min("root").alias("near"))
        met = label.join(by, F.col("v") == F.col("a"), "left").select(
            "v", F.col("root").alias("was"), F.least("root", "near").alias("m"))
        up = label.select(F.col("v").alias("u"), F.col("root").alias("further"))
        label = materialize(met.join(up, F.col("m") == F.col("u"), "left").select(
            "v", "was", F.least("m", "further").alias("root")), "labels")
        if label.where("root <> was").limit(1).count() == 0:
            return label.select(F.col("v").alias(node), "root")
        label = label.select("v", "root")
