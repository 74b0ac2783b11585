"""Join helpers (J1). How a join is carried out is left to adaptive execution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_side(ref: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """J1 guard: the reference rows whose key occurs once. A repeated key is
    ambiguous and binds nothing; it would multiply the measures it joins."""
    one = ref.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(c) for c in columns])
    return one.where("__n = 1").drop("__n")


def one_hop(fact: DataFrame, ref: DataFrame, fact_key: str, ref_key: str, columns: list[str]) -> DataFrame:
    """The fact rows, each once, with ``columns`` of the reference row that
    ``fact_key`` names (NULL where none or several do)."""
    r = unique_side(ref, ref_key, columns).withColumnRenamed(ref_key, "__key")
    return fact.join(r, F.col(fact_key) == F.col("__key"), "left").drop("__key")
