"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from figureproof.session import checkpoint_dir

# A-Z only, as the contracts ask: other scripts keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Separators of words: every ASCII character that is no digit and no letter.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "figureproof", f"{name}-{uuid.uuid4().hex}")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def hash128(col):
    """Two 64-bit hashes of a column under different seeds: what stands for a text where the text itself is too long."""
    return F.xxhash64(col), F.xxhash64(F.lit(2024), col)


def spread_rank(df: DataFrame, keys: list[str], order: list[str], out: str, per_task: int = 100_000) -> DataFrame:
    """Gapless rank from 0 of the rows of each key, without any key's rows meeting in one task.

    Rows of a key are dealt by hash to buckets of about ``per_task`` rows; each
    bucket is numbered by itself, and a running sum over the bucket sizes (a
    table of one row per key and bucket) shifts it. ``order`` must tell rows
    apart; the rank follows (bucket, order).
    """
    b, n, base = f"{out}__b", f"{out}__n", f"{out}__base"
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    deal = F.pmod(F.xxhash64(F.lit(17), *order), F.ceil(F.col(n) / F.lit(per_task)).cast("long")).cast("int")
    dealt = _join(df, sizes, keys).withColumn(b, deal).drop(n)
    counts = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    upto = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn(base, F.coalesce(F.sum(n).over(upto), F.lit(0))).drop(n)
    within = Window.partitionBy(*keys, b).orderBy(*order)
    ranked = dealt.withColumn(out, F.row_number().over(within) - 1)
    joined = _join(ranked, bases, [*keys, b])
    return joined.withColumn(out, (F.col(out) + F.col(base)).cast("long")).drop(b, base)


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe inner join on equal names, the left columns kept."""
    renamed = right.select(*[F.col(k).alias(f"{k}__r") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"{k}__r"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond).drop(*[f"{k}__r" for k in keys])
