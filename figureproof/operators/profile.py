"""Column catalog, profiling and role inference.

``profile`` is one aggregate pass per table: every statistic of every
column is a partial aggregate (count, min, max, HyperLogLog sketch), so the
pass is map-side combined and skew-free. The exact NDV variant unpivots the
columns and counts distinct (column, hash of the value) keys, which shuffles
16 bytes per distinct value once; use it only where exactness is required.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Identifier / flag / measure / time suffixes and flag
# prefixes, tested in this order (an identifier suffix wins, so ``_num`` is
# always an identifier).
ID_SUFFIXES = ["_sk", "_id", "_key", "_fk", "_pk", "_code", "_no", "_num"]
FLAG_SUFFIXES = ["_flag", "_ind", "_indicator", "_yn", "_bool"]
FLAG_PREFIXES = ["is_", "has_", "can_", "was_", "did_"]
MEASURE_SUFFIXES = ["_amt", "_amount", "_price", "_cost", "_revenue", "_sales", "_profit",
                    "_fee", "_balance", "_total", "_sum", "_value", "_qty", "_quantity",
                    "_count", "_num"]
TIME_SUFFIXES = ["_dt", "_date", "_ts", "_timestamp", "_at", "_time", "_year", "_month",
                 "_day", "_week"]

_NUM = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
        T.DecimalType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType,
         T.YearMonthIntervalType)


def type_bucket(dt: T.DataType) -> str:
    """string / number / time / boolean (integers included)."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, _NUM):
        return "number"
    if isinstance(dt, _TIME):
        return "time"
    return "string"


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table, column, ordinal, spark_type, kind`` from the schemas."""
    rows = []
    for t, df in tables.items():
        for i, f in enumerate(df.schema.fields):
            rows.append((t, f.name, i, f.dataType.simpleString(), type_bucket(f.dataType)))
    return spark.createDataFrame(rows, "table string, column string, ordinal int, "
                                       "spark_type string, kind string")


def role(column: Column, kind: Column) -> Column:
    """identifier / flag / measure_input / dimension / unknown."""
    c = F.lower(column)

    def ends(sufs):
        e = F.lit(False)
        for s in sufs:
            e = e | c.endswith(s)
        return e

    def starts(prefs):
        e = F.lit(False)
        for p in prefs:
            e = e | c.startswith(p)
        return e

    return (F.when(kind == "boolean", "flag")
             .when(ends(ID_SUFFIXES), "identifier")
             .when(ends(FLAG_SUFFIXES), "flag")
             .when(starts(FLAG_PREFIXES), "flag")
             .when(ends(MEASURE_SUFFIXES) & (kind == "number"), "measure_input")
             .when(ends(TIME_SUFFIXES) | (kind == "time"), "dimension")
             .when(kind == "number", "measure_input")
             .when(kind == "string", "dimension")
             .otherwise("unknown"))


#: Relative standard error of an approximate distinct count.
RSD = 0.01


def _atomic(dt):
    return not isinstance(dt, (T.ArrayType, T.MapType, T.StructType))


def profile(df: DataFrame, table: str, exact: bool = False) -> DataFrame:
    """``table, column, n_rows, non_null, ndv, min_num, max_num,
    min_str, max_str`` in one pass (plus one distinct shuffle if exact)."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        aggs.append(F.count(c).alias(f"nn{i}"))
        if not exact:
            aggs.append(F.approx_count_distinct(c, RSD).alias(f"nd{i}") if _atomic(f.dataType)
                        else F.lit(None).cast("bigint").alias(f"nd{i}"))
        num = isinstance(f.dataType, _NUM)
        txt = isinstance(f.dataType, T.StringType)
        aggs.append((F.min(c).cast("double") if num else F.lit(None).cast("double")).alias(f"mn{i}"))
        aggs.append((F.max(c).cast("double") if num else F.lit(None).cast("double")).alias(f"mx{i}"))
        aggs.append((F.min(c) if txt else F.lit(None).cast("string")).alias(f"ms{i}"))
        aggs.append((F.max(c) if txt else F.lit(None).cast("string")).alias(f"xs{i}"))
    one = df.agg(*aggs)
    stats = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("ordinal"),
                               F.col(f"nn{i}").alias("non_null"),
                               (F.col(f"nd{i}") if not exact else F.lit(None).cast("bigint")).alias("ndv"),
                               F.col(f"mn{i}").alias("min_num"), F.col(f"mx{i}").alias("max_num"),
                               F.col(f"ms{i}").alias("min_str"), F.col(f"xs{i}").alias("max_str"))
                      for i, f in enumerate(fields)])
    out = one.select(F.col("__rows").alias("n_rows"), F.explode(stats).alias("s")).select(
        F.lit(table).alias("table"), "s.column", "s.ordinal", "n_rows", "s.non_null", "s.ndv",
        "s.min_num", "s.max_num", "s.min_str", "s.max_str")
    if exact:
        ndv = exact_ndv(df, table)
        out = out.drop("ndv").join(ndv, ["table", "column"], "left")
    return out


def exact_ndv(df: DataFrame, table: str) -> DataFrame:
    """Exact distinct counts of the atomic columns: unpivot to (column, 128-bit
    hash of the value) and count distinct keys. The shuffle carries 16 bytes for
    each distinct value of a map task, not the values; counting is spread over
    the keys."""
    cols = [f for f in df.schema.fields if _atomic(f.dataType)]
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(F.col(f.name).isNotNull(), F.xxhash64(F.col(f.name))).alias("h"),
                 F.xxhash64(F.lit(7), F.col(f.name)).alias("g"))
        for i, f in enumerate(cols)])).alias("kv")).select("kv.i", "kv.h", "kv.g").where(F.col("h").isNotNull())
    names = F.array(*[F.lit(f.name) for f in cols])
    return (stacked.distinct().groupBy("i").agg(F.count(F.lit(1)).alias("ndv"))
                   .select(F.element_at(names, F.col("i") + 1).alias("column"), "ndv", F.lit(table).alias("table")))


def sample_text(f: T.StructField) -> F.Column:
    """A value as text, the same for every reader: numbers with a fraction to four places, times to the second."""
    c = F.col(f.name)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        c = c.cast("decimal(24,4)")
    elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def _place(text: F.Column) -> F.Column:
    """A value's place in [0, 2 ** 60): the first 15 hex digits of its md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


SPACE = 1 << 60


def samples(df: DataFrame, table: str, k: int = 5) -> DataFrame:
    """``table, column, samples``: of each column the ``k`` different values with the least places.

    These do not depend on how the rows are partitioned. A sketch tells how many values a column has; then one
    scan keeps those below the place where some 4 k of them are expected, as (column, place, value) keys with partial
    aggregation. Columns with fewer than ``k`` found are looked at again with 16 times the bound, until it covers
    all places: no value is missed, and the values themselves are not shuffled.
    """
    fields = [f for f in df.schema.fields if _atomic(f.dataType)]
    rough = df.agg(*[F.approx_count_distinct(f.name, 0.05).alias(f"d{i}") for i, f in enumerate(fields)]).first()
    bound = {i: min(SPACE, SPACE * 4 * k // max(rough[f"d{i}"], 1)) for i in range(len(fields))}
    done = []
    while bound:
        kept = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _place(sample_text(fields[i])).alias("h"), sample_text(fields[i]).alias("v"))
                                             for i in bound])).alias("x")).select("x.*")
        most = F.lit(None).cast("bigint")
        for i, b in bound.items():
            most = F.when(F.col("i") == i, F.lit(b)).otherwise(most)
        found = kept.where(F.col("h") < most).groupBy("i", "h", "v").agg(F.count(F.lit(1)).alias("n")).select("i", "h", "v")
        w = Window.partitionBy("i").orderBy("h", "v")
        least = materialize(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k), "samples")
        n = {r["i"]: r["n"] for r in least.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
        ready = [i for i, b in bound.items() if b == SPACE or n.get(i, 0) >= k]
        if ready:
            done.append(least.where(F.col("i").isin(ready)))
        bound = {i: min(SPACE, b * 16) for i, b in bound.items() if i not in ready}
    names = F.array(*[F.lit(f.name) for f in fields])
    rows = reduce(DataFrame.unionByName, done)
    return rows.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("s")).select(
        F.lit(table).alias("table"), F.element_at(names, F.col("i") + 1).alias("column"), F.transform("s", lambda x: x["v"]).alias("samples"))


def key_candidates(prof: DataFrame) -> DataFrame:
    """A column named ``*_id`` whose distinct count reaches the row count
    (no duplicates, no NULLs) is a key."""
    return (prof.where(F.lower("column").endswith("_id") & (F.col("ndv") >= F.col("n_rows"))
                       & (F.col("non_null") == F.col("n_rows")))
                .select("table", "column", "n_rows", "ndv"))


def join_edges(catalog: DataFrame, strip_prefix: bool = False) -> DataFrame:
    """Columns with the same name in two tables give an edge (both
    directions). ``strip_prefix`` also matches TPC-style ``x_name`` columns
    by the part after the first underscore."""
    name = (F.regexp_replace("column", "^[a-z]+_", "") if strip_prefix else F.col("column"))
    c = catalog.select("table", "column", name.alias("name"))
    a, b = c.alias("a"), c.alias("b")
    e = (a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.table") != F.col("b.table")))
          .select(F.col("a.table").alias("t1"), F.col("a.column").alias("c1"),
                  F.col("b.table").alias("t2"), F.col("b.column").alias("c2"),
                  F.col("a.name").alias("name")))
    return e
