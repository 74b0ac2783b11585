"""Measure cube (A1, A2, A4, A5, A6): every aggregate the search can ask for,
from one scan per fact table.

The reference evaluates one aggregate query per (candidate, snapshot,
grouping). Here the fact table is scanned once.

``GROUPING SETS`` on the scan give the total, every single dimension and every
(filter, dimension) pair with ``SUM(CAST(m AS DECIMAL))`` and ``COUNT(m)`` for
every numeric column and ``COUNT(*)``. Partial aggregation right behind the
Expand means that each task ships at most one row per key, so neither a hot
snapshot nor a hot dimension value skews the shuffle, and nothing grows with
the product of the dimensions. The result is unpivoted to the long format

``table, as_of, dim, dim_value, fcol, fvalue, measure, s, n``

``s`` is the exact sum (NULL when no non-null input), ``n`` the non-null count;
``measure = '*'`` carries ``COUNT(*)``. SUM, COUNT(col) and AVG of any cell
derive from ``(s, n)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import MEASURE_TYPE

SUM_TYPE = "decimal(38,4)"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)

CELL_SCHEMA = ("table", "as_of", "dim", "dim_value", "fcol", "fvalue", "measure", "s", "n")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def _interpretations(dims, filters):
    """Grouping sets and, for each, the (dim, fcol) readings of its rows.

    A set is keyed by its column *set*: (f, d) and (d, f) are one grouping
    set (same grouping id) read twice, never two sets.
    """
    sets: dict[frozenset, tuple[tuple[str, ...], list]] = {frozenset(): ((), [(None, None)])}

    def add(cols, reading):
        k = frozenset(cols)
        if k not in sets:
            sets[k] = (tuple(cols), [])
        if reading not in sets[k][1]:
            sets[k][1].append(reading)

    for c in list(dict.fromkeys(list(dims) + list(filters))):
        if c in dims:
            add((c,), (c, None))
        if c in filters:
            add((c,), (None, c))
    for f in filters:
        for d in dims:
            if f != d:
                add((f, d), (d, f))
    return list(sets.values())


# Fixed value: a measure in ten-thousandths is three whole numbers to this base; their sums stay exact for 10 ** 11 rows.
LIMB = 10_000_000


def _limbs(f: T.StructField) -> list:
    """``CAST(m AS MEASURE_TYPE)`` as three longs ``(l0, l1, l2)``: ``m = (l0 + LIMB * (l1 + LIMB * l2)) / 10000``.

    Sums of them are sums of longs. A double whose ten-thousandths lie near a whole number, and whole numbers, are
    cut at once: no rounding is in doubt there; all others by way of the decimal.
    """
    m, base = F.col(f.name), F.lit(LIMB).cast("bigint")
    d = m.cast(MEASURE_TYPE)
    div = lambda a, b: F.call_function("div", a, b)
    high = div(d, F.lit(LIMB // 10_000).cast("decimal(4,0)"))
    low = ((d - high.cast("decimal(20,0)") * F.lit(LIMB // 10_000).cast("decimal(4,0)")) * F.lit(10_000).cast("decimal(5,0)")).cast("bigint")
    if isinstance(f.dataType, T.DoubleType):
        x = m * F.lit(10_000.0)
        sure, units = (F.abs(m) < 9e10) & (F.abs(x - F.rint(x)) < 0.25), F.rint(x).cast("bigint")
    elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        v = m.cast("bigint")
        sure, units = v.between(-90_000_000_000, 90_000_000_000), v * F.lit(10_000).cast("bigint")
    else:
        sure, units = F.lit(False), F.lit(0).cast("bigint")
    h = F.when(sure, div(units, base)).otherwise(high)
    return [F.when(sure, units % base).otherwise(low), h % base, div(h, base)]


def _limb_sum(i: int) -> F.Column:
    s = [F.sum(f"__l{i}_{k}").cast("decimal(20,0)") for k in range(3)]
    return (s[0] * F.lit("0.0001").cast("decimal(4,4)") + s[1] * F.lit(LIMB // 10_000).cast("decimal(4,0)")
            + s[2] * F.lit(LIMB * LIMB // 10_000).cast("decimal(11,0)")).cast(SUM_TYPE)


def _cells_for_sets(src: DataFrame, table: str, snapshot_col: str, cols: list[str], sets, measures: list[str]) -> DataFrame:
    # cut into whole numbers ahead of the Expand: once per row, not once per grouping set
    src = src.select("*", *[x.alias(f"__l{i}_{k}") for i, m in enumerate(measures) for k, x in enumerate(_limbs(src.schema[m]))])
    aggs = []
    for i, m in enumerate(measures):
        aggs.append(_limb_sum(i).alias(f"s{i}"))
        aggs.append(F.count(m).alias(f"n{i}"))
    aggs.append(F.count(F.lit(1)).alias("rows"))
    group_cols = [snapshot_col] + cols
    gsets = [[snapshot_col] + list(s) for s, _ in sets]
    agg = src.groupingSets(gsets, *group_cols).agg(F.grouping_id().alias("_gid"), *aggs)

    nbits = len(group_cols)
    reading = None
    for s, reads in sets:
        mask = 0
        for pos, c in enumerate(group_cols):
            if c != snapshot_col and c not in s:
                mask |= 1 << (nbits - 1 - pos)
        structs = []
        for d, f in reads:
            structs.append(F.struct(
                F.lit(d).cast("string").alias("dim"),
                (F.col(d).cast("string") if d else F.lit(None).cast("string")).alias("dim_value"),
                F.lit(f).cast("string").alias("fcol"),
                (F.col(f).cast("string") if f else F.lit(None).cast("string")).alias("fvalue"),
            ))
        arr = F.array(*structs)
        reading = F.when(F.col("_gid") == mask, arr) if reading is None else reading.when(F.col("_gid") == mask, arr)
    meas = [F.struct(F.lit(m).alias("measure"), F.col(f"s{i}").alias("s"), F.col(f"n{i}").alias("n"))
            for i, m in enumerate(measures)]
    meas.append(F.struct(F.lit("*").alias("measure"), F.col("rows").cast(SUM_TYPE).alias("s"),
                         F.col("rows").alias("n")))
    out = (agg.select(F.col(snapshot_col).alias("as_of"), F.explode(reading).alias("k"),
                      F.array(*meas).alias("ms"))
              .select("as_of", "k.*", F.explode("ms").alias("m"))
              .select(F.lit(table).alias("table"), "as_of", "dim", "dim_value", "fcol", "fvalue",
                      "m.measure", "m.s", "m.n"))
    # NULL data groups are not reportable (the reference drops them).
    return out.where((F.col("dim").isNull() | F.col("dim_value").isNotNull())
                     & (F.col("fcol").isNull() | F.col("fvalue").isNotNull()))


def measure_cube(df: DataFrame, table: str, snapshot_col: str, dims: list[str],
                 filters: list[str] | None = None, measures: list[str] | None = None) -> DataFrame:
    """A5: the long-format cube of one fact table (see module doc)."""
    filters = list(filters or [])
    if measures is None:
        measures = numeric_columns(df, exclude=set(dims) | set(filters) | {snapshot_col})
    cols = list(dict.fromkeys(list(dims) + filters))
    return _cells_for_sets(df.select(snapshot_col, *cols, *measures), table, snapshot_col, cols,
                           _interpretations(dims, filters), measures)


def distinct_values(cells: DataFrame) -> DataFrame:
    """Distinct non-null values per (table, as_of, column), from the cube."""
    return (cells.where("fcol IS NULL AND dim IS NOT NULL AND measure = '*'")
                 .select("table", "as_of", F.col("dim").alias("column"),
                         F.col("dim_value").alias("value"), F.col("n").alias("rows")))
