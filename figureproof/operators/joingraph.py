"""Marts from the join graph.

Every table with numbers is a source. Its mart is one wide scan: the reference
tables that it reaches over edges with proven unique targets are joined one
behind the other, so no row of the fact is multiplied, and the low-cardinality
columns of all of them are dimensions of its cube.

* Edges: integer columns of the same name (or the same name behind the table
  prefix) in two tables. A target is proven in two steps: a sketch of all
  candidate columns in one aggregate per table, then a count of repeated keys for
  those the sketch leaves in play.
* Paths: a frontier search from all tables at once, one join a round; the
  shortest path to a table wins, then the first in name order.
* Dimensions: text columns with 2 to ``MAX_VALUES`` values; sketches first, exact
  counts for those near or below the bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .cube import measure_cube, numeric_columns

MAX_VALUES = 50
#: Length from which a name without its table prefix says enough to join by.
MIN_NAME = 4
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def candidate_edges(spark, tabs: dict[str, DataFrame]) -> DataFrame:
    """``t1, c1, t2, c2``: integer columns that share a name, in both directions."""
    rows = [(t, f.name) for t, df in tabs.items() for f in df.schema.fields if isinstance(f.dataType, _WHOLE)]
    c = spark.createDataFrame(rows, "table string, column string")
    bare = F.regexp_replace("column", "^[a-z]+_", "")
    named = c.select("table", "column", F.explode(F.array_distinct(F.array(
        F.col("column"), F.when(F.length(bare) >= MIN_NAME, bare).otherwise(F.col("column"))))).alias("name"))
    a, b = named.alias("a"), named.alias("b")
    return (a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.table") != F.col("b.table")))
             .select(F.col("a.table").alias("t1"), F.col("a.column").alias("c1"), F.col("b.table").alias("t2"), F.col("b.column").alias("c2")).distinct())


def unique_columns(tabs: dict[str, DataFrame], columns: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Those of the columns without NULL and repeats, as (table, column)."""
    out = []
    for t, cs in sorted(columns.items()):
        rough = tabs[t].agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(cs)],
                            *[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(cs)]).first()
        for i, c in enumerate(cs):
            # a sketch five standard errors below the rows rules a column out
            if rough["rows"] and rough[f"n{i}"] == rough["rows"] and rough[f"d{i}"] >= 0.9 * rough["rows"]:
                if not tabs[t].groupBy(c).count().where("count > 1").limit(1).count():
                    out.append((t, c))
    return out


def proven_edges(spark, tabs: dict[str, DataFrame]) -> DataFrame:
    """The candidate edges whose target is unique."""
    edges = candidate_edges(spark, tabs)
    columns: dict[str, list[str]] = {}
    for r in edges.select("t2", "c2").distinct().orderBy("t2", "c2").collect():  # as many as columns in the catalog at most
        columns.setdefault(r["t2"], []).append(r["c2"])
    unique = unique_columns(tabs, columns)
    return edges.join(spark.createDataFrame(unique, "t2 string, c2 string"), ["t2", "c2"], "left_semi").select("t1", "c1", "t2", "c2")


def paths(edges: DataFrame) -> DataFrame:
    """``fact, target, hops, path``: the tables that each table reaches, by the shortest path of edges."""
    e = materialize(edges, "edges")
    step = F.struct("t1", "c1", "t2", "c2")
    front = e.select(F.col("t1").alias("fact"), F.col("t2").alias("target"), F.lit(1).alias("hops"), F.array(step).alias("path"))
    found = None
    while True:
        w = Window.partitionBy("fact", "target").orderBy(F.transform("path", lambda p: F.concat_ws(".", p["t1"], p["c1"], p["t2"], p["c2"])))
        front = front.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
        if found is not None:
            front = front.join(found.select("fact", "target"), ["fact", "target"], "left_anti")
        front = materialize(front, "frontier")
        if front.limit(1).count() == 0:
            return found if found is not None else front
        found = front if found is None else found.unionByName(front)
        front = (front.join(e, F.col("target") == F.col("t1")).where("t2 <> fact")
                      .select("fact", F.col("t2").alias("target"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array(step)).alias("path")))


def low_cardinality(tabs: dict[str, DataFrame], most: int = MAX_VALUES) -> dict[str, list[str]]:
    """Text columns with 2 to ``most`` different values, per table in schema order."""
    out = {}
    for t, df in tabs.items():
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if cols:
            rough = df.agg(*[F.approx_count_distinct(c, 0.05).alias(f"d{i}") for i, c in enumerate(cols)]).first()
            near = [c for i, c in enumerate(cols) if rough[f"d{i}"] <= 2 * most]
            if near:
                n = df.agg(*[F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(near)]).first()
                out[t] = [c for i, c in enumerate(near) if 2 <= n[f"d{i}"] <= most]
    return {t: cs for t, cs in out.items() if cs}


def wide(tabs: dict[str, DataFrame], fact: str, reached: list, dims: dict[str, list[str]]) -> tuple[DataFrame, dict[str, tuple[str, str, int]]]:
    """The fact with the dimension columns of the tables it reaches, and ``{name: (table, column, hops)}`` of them.

    A table is joined if it, or one behind it, has a dimension; of its columns only those and the keys further on.
    """
    wanted = [p for p in reached if p["target"] in dims]
    on_way = sorted({(k, e["t1"], e["c1"], e["t2"], e["c2"]) for p in wanted for k, e in enumerate(p["path"])})
    df = tabs[fact]
    named = {c: (fact, c, 0) for c in dims.get(fact, [])}
    hops = {p["target"]: p["hops"] for p in wanted}
    for k, t1, c1, t2, c2 in on_way:
        further = {e[2] for e in on_way if e[1] == t2}
        cols = dims.get(t2, []) if t2 in hops else []
        ref = tabs[t2].select(F.col(c2).alias(f"{t2}__key"), *[F.col(c).alias(f"{t2}__{c}") for c in dict.fromkeys([*cols, *sorted(further)])])
        df = df.join(ref, F.col(c1 if t1 == fact else f"{t1}__{c1}") == F.col(f"{t2}__key"), "left")
        named |= {f"{t2}__{c}": (t2, c, k + 1) for c in cols}
    return df, named


def graph_cube(spark, tabs: dict[str, DataFrame], as_of: dict[str, F.Column]) -> DataFrame:
    """The cells of every table with numbers: ``table, as_of, dim_table, column, hops, dim_value, measure, s, n``.

    ``as_of`` gives the snapshot date of the tables that have one; the others have one undated snapshot.
    """
    reached: dict[str, list] = {}
    for r in paths(proven_edges(spark, tabs)).orderBy("fact", "hops", "target").collect():  # table pairs of the catalog
        reached.setdefault(r["fact"], []).append(r)
    dims = low_cardinality(tabs)
    cells = []
    for t, df in sorted(tabs.items()):
        measures = numeric_columns(df)
        if not measures:
            continue
        mart, named = wide(tabs, t, reached.get(t, []), dims)
        dated = mart.withColumn("__as_of", as_of[t] if t in as_of else F.lit(None).cast("date"))
        of = measure_cube(dated, t, "__as_of", list(named), None, measures)
        if named:
            names = spark.createDataFrame([(d, *v) for d, v in named.items()], "dim string, dim_table string, column string, hops int")
            of = of.join(F.broadcast(names), "dim", "left")
        else:
            of = of.withColumns({"dim_table": F.lit(None).cast("string"), "column": F.lit(None).cast("string"), "hops": F.lit(None).cast("int")})
        cells.append(of.select("table", "as_of", "dim_table", "column", "hops", "dim_value", "measure", "s", "n"))
    return reduce(DataFrame.unionByName, cells)
