"""The quarterly report fixture, derived by Spark from the driver tables.

The engine's input is (a) warehouse tables with dated snapshots and (b) the
figures a report printed. The driver tables have no report, so this module
*publishes* one from the data, the same way a finance team would: per
quarter-end snapshot it prints totals and breakdowns in millions with three
decimals, a count, a ratio, one filtered metric, prior-quarter footnotes,
a renamed metric and an unmappable percentage. Everything is a DataFrame
computed from the tables, so its size and cost grow with them.

Planted traps (fixed values):
* ``o_totalprice_v1`` — a deprecated twin of ``o_totalprice``: 1 % high/low
  on priorities 1-4 alternately, equal on priority 5, so it passes the grand
  total (the shifts nearly cancel) but fails most breakdowns.
* "Shipped Quantity" is silently redefined in the second edition to exclude
  returned lines (``l_returnflag <> 'R'``).
* "Order Value" is renamed "Booked Order Value" in the second edition.
* "Line Count" disappears and "Average Unit Price" appears in the second
  edition.
* "Capital Buffer" (a percentage) has no source in the warehouse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import quarter_end
from ..sources.tables import read_table
from ..operators.joins import one_hop
from ..session import materialize

# Fixed values of the fixture.
# Two-decimal factors keep price x factor exact at four decimals (no rounding
# ties when the cube casts to DECIMAL(20,4)).
TWIN_FACTORS = {"1-URGENT": 1.01, "2-HIGH": 0.99, "3-MEDIUM": 1.01, "4-NOT SPECIFIED": 0.99}
TWIN_DEFAULT = 1.00
UNMAPPABLE_VALUE = "12.5"
EDITION_IDS = ("rpt_q1", "rpt_q2")


def orders_mart(spark: SparkSession, sf_dir: str, snaps=None) -> DataFrame:
    """Orders with their quarter snapshot, the planted twin and the
    customer's market segment (one-hop dimension, J1)."""
    o = read_table(spark, sf_dir, "orders")
    if snaps is not None:
        o = o.where(snapshot_predicate("o_orderdate", snaps))
    factor = F.lit(TWIN_DEFAULT)
    for k, v in TWIN_FACTORS.items():
        factor = F.when(F.col("o_orderpriority") == k, F.lit(v)).otherwise(factor)
    twin = F.col("o_totalprice") * factor
    return (one_hop(o, read_table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ["c_mktsegment"])
             .select(quarter_end("o_orderdate").alias("as_of"), "o_orderkey", "o_custkey",
                     "o_totalprice", twin.alias("o_totalprice_v1"),
                     "o_orderstatus", "o_orderpriority", "c_mktsegment"))


def lineitem_mart(spark: SparkSession, sf_dir: str, snaps=None) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    if snaps is not None:
        li = li.where(snapshot_predicate("l_shipdate", snaps))
    return li.select(quarter_end("l_shipdate").alias("as_of"), "l_orderkey", "l_partkey",
                     "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_returnflag", "l_linestatus")


MART_DIMS = {
    "orders": ["o_orderstatus", "o_orderpriority", "c_mktsegment"],
    "lineitem": ["l_returnflag", "l_linestatus"],
}
# Columns of the mart that come from a one-hop join (for binding order).
JOINED_COLUMNS = {"orders": ["c_mktsegment"]}
# The edge that a joined column comes by: (own key, reference table, its key).
JOINED_EDGES = {("orders", "c_mktsegment"): ("o_custkey", "customer", "c_custkey")}
# The marts that one join connects (l_orderkey = o_orderkey), in both directions.
MART_HOPS = [("lineitem", "orders"), ("orders", "lineitem")]


def marts(spark: SparkSession, sf_dir: str, snaps=None) -> dict[str, DataFrame]:
    return {"orders": orders_mart(spark, sf_dir, snaps), "lineitem": lineitem_mart(spark, sf_dir, snaps)}


def edition_dates(spark: SparkSession, sf_dir: str):
    """Last two complete quarter ends of the order history."""
    row = (read_table(spark, sf_dir, "orders")
           .agg(F.max("o_orderdate").alias("mx")).first())
    last = spark.createDataFrame([(row["mx"],)], "mx timestamp").select(
        F.date_sub(F.trunc("mx", "quarter"), 1).alias("q2"),
        F.date_sub(F.add_months(F.trunc("mx", "quarter"), -3), 1).alias("q1"),
        F.date_sub(F.add_months(F.trunc("mx", "quarter"), -6), 1).alias("q0")).first()
    return last["q0"], last["q1"], last["q2"]


def _mm(x):
    """Millions with three decimals (exact: round the decimal sum to
    thousands, then shift)."""
    return (F.round(F.col(x), -3) / F.lit(1_000_000)).cast("decimal(38,6)")


def _exact(x):
    return F.col(x).cast("decimal(38,6)")


def _grouped(df: DataFrame, dims: list[str], aggs: list) -> DataFrame:
    """One grouping-sets aggregate per mart: totals and one row per value of
    each printed dimension, in the long form ``as_of, gcol, gval, ...``."""
    sets = [["as_of"]] + [["as_of", d] for d in dims]
    g = df.groupingSets(sets, "as_of", *dims).agg(F.grouping_id().alias("_gid"), *aggs)
    gcol = F.lit(None).cast("string")
    gval = F.lit(None).cast("string")
    n = len(dims) + 1
    for i, d in enumerate(dims):
        mask = ((1 << (n - 1)) - 1) ^ (1 << (n - 2 - i))
        gcol = F.when(F.col("_gid") == mask, F.lit(d)).otherwise(gcol)
        gval = F.when(F.col("_gid") == mask, F.col(d).cast("string")).otherwise(gval)
    names = [a for a in g.columns if a not in ["as_of", "_gid", *dims]]
    return g.select("as_of", gcol.alias("gcol"), gval.alias("gval"), *names)


def report_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published report (written once per session and data folder)."""
    from ..session import shared
    return shared(spark, ("figures", sf_dir),
                  lambda: materialize(_publish(spark, sf_dir), "report"))


def _publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed figures of both editions.

    Schema: ``report_id, edition_as_of, pos, metric, value, unit, as_of,
    dim, label`` (``dim``/``label`` NULL for totals). ``pos`` is the print
    order inside an edition.
    """
    q0, q1, q2 = edition_dates(spark, sf_dir)
    dates = [q0, q1, q2]
    o = _grouped(orders_mart(spark, sf_dir, dates).where(F.col("as_of").isin(*dates)),
                 ["o_orderpriority", "c_mktsegment", "o_orderstatus"],
                 [F.sum(F.col("o_totalprice").cast("decimal(20,4)")).alias("price"),
                  F.count(F.lit(1)).alias("n")])
    qty = F.col("l_quantity").cast("decimal(20,4)")
    li = _grouped(lineitem_mart(spark, sf_dir, dates).where(F.col("as_of").isin(*dates)),
                  ["l_linestatus", "l_returnflag"],
                  [F.sum(qty).alias("qty"),
                   F.sum(F.when(F.col("l_returnflag") != "R", qty)).alias("qty_kept"),
                   F.count(F.lit(1)).alias("n"),
                   F.sum(F.col("l_extendedprice").cast("decimal(20,4)")).alias("ext")])
    li = li.withColumn("avg_price", F.round(F.try_divide(F.col("ext"), F.col("qty")), 2))
    # both aggregates are small (snapshots x dimension values) and written once:
    # the print lines below start from a scan of the few rows, none reads the
    # marts (a cached plan served the first line of each only)
    o = materialize(o, "order-figures")
    li = materialize(li, "line-figures")

    r1, r2 = EDITION_IDS
    # (report, edition date, metric, unit, source, value, figure date, group column,
    #  printed dimension, label expression, print position)
    spec = [
        (r1, q1, "Order Value", "mm", o, _mm("price"), q1, None, None, None, 100),
        (r1, q1, "Order Value", "mm", o, _mm("price"), q1, "o_orderpriority", "priority", F.col("gval"), 110),
        (r1, q1, "Order Value", "mm", o, _mm("price"), q1, "c_mktsegment", "segment", F.initcap("gval"), 120),
        (r1, q1, "Order Count", "count", o, _exact("n"), q1, None, None, None, 200),
        (r1, q1, "Order Count", "count", o, _exact("n"), q1, "o_orderstatus", "status", F.col("gval"), 210),
        (r1, q1, "Shipped Quantity", "count", li, _exact("qty"), q1, None, None, None, 300),
        (r1, q1, "Shipped Quantity", "count", li, _exact("qty"), q1, "l_linestatus", "line_status", F.col("gval"), 310),
        (r1, q1, "Line Count", "count", li, _exact("n"), q1, None, None, None, 400),
        (r2, q2, "Booked Order Value", "mm", o, _mm("price"), q2, None, None, None, 100),
        (r2, q2, "Booked Order Value", "mm", o, _mm("price"), q1, None, None, None, 101),
        (r2, q2, "Booked Order Value", "mm", o, _mm("price"), q2, "o_orderpriority", "priority", F.col("gval"), 110),
        (r2, q2, "Order Count", "count", o, _exact("n"), q2, None, None, None, 200),
        (r2, q2, "Order Count", "count", o, _exact("n"), q1, None, None, None, 201),
        (r2, q2, "Order Count", "count", o, _exact("n"), q2, "o_orderstatus", "status", F.col("gval"), 210),
        (r2, q2, "Shipped Quantity", "count", li, _exact("qty_kept"), q2, None, None, None, 300),
        (r2, q2, "Shipped Quantity", "count", li, _exact("qty_kept"), q1, None, None, None, 301),
        (r2, q2, "Shipped Quantity", "count", li, _exact("qty_kept"), q2, "l_linestatus", "line_status", F.col("gval"), 310),
        (r2, q2, "Average Unit Price", "count", li, _exact("avg_price"), q2, None, None, None, 500),
        (r2, q2, "Average Unit Price", "count", li, _exact("avg_price"), q2, "l_returnflag", "return_flag", F.col("gval"), 510),
    ]
    parts = []
    for report, ed, metric, unit, src, value, at, gcol, dim, label, pos in spec:
        cond = (F.col("as_of") == F.lit(at)) & (
            F.col("gcol").isNull() if gcol is None else (F.col("gcol") == gcol))
        parts.append(src.where(cond).select(
            F.lit(report).alias("report_id"), F.lit(ed).cast("date").alias("edition_as_of"),
            F.lit(pos).alias("pos"), F.lit(metric).alias("metric"), value.alias("value"),
            F.lit(unit).alias("unit"), F.col("as_of"),
            F.lit(dim).cast("string").alias("dim"),
            (label if label is not None else F.lit(None).cast("string")).alias("label")))
    figs = parts[0]
    for p in parts[1:]:
        figs = figs.unionByName(p)
    # The unmappable percentage, one per edition.
    unm = spark.createDataFrame(
        [(r1, q1, 900, "Capital Buffer", UNMAPPABLE_VALUE, "%", q1),
         (r2, q2, 900, "Capital Buffer", UNMAPPABLE_VALUE, "%", q2)],
        "report_id string, edition_as_of date, pos int, metric string, value string, unit string, "
        "as_of date").select("report_id", "edition_as_of", "pos", "metric",
                             F.col("value").cast("decimal(38,6)").alias("value"), "unit", "as_of",
                             F.lit(None).cast("string").alias("dim"),
                             F.lit(None).cast("string").alias("label"))
    figs = figs.where(F.col("value").isNotNull()).unionByName(unm)
    return figs.select("report_id", "edition_as_of", F.col("pos").cast("int").alias("pos"), "metric",
                       F.col("value").cast("decimal(38,6)").alias("value"), "unit",
                       F.col("as_of").cast("date").alias("as_of"), "dim", "label")


def report_cube(spark: SparkSession, sf_dir: str, persist: bool = True) -> DataFrame:
    """The measure cube of both marts (one scan each, once per session)."""
    from ..session import shared
    if persist:
        return shared(spark, ("cells", sf_dir), lambda: _build_cube(spark, sf_dir, True))
    return _build_cube(spark, sf_dir, False)


def snapshot_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and filtered totals of both marts at every snapshot of their tables, not only those that the report
    binds to (one scan of each table, once per session)."""
    from ..operators.cube import measure_cube
    from ..session import shared

    def build():
        cells = None
        for t, df in marts(spark, sf_dir).items():
            c = measure_cube(df, t, "as_of", [], MART_DIMS[t])
            cells = c if cells is None else cells.unionByName(c)
        return materialize(cells, "snapshot-cells")
    return shared(spark, ("snapshot_cells", sf_dir), build)


MART_DATE = {"orders": "o_orderdate", "lineitem": "l_shipdate"}


def needed_snapshots(spark: SparkSession, sf_dir: str):
    """Quarter snapshots any printed figure can bind to (within the snapshot
    window of its date). Report-sized: a handful of dates."""
    import datetime as dt
    from ..sources.snapshots import SNAPSHOT_WINDOW_DAYS
    dates = [r["as_of"] for r in report_figures(spark, sf_dir).select("as_of").distinct().collect()]
    out = set()
    for d in dates:
        for k in range(-SNAPSHOT_WINDOW_DAYS, SNAPSHOT_WINDOW_DAYS + 1):
            s = d + dt.timedelta(days=k)
            if (s + dt.timedelta(days=1)).day == 1 and s.month in (3, 6, 9, 12):
                out.add(s)
    return sorted(out)


def snapshot_predicate(date_col: str, snaps) -> F.Column:
    """Rows of the given quarter snapshots as ranges on the raw date column,
    so the Parquet scan prunes row groups (a filter on the derived quarter
    end could not be pushed)."""
    import datetime as dt
    cond = F.lit(False)
    for s in snaps:
        start = dt.date(s.year, s.month - 2, 1)
        cond = cond | ((F.col(date_col) >= F.lit(start).cast("timestamp"))
                       & (F.col(date_col) < F.lit(s + dt.timedelta(days=1)).cast("timestamp")))
    return cond


def _build_cube(spark: SparkSession, sf_dir: str, persist: bool) -> DataFrame:
    from ..operators.cube import measure_cube
    cells = None
    snaps = needed_snapshots(spark, sf_dir)
    for t, df in marts(spark, sf_dir, snaps).items():
        c = measure_cube(df, t, "as_of", MART_DIMS[t], MART_DIMS[t])
        cells = c if cells is None else cells.unionByName(c)
    return materialize(cells, "cells") if persist else cells


def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String columns of each mart in binding order: own columns first
    (hop 0), then one-hop joined columns (hop 1), schema order within."""
    from pyspark.sql import types as T
    rows = []
    for t, df in marts(spark, sf_dir).items():
        for i, f in enumerate(df.schema.fields):
            if isinstance(f.dataType, T.StringType):
                rows.append((t, f.name, 1 if f.name in JOINED_COLUMNS.get(t, []) else 0, i))
    return spark.createDataFrame(rows, "table string, column string, hop int, ordinal int")
