"""Queries of the join graph: reachable tables, the cube of every table with
numbers, and the report's figures that it reproduces (A4, J1, J10, J11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import within_tolerance
from ..operators import joingraph as JG
from ..operators import solve as S
from ..session import materialize, shared
from ..sources.snapshots import quarter_end
from ..sources.tables import read_tables
from . import report as R

# The date column by which a table has quarterly snapshots.
DATED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def join_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that each table reaches over proven unique keys, with the keys."""
    p = JG.paths(JG.proven_edges(spark, read_tables(spark, sf_dir)))
    step = F.transform("path", lambda e: F.concat(e["t1"], F.lit("."), e["c1"], F.lit(" = "), e["t2"], F.lit("."), e["c2"]))
    return p.select("fact", "target", F.col("hops").cast("bigint").alias("hops"), F.array_join(step, ", ").alias("path"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, ("graph", sf_dir), lambda: materialize(JG.graph_cube(
        spark, read_tables(spark, sf_dir), {t: quarter_end(c) for t, c in DATED.items()}), "graph"))


def graph_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4/A5: all cells of all tables with numbers."""
    return _cells(spark, sf_dir).select("table", "as_of", "dim_table", "column", F.col("hops").cast("bigint").alias("hops"), "dim_value", "measure",
                                        F.round(F.col("s").cast("double"), 2).alias("s"), F.col("n").cast("bigint").alias("n"))


def graph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that reproduce a printed figure within the tolerance at the figure's snapshot, over all tables:
    breakdowns by the label, totals without one. ``joined_only``: no column of the table itself explains the figure."""
    cells = _cells(spark, sf_dir).where("as_of IS NOT NULL")
    figs = S.prepare(R.report_figures(spark, sf_dir)).select("report_id", "metric", "dim", "label", F.col("as_of").alias("eval_as_of"), F.col("raw").alias("reported"))
    snaps = S.bind_snapshots(figs, S.snapshot_registry(cells))
    at = figs.join(snaps, "eval_as_of").withColumn("key", F.coalesce(F.lower("label"), F.lit("")))
    num = cells.select("table", F.col("as_of").alias("snap_as_of"), "dim_table", "column", "hops", "measure", F.coalesce(F.lower("dim_value"), F.lit("")).alias("key"),
                       F.when(F.col("measure") == "*", F.col("n").cast("decimal(38,6)")).otherwise(F.col("s").cast("decimal(38,6)")).alias("computed"))
    hit = at.join(num, ["table", "snap_as_of", "key"]).where(within_tolerance("computed", "reported"))
    own = hit.groupBy("report_id", "metric", "dim", "label", "eval_as_of").agg((F.min(F.coalesce("hops", F.lit(0))) > 0).alias("joined_only"))
    both = hit.alias("h").join(own.alias("o"), (F.col("h.report_id") == F.col("o.report_id")) & (F.col("h.metric") == F.col("o.metric"))
                               & F.col("h.dim").eqNullSafe(F.col("o.dim")) & F.col("h.label").eqNullSafe(F.col("o.label"))
                               & (F.col("h.eval_as_of") == F.col("o.eval_as_of")))
    return both.select("h.report_id", "h.metric", "h.dim", "h.label", F.col("h.eval_as_of").alias("as_of"), "table", "dim_table", "column",
                       F.col("hops").cast("bigint").alias("hops"), "measure", "joined_only")


# ----------------------------------------------------------------------- oracle

# What the driver tables mean, written by hand: how each is joined, and the table behind each alias.
JOINS = {
    "lineitem": "lineitem f LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey"
                " LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey"
                " LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "orders": "orders f LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "customer": "customer f LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "supplier": "supplier f LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "nation": "nation f LEFT JOIN region ON n_regionkey = r_regionkey",
    "labels": "labels f LEFT JOIN documents ON f.doc_id = documents.doc_id",
}
HOPS = {("lineitem", "orders"): 1, ("lineitem", "part"): 1, ("lineitem", "supplier"): 1, ("lineitem", "customer"): 2, ("lineitem", "nation"): 2,
        ("lineitem", "region"): 3, ("orders", "customer"): 1, ("orders", "nation"): 2, ("orders", "region"): 3, ("customer", "nation"): 1,
        ("customer", "region"): 2, ("supplier", "nation"): 1, ("supplier", "region"): 2, ("nation", "region"): 1, ("labels", "documents"): 1}
STEPS = {("lineitem", "orders"): "lineitem.l_orderkey = orders.o_orderkey", ("lineitem", "part"): "lineitem.l_partkey = part.p_partkey",
         ("lineitem", "supplier"): "lineitem.l_suppkey = supplier.s_suppkey", ("orders", "customer"): "orders.o_custkey = customer.c_custkey",
         ("customer", "nation"): "customer.c_nationkey = nation.n_nationkey", ("supplier", "nation"): "supplier.s_nationkey = nation.n_nationkey",
         ("nation", "region"): "nation.n_regionkey = region.r_regionkey", ("labels", "documents"): "labels.doc_id = documents.doc_id",
         ("documents", "labels"): "documents.doc_id = labels.doc_id"}
WAYS = {("lineitem", "customer"): ["orders"], ("lineitem", "nation"): ["supplier"], ("lineitem", "region"): ["supplier", "nation"],
        ("orders", "nation"): ["customer"], ("orders", "region"): ["customer", "nation"], ("customer", "region"): ["nation"],
        ("supplier", "region"): ["nation"]}


def _cells_cte(schema: dict, number_columns: dict) -> str:
    parts = []
    for t in sorted(schema):
        if not number_columns[t]:
            continue
        src = JOINS.get(t, f"{t} f")
        date = f"CAST(date_trunc('quarter', {DATED[t]}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)" if t in DATED else "CAST(NULL AS DATE)"
        tables = [(t, 0)] + [(x, h) for (a, x), h in sorted(HOPS.items()) if a == t]
        sets = [(None, None, None, None)] + [(x, c, h, ("f" if x == t else x)) for x, h in tables for c, k in schema[x] if k == "string"]
        for x, c, h, alias in sets:
            value = f'CAST({alias}."{c}" AS VARCHAR)' if c else "CAST(NULL AS VARCHAR)"
            guard = f' WHERE (SELECT count(DISTINCT "{c}") FROM {x}) BETWEEN 2 AND {JG.MAX_VALUES}' if c else ""
            sums = ", ".join(f'sum(CAST(f."{m}" AS DECIMAL(20,4))) AS s{i}, count(f."{m}") AS n{i}' for i, m in enumerate(number_columns[t]))
            rows = " UNION ALL ".join([f"SELECT as_of, v, '{m}' AS measure, s{i} AS s, n{i} AS n FROM a" for i, m in enumerate(number_columns[t])]
                                      + ["SELECT as_of, v, '*', CAST(n AS DECIMAL(38,4)), n FROM a"])
            lit = lambda q: "CAST(NULL AS VARCHAR)" if q is None else f"'{q}'"
            parts.append(f"SELECT '{t}' AS \"table\", as_of, {lit(x)} AS dim_table, {lit(c)} AS \"column\", CAST({'NULL' if h is None else h} AS BIGINT) AS hops,"
                         f" v AS dim_value, measure, s, n FROM (WITH a AS (SELECT {date} AS as_of, {value} AS v, {sums}, count(*) AS n FROM {src}{guard} GROUP BY 1, 2)"
                         f" {rows})" + (" WHERE v IS NOT NULL" if c else ""))
    return " UNION ALL ".join(parts)


def oracle(figures_ctes: str, schema: dict, number_columns: dict) -> dict[str, str]:
    cells = _cells_cte(schema, number_columns)
    rows = []
    for (a, b) in sorted({*HOPS, ("documents", "labels")}):
        way = [a, *WAYS.get((a, b), []), b]
        rows.append(f"('{a}', '{b}', {len(way) - 1}, '{', '.join(STEPS[x, y] for x, y in zip(way, way[1:]))}')")
    return {
        "join_paths": f"SELECT fact, target, CAST(hops AS BIGINT) AS hops, path FROM (VALUES {', '.join(rows)}) v(fact, target, hops, path)",
        "graph_cube": f"""SELECT "table", as_of, dim_table, "column", hops, dim_value, measure, round(CAST(s AS DOUBLE), 2) AS s, CAST(n AS BIGINT) AS n
FROM ({cells})""",
        "graph_hits": figures_ctes + f""",
gc AS (SELECT *, CASE WHEN measure = '*' THEN CAST(n AS DECIMAL(38,6)) ELSE CAST(s AS DECIMAL(38,6)) END AS computed FROM ({cells}) WHERE as_of IS NOT NULL),
sn AS (SELECT DISTINCT "table", as_of FROM gc),
bd AS (SELECT f.as_of AS eval_as_of, s."table", max(s.as_of) AS snap FROM (SELECT DISTINCT as_of FROM figs) f JOIN sn s ON abs(datediff('day', f.as_of, s.as_of)) <= 3 GROUP BY ALL),
ht AS (SELECT f.report_id, f.metric, f.dim, f.label, f.as_of, c."table", c.dim_table, c."column", c.hops, c.measure
       FROM figs f JOIN bd b ON b.eval_as_of = f.as_of JOIN gc c ON c."table" = b."table" AND c.as_of = b.snap
         AND coalesce(lower(c.dim_value), '') = coalesce(lower(f.label), '')
       WHERE CASE WHEN f.raw = 0 THEN c.computed = 0 ELSE abs(c.computed - f.raw) <= 0.005 * abs(f.raw) END)
SELECT *, min(coalesce(hops, 0)) OVER (PARTITION BY report_id, metric, dim, label, as_of) > 0 AS joined_only FROM ht"""}
