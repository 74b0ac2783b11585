"""Statement classes, aggregate calls, dimensions and joins on statements written by hand."""

import pytest
from pyspark.sql import functions as F

from figureproof.functions import sqltext as Q
from figureproof.operators import querylog as L
from figureproof.operators import trust as TR

CATALOG = [("sales", "amount", "number"), ("sales", "tax", "number"), ("sales", "shop_id", "number"), ("sales", "sold_at", "time"),
           ("sales", "region", "string"), ("shops", "shop_id", "number"), ("shops", "region_id", "number"), ("shops", "name", "string")]


def classes(spark, sqls):
    df = spark.createDataFrame([(s,) for s in sqls], "sql string")
    return [r[0] for r in df.select(Q.classify("sql")).collect()]


def test_classes(spark):
    analytical = ["SELECT SUM(a * b) FROM t", "SELECT STDDEV(a) FROM t", "SELECT SUM(COALESCE(a, 0)) FROM t",
                  "select count (*) from t", "SELECT x FROM (SELECT max(a) AS x FROM t UNION SELECT 1) q",
                  "WITH c AS (SELECT SUM(a) AS s FROM t) SELECT s FROM c"]
    structural = ["SELECT SUM(a) FROM t UNION SELECT SUM(b) FROM u", "INSERT INTO t VALUES (1)", "CREATE TABLE t (a int)"]
    noise = ["SELECT a FROM t", "SELECT 'sum(' FROM t", "", "SELECT SUM(a FROM t", "SELECT 'open FROM t", "SELECT summary(a) FROM t"]
    assert classes(spark, analytical) == ["analytical"] * len(analytical)
    assert classes(spark, structural) == ["structural"] * len(structural)
    assert classes(spark, noise) == ["noise"] * len(noise)


def shapes_of(spark, sqls):
    log = spark.createDataFrame([(i, i % 3, "2024-01-01 00:00:00", s) for i, s in enumerate(sqls)],
                                "stmt_id long, user_id long, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    return L.shapes(L.statements(log)), spark.createDataFrame(CATALOG, "table string, column string, kind string")


def test_calls_with_expressions_distinct_and_filters(spark):
    shapes, cat = shapes_of(spark, [
        "SELECT SUM(s.amount - s.tax), COUNT(DISTINCT s.shop_id), COUNT(s.shop_id)\nFROM sales s\nWHERE s.region = 'group by x'\n  AND s.tax > 1\nGROUP BY\n  s.region",
        "SELECT SUM(amount) FROM sales", "SELECT SUM(amount) FROM sales;SELECT SUM(nowhere) FROM sales",
        "SELECT SUM(s.amount + s.nowhere) FROM sales s", "SELECT broken( FROM sales"])
    calls = L.aggregate_calls(shapes, cat)
    got = {(r.tbl, r.col, r.agg, r.filter) for r in calls.collect()}
    where = "s.region = 'group by x' AND s.tax > 1"
    assert {(t, c, a) for t, c, a, _ in got} == {("sales", "amount", "SUM"), ("sales", "shop_id", "COUNT_DISTINCT"), ("sales", "shop_id", "COUNT")}
    assert {f for t, c, a, f in got if a == "SUM"} == {None, where}
    use = {(r.tbl, r.col, r.agg): (r.calls, r.statements, r.users) for r in L.usage_rollup(calls).collect()}
    assert use[("sales", "amount", "SUM")] == (3, 3, 3) and use[("sales", "shop_id", "COUNT")] == (1, 1, 1)
    bundle = {(r.column, r.agg): r for r in TR.bundle(TR.log_evidence(calls)).collect()}
    assert bundle[("amount", "SUM")].filters[1] is None and len(bundle[("amount", "SUM")].filters) == 2
    assert bundle[("shop_id", "COUNT_DISTINCT")].sources == ["query_log_complex"]
    assert bundle[("amount", "SUM")].sources == ["query_log_complex", "query_log_simple"]


def test_dimensions_of_where_and_multi_line_group_by(spark):
    shapes, cat = shapes_of(spark, ["SELECT region, SUM(amount) FROM sales WHERE sold_at > '2024-01-01' AND shop_id IN (1, 2)\nGROUP BY\n  region,\n  tax\nHAVING SUM(amount) > 3"])
    got = {(r.tbl, r.col, r.is_time) for r in L.dimension_columns(shapes, cat).collect()}
    assert got == {("sales", "region", False), ("sales", "tax", False), ("sales", "sold_at", True), ("sales", "shop_id", False)}


def test_all_equalities_of_a_join(spark):
    shapes, cat = shapes_of(spark, [
        "SELECT COUNT(*) FROM sales s LEFT JOIN shops p ON p.shop_id = s.shop_id AND s.tax = p.region_id WHERE s.tax = s.amount",
        "SELECT COUNT(*) FROM sales s JOIN shops ON s.shop_id = shops.shop_id GROUP BY s.region"])
    got = {(r.from_table, r.from_column, r.to_table, r.to_column): (r.join_type, r.statements)
           for r in L.join_rollup(L.join_conditions(shapes, cat)).collect()}
    assert got == {("sales", "shop_id", "shops", "shop_id"): ("LEFT", 2), ("sales", "tax", "shops", "region_id"): ("LEFT", 1)}


def test_unparsable_statements_are_no_shapes(spark):
    shapes, _ = shapes_of(spark, ["SELECT 'open FROM t", "SELECT SUM(a FROM t", "SELECT 1"])
    assert [r.first_sql for r in shapes.collect()] == ["SELECT 1"]


def test_no_join_back_on_statements(spark):
    shapes, cat = shapes_of(spark, ["SELECT SUM(amount) FROM sales"])
    plan = L.aggregate_calls(shapes, cat)._jdf.queryExecution().executedPlan().toString()
    assert "stmt_id" not in " ".join(x for x in plan.splitlines() if "Join" in x)


def test_document_evidence(spark):
    cat = spark.createDataFrame(CATALOG, "table string, column string, kind string")
    e = spark.createDataFrame([("SUM(amount)", "excel_formula"), ("COUNT(DISTINCT shop_id)", "tableau_calc"), ("SUM(a) - SUM(b)", "x")],
                              "expression string, source string")
    got = {(r.table, r.column, r.agg, r.source) for r in TR.document_evidence(e, cat).collect()}
    assert got == {("sales", "amount", "SUM", "excel_formula"), ("sales", "shop_id", "COUNT_DISTINCT", "tableau_calc"),
                   ("shops", "shop_id", "COUNT_DISTINCT", "tableau_calc")}


def mined(spark, sql):
    """What is mined from one statement: calls with filters, dimensions, joins."""
    shapes, cat = shapes_of(spark, [sql])
    calls = sorted((r.agg, r.tbl, r.col, r.filter) for r in L.aggregate_calls(shapes, cat).collect())
    dims = sorted((r.tbl, r.col) for r in L.dimension_columns(shapes, cat).collect())
    joins = sorted((r.join_type, r.from_table, r.from_column, r.to_table, r.to_column) for r in L.join_conditions(shapes, cat).collect())
    return calls, dims, joins


SUM = ("SUM", "sales", "amount", None)


@pytest.mark.parametrize("sql, calls, dims, joins", [
    ("SELECT SUM(COALESCE(ROUND(amount), 0)) FROM sales", [SUM], [], []),
    ("SELECT SUM(amount) FROM shop.sales", [SUM], [], []),
    ('SELECT SUM(amount) FROM "sales"', [SUM], [], []),
    ('SELECT SUM(s."amount") FROM db.shop."sales" AS s', [SUM], [], []),
    ("SELECT SUM(amount) FROM (SELECT amount FROM sales) s", [SUM], [], []),
    ("SELECT SUM(s.amount) FROM (SELECT amount FROM sales) AS s", [SUM], [], []),
    ("SELECT SUM(amount) FILTER (WHERE tax = 2) FROM sales", [SUM], [("sales", "tax")], []),
    ("SELECT SUM(amount) FROM sales WHERE region = 'x limit 3' AND shop_id = 4",
     [("SUM", "sales", "amount", "region = 'x limit 3' AND shop_id = 4")], [("sales", "region"), ("sales", "shop_id")], []),
    ("WITH c AS (SELECT region, SUM(amount) AS a FROM sales WHERE tax > 1 GROUP BY region) SELECT MAX(c.a) FROM c WHERE c.region = 'n'",
     [("SUM", "sales", "amount", "tax > 1")], [("sales", "region"), ("sales", "tax")], []),
    ("WITH c AS (SELECT * FROM sales), d AS (SELECT * FROM c) SELECT COUNT(*), AVG(d.amount) FROM d",
     [("AVG", "sales", "amount", None), ("COUNT", "sales", "*", None)], [], []),
    ("SELECT SUM(amount) FROM sales s WHERE shop_id IN (SELECT shop_id FROM shops WHERE name = 'a' AND tax > 0 GROUP BY name)",
     [("SUM", "sales", "amount", "shop_id IN (SELECT shop_id FROM shops WHERE name = 'a' AND tax > 0 GROUP BY name)")],
     [("sales", "shop_id"), ("sales", "tax"), ("shops", "name"), ("shops", "shop_id")], []),
    ("SELECT x FROM (SELECT MAX(amount) AS x FROM sales WHERE tax = 1 UNION ALL SELECT MIN(region_id) FROM shops WHERE name = 'q') u",
     [("MAX", "sales", "amount", "tax = 1"), ("MIN", "shops", "region_id", "name = 'q'")], [("sales", "tax"), ("shops", "name")], []),
    ("SELECT EXTRACT(year FROM sold_at), SUM(amount) OVER (ORDER BY sold_at) FROM sales GROUP BY sold_at, EXTRACT(year FROM sold_at)",
     [SUM], [("sales", "sold_at")], []),
    ("SELECT SUM(a.amount) FROM sales a, shops b WHERE a.shop_id = b.shop_id", [("SUM", "sales", "amount", "a.shop_id = b.shop_id")],
     [("sales", "shop_id"), ("shops", "shop_id")], []),
    ("SELECT SUM(shop_id) FROM sales, shops", [], [], []),
    ("SELECT SUM(CAST(amount AS decimal(10, 2)) * 1.5) FROM sales WHERE sold_at > date '2024-01-01' - interval '3' day ORDER BY region LIMIT 3",
     [("SUM", "sales", "amount", "sold_at > date '2024-01-01' - interval '3' day")], [("sales", "sold_at")], []),
    ("SELECT COUNT(*) FROM sales s FULL OUTER JOIN shop.shops AS p ON (p.shop_id = s.shop_id AND s.tax = p.region_id + 1) WHERE s.tax = s.amount",
     [("COUNT", "sales", "*", "s.tax = s.amount")], [("sales", "amount"), ("sales", "tax")],
     [("FULL OUTER", "sales", "shop_id", "shops", "shop_id")]),
    ("SELECT SUM(t.amount) FROM shops JOIN (SELECT * FROM sales) t ON t.shop_id = shops.shop_id", [SUM], [], []),
    ("SELECT SUM(nowhere), SUM(1), COUNT(DISTINCT s.region) FROM sales s", [("COUNT_DISTINCT", "sales", "region", None)], [], []),
    ("SELECT SUM(x) FROM no_table", [], [], []),
])
def test_scopes(spark, sql, calls, dims, joins):
    assert mined(spark, sql) == (calls, dims, joins)


def test_depth_of_brackets_is_not_limited(spark):
    deep = "(" * 40 + "SELECT 1 UNION SELECT 2" + ")" * 40
    assert classes(spark, [f"SELECT SUM(a) FROM t WHERE x IN {deep}", "SELECT SUM(" + "(" * 40 + "a" + ")" * 40 + ") FROM t UNION SELECT 1"]) == [
        "analytical", "structural"]
    assert mined(spark, "SELECT SUM(" + "abs(" * 40 + "amount" + ")" * 40 + ") FROM sales")[0] == [SUM]


def test_shapes_of_repeated_and_missing_ids(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    rows = [(2, 7, t, "SELECT sum(a) FROM t WHERE b = 5; select 'x"), (1, 7, t, "SELECT sum(a) FROM t WHERE b = 3"), (1, 8, t, "SELECT sum(a) FROM t WHERE b = 1"),
            (1, 8, t, "SELECT c FROM u"), (None, 9, t, "SELECT c  FROM u"), (3, None, None, "SELECT sum(a) FROM t WHERE b = 'it''s'; SELECT c FROM u;")]
    found = L.shapes(L.statements(spark.createDataFrame(rows, "stmt_id long, user_id long, ts timestamp, text string")))
    got = {(r.first_sql, r.execution_count, r.distinct_users, r.last_executed_at, tuple(r.first_at), r["class"]) for r in found.collect()}
    assert got == {("SELECT sum(a) FROM t WHERE b = 1", 4, 2, t, (1, 0), "analytical"), ("SELECT c  FROM u", 3, 2, t, (None, 0), "noise")}
    # no text is carried along with every row
    rolled = L.shapes(L.statements(spark.range(9).selectExpr("id AS stmt_id", "id AS user_id", "timestamp_seconds(id) AS ts", "'SELECT 1' AS text")))
    assert "partial_min_by" not in rolled._jdf.queryExecution().executedPlan().toString()
