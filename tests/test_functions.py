"""Edge values of the scalar functions (tolerance, recency, bands, parsing)."""

import datetime as dt

from pyspark.sql import functions as F

from figureproof.functions import numeric as N
from figureproof.functions import sqltext as Q
from figureproof.operators import profile as P
from figureproof.operators import solve as S
from figureproof.operators import trust as TR


def test_tolerance_edge(spark):
    df = spark.createDataFrame([(1004.9, 1000.0), (1005.1, 1000.0), (0.0, 0.0), (0.1, 0.0), (None, 5.0)],
                               "c double, r double")
    got = [r[0] for r in df.select(N.within_tolerance("c", "r")).collect()]
    assert got == [True, False, True, False, False]
    err = [r[0] for r in df.select(N.relative_error("c", "r")).collect()]
    assert abs(err[0] - 0.0049) < 1e-9 and err[3] == 0.1 and err[4] is None


def test_guarded_division_and_units(spark):
    df = spark.createDataFrame([("/", 1.0, 0.0), ("-", 5.0, 2.0), ("+", 1.0, 2.0)], "op string, a double, b double")
    got = [r[0] for r in df.select(N.combine(F.col("op"), "a", "b")).collect()]
    assert got[0] is None and float(got[1]) == 3.0 and float(got[2]) == 3.0
    u = spark.createDataFrame([("11.373", "mm"), ("2.5", "bn"), ("7", "weird")], "v string, u string")
    raw = [float(r[0]) for r in u.select(N.raw_value("v", "u")).collect()]
    assert raw == [11373000.0, 2500000000.0, 7.0]


def test_parse_number_and_date(spark):
    df = spark.createDataFrame([("1,234.5",), ("-12",), ("12a",), ("March 1, 2024",)], "t string")
    nums = [r[0] for r in df.select(N.parse_number("t")).collect()]
    assert float(nums[0]) == 1234.5 and float(nums[1]) == -12 and nums[2] is None
    d = df.select(N.parse_long_date("t")).collect()
    assert d[3][0] == dt.date(2024, 3, 1) and d[0][0] is None


def test_recency_edges(spark):
    now = dt.datetime(2024, 6, 1)
    days = [0, 7, 8, 30, 31, 90, 91, 365, 366]
    df = spark.createDataFrame([(now - dt.timedelta(days=d),) for d in days] + [(None,)], "ts timestamp")
    got = [r[0] for r in df.select(TR.recency("ts", F.lit(now))).collect()]
    assert got == [1.0, 1.0, 0.8, 0.8, 0.5, 0.5, 0.2, 0.2, 0.0, 0.0]


def test_bands(spark):
    rows = [(1, 1, True), (4, 4, True), (9, 10, True), (3, 4, True), (2, 2, True), (3, 5, True), (5, 5, False)]
    df = spark.createDataFrame(rows, "s int, t int, g boolean")
    got = [r[0] for r in df.select(S.band("s", "t", "g")).collect()]
    assert got == ["WEAK", "CONFIRMED", "CONFIRMED", "PROBABLE", "PROBABLE", "REJECTED", "REJECTED"]


def test_statement_split_shape_and_class(spark):
    text = "-- header\nSELECT SUM(x) FROM t WHERE a = 'it''s' AND b = 12;\n\n;INSERT INTO t VALUES (1);SELECT * FROM t"
    df = spark.createDataFrame([(text,)], "text string")
    stmts = df.select(F.explode(Q.split_statements("text")).alias("s"))
    got = [r[0] for r in stmts.collect()]
    assert len(got) == 3 and got[0].startswith("SELECT SUM")
    cls = [r[0] for r in stmts.select(Q.classify("s")).collect()]
    assert cls == ["analytical", "structural", "noise"]
    sh = [r[0] for r in stmts.select(Q.shape("s")).collect()]
    assert sh[0] == "SELECT SUM(X) FROM T WHERE A = ? AND B = ?"


def test_roles(spark):
    df = spark.createDataFrame([("acct_num", "number"), ("is_active", "string"), ("loss_amt", "number"),
                                ("evt_dt", "string"), ("region", "string"), ("score", "number"),
                                ("flag", "boolean"), ("blob", "other")], "c string, k string")
    got = [r[0] for r in df.select(P.role(F.col("c"), F.col("k"))).collect()]
    assert got == ["identifier", "flag", "measure_input", "dimension", "dimension", "measure_input",
                   "flag", "unknown"]
