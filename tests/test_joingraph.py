"""Join graph, samples, similarity join, groups, publication, snapshots: small cases with known results."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from figureproof.functions import naming as NM
from figureproof.operators import contradictions as CO
from figureproof.operators import joingraph as JG
from figureproof.operators import profile as P
from figureproof.operators import simjoin as SJ
from figureproof.plans import naming_queries as NQ
from figureproof.sinks import json_files as J
from figureproof.sources import snapshots as SN


@pytest.fixture
def tabs(spark):
    return {
        "sale": spark.createDataFrame([(1, 10, 5.0, "a"), (2, 10, 7.0, "b"), (3, 11, 1.0, "a"), (4, None, 2.0, "b")], "s_id long, s_shopkey long, amount double, kind string"),
        "shop": spark.createDataFrame([(10, 1, "north"), (11, 2, "south"), (12, 2, "south")], "p_shopkey long, p_areakey int, side string"),
        "area": spark.createDataFrame([(1, "hill"), (2, "sea")], "a_areakey int, land string"),
        "visit": spark.createDataFrame([(10, 3), (10, 4)], "v_shopkey long, people int")}


def test_paths_lead_over_unique_keys_only(spark, tabs):
    got = {(r.fact, r.target): [(p.t1, p.c1, p.t2, p.c2) for p in r.path] for r in JG.paths(JG.proven_edges(spark, tabs)).collect()}
    shop = ("sale", "s_shopkey", "shop", "p_shopkey")
    area = ("shop", "p_areakey", "area", "a_areakey")
    assert got == {("sale", "shop"): [shop], ("sale", "area"): [shop, area], ("shop", "area"): [area],
                   ("visit", "shop"): [("visit", "v_shopkey", "shop", "p_shopkey")],
                   ("visit", "area"): [("visit", "v_shopkey", "shop", "p_shopkey"), area]}


def test_cube_over_chained_tables_multiplies_no_row(spark, tabs):
    cells = {(r.table, r.dim_table, r.column, r.hops, r.dim_value, r.measure): (float(r.s), r.n) for r in JG.graph_cube(spark, tabs, {}).collect()}
    assert cells["sale", None, None, None, None, "amount"] == (15.0, 4)
    assert cells["sale", "sale", "kind", 0, "a", "amount"] == (6.0, 2)
    assert cells["sale", "shop", "side", 1, "north", "amount"] == (12.0, 2) and cells["sale", "shop", "side", 1, "south", "amount"] == (1.0, 1)
    assert cells["sale", "area", "land", 2, "sea", "*"] == (1.0, 1)
    assert cells["visit", "area", "land", 2, "hill", "people"] == (7.0, 2)


def test_samples_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 10**6), rng.choice("abc"), None, float(i % 7)) for i in range(3000)] + [(5, None, None, None)] * 2000
    df = spark.createDataFrame(rows, "i long, s string, n string, d double")
    one = {r.column: r.samples for r in P.samples(df.repartition(1), "t").collect()}
    many = {r.column: r.samples for r in P.samples(df.repartition(13, "d"), "t").collect()}
    assert one == many and sorted(one["s"]) == ["a", "b", "c"] and len(one["i"]) == len(one["d"]) == 5 and "n" not in one
    import hashlib
    place = lambda v: int(hashlib.md5(v.encode()).hexdigest()[:15], 16)
    assert one["i"] == sorted({str(r[0]) for r in rows}, key=place)[:5]


def test_dice_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    sets = [(k, sorted(rng.sample("abcdefghijkl", rng.randint(1, 7)))) for k in range(60)]
    df = spark.createDataFrame(sets, "id long, toks array<string>")
    left = df.select(F.col("id").alias("l"), "toks")
    right = df.select(F.col("id").alias("r"), "toks")
    for floor in (0.2, 0.5, 0.85, 1.0):
        got = {tuple(r) for r in SJ.dice_pairs(left, right, "l", "r", floor).collect()}
        assert got == {(a, b) for a, x in sets for b, y in sets if 2 * len({*x} & {*y}) / (len(x) + len(y)) >= floor - 1e-12}


def test_names_without_a_common_word_are_compared(spark):
    names = spark.createDataFrame([("Pay",), ("Gain",), ("Net Fee",), ("Order Value",)], "name string")
    idents = spark.createDataFrame([("c.p_ya", None), ("pnl_gn", None), ("usr_fe_amt", None), ("o.val_ord", "value of an order"), ("zz", None)],
                                   "ident string, description string")
    got = {(r.name, r.ident): round(r.sim, 6) for r in NQ.similar(names, idents, 0.15).collect()}
    every = names.crossJoin(idents).select("name", "ident", NM.similarity(F.col("name"), F.col("ident"), F.col("description")).alias("sim")).collect()
    assert got == {(r.name, r.ident): round(r.sim, 6) for r in every if r.sim >= 0.15}
    assert {("Pay", "c.p_ya"), ("Gain", "pnl_gn"), ("Net Fee", "usr_fe_amt")} <= set(got)


def test_groups_of_a_long_chain_and_a_hub(spark):
    links = [(f"c{i:02}", f"c{i + 1:02}") for i in range(20)] + [("hub", f"leaf{i}") for i in range(30)]
    nodes = sorted({n for link in links for n in link} | {"alone"})
    got = {r.n: r.root for r in SJ.groups(spark.createDataFrame(links, "a string, b string"), spark.createDataFrame([(n,) for n in nodes], "n string"), "n").collect()}
    assert got == {n: "c00" if n.startswith("c") else "alone" if n == "alone" else "hub" for n in nodes}


def test_contradictions_between_policies_and_a_field(spark):
    rows = [("Metric Definitions Total Credit Exposure", "gross", "policy_2019.md", "January 1, 2019", "brd_draft", "SUM(A)"),
            ("Total Credit Exposure", "net of collateral", "policy_2024.md", "May 1, 2024", "brd_approved", "A - B"),
            ("total credit exposure", "SUM(exp)", "risk.twb", None, "tableau_calc", "SUM(A)"),
            ("Credit Exposure, Total", "unclear", "notes.md", None, "brd_draft", None),
            ("Losses", "SUM(loss)", "risk.twb", None, "tableau_calc", "SUM(A)"), ("Losses", "all", "policy_2019.md", None, "brd_draft", "SUM(A)")]
    st = spark.createDataFrame(rows, "metric_name string, definition string, source string, source_date string, source_type string, structure string")
    found = spark.createDataFrame([("Total Credit Exposure", "SUM(T.EXP) - SUM(T.COLL)", "CONFIRMED")], "metric string, key string, band string")
    got = sorted(CO.find(st, found).collect(), key=lambda r: (r.trust_rank, r.source))
    assert [(r.source, r.trust_rank) for r in got] == [("policy_2024.md", 1), ("risk.twb", 2), ("notes.md", 3), ("policy_2019.md", 3)]
    assert {r.metric for r in got} == {"total credit exposure"} and {r.structures for r in got} == {"A - B, SUM(A)"}
    assert {(r.empirical_key, r.empirical_band) for r in got} == {("SUM(T.EXP) - SUM(T.COLL)", "CONFIRMED")}


def test_publication_in_order_and_in_one_step(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.range(500).select((F.col("id") % 50).alias("t"), F.rand(3).alias("trust"), F.col("id").alias("n")).repartition(7)
    first = J.publish(spark, root, {"a": (df, ["t", "trust desc"])})
    assert J.current(spark, root) == first
    rows = []
    for f in sorted(x for x in os.listdir(f"{first}/a") if x.startswith("part-")):
        rows += [json.loads(line) for line in open(f"{first}/a/{f}")]
    assert len(rows) == 500 and rows == sorted(rows, key=lambda r: (r["t"], -r["trust"]))
    # a writer that dies leaves the old publication in place
    broken = df.select(F.raise_error(F.lit("dead")).alias("x"))
    with pytest.raises(Exception):
        J.publish(spark, root, {"a": (df, ["t"]), "b": (broken, ["x"])})
    assert J.current(spark, root) == first and J.read(spark, root, "a", df).count() == 500
    second = J.publish(spark, root, {"a": (df.limit(3), ["t"])})
    assert J.current(spark, root) == second != first and J.read(spark, root, "a", df).count() == 3


def test_late_commit_of_an_older_date_wins_and_partitions_are_pruned(spark, tmp_path):
    folder = str(tmp_path / "t")
    day = lambda d: F.lit(d).cast("date")
    SN.commit(spark.range(5).withColumn("as_of", day("2024-03-31")).unionByName(spark.range(9).withColumn("as_of", day("2023-12-31"))), folder)
    SN.commit(spark.range(2).withColumn("as_of", day("2024-03-30")), folder)
    log = spark.createDataFrame([("t", 1, "2023-12-31", 1), ("t", 2, "2024-03-31", 2), ("t", 3, "2024-03-30", 3)],
                                "table string, snapshot_id long, as_of string, seq long").withColumn("as_of", F.to_date("as_of"))
    ask = spark.createDataFrame([("t", "2024-03-31"), ("t", "2024-06-30")], "table string, as_of string").withColumn("as_of", F.to_date("as_of"))
    rows = SN.read_as_of(spark.read.parquet(folder), ask, log, "t")
    assert [(str(r.requested), str(r.as_of)) for r in rows.collect()] == [("2024-03-31", "2024-03-30")] * 2
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString().lower()
    missing = SN.resolve(ask, log).where("error IS NOT NULL").collect()
    assert [str(r.requested) for r in missing] == ["2024-06-30"]


def test_cube_sums_are_those_of_the_decimals(spark):
    from decimal import Decimal
    from figureproof.operators.cube import measure_cube
    rng = random.Random(3)
    odd = [0.00005, -0.00005, 1.00005, 2.675, 0.1 + 0.2, 123456789.12345, 9e10, 9007199254740993.0, -9999999999999998.0, 1e-9, None, -0.0, 4503599627370497.5]
    rows = [(rng.choice("ab"), rng.choice(odd + [round(rng.uniform(-1e7, 1e7), 2), rng.uniform(-1e6, 1e6)]), rng.choice([None, 1, -7, 10**15, -(10**16) + 1, 2**33]),
             rng.choice([None, -3, 2**31 - 1]), Decimal(rng.randint(-10**9, 10**9)).scaleb(-3), float(rng.randint(-9, 9)) / 8) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, d double, l long, i int, m decimal(18,3), f float").withColumn("as_of", F.lit("2024-03-31").cast("date"))
    cube = measure_cube(df, "t", "as_of", ["g"])
    got = {(r.dim_value, r.measure): (r.s, r.n) for r in cube.collect()}
    for m in ("d", "l", "i", "m", "f"):
        sums = df.groupBy("g").agg(F.sum(F.col(m).cast("decimal(20,4)")).alias("s"), F.count(m).alias("n")).collect()
        for r in sums:
            assert got[r.g, m] == (r.s, r.n)
    # no decimal is cast once per grouping set
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert "decimal(20,4)" not in " ".join(x for x in plan.splitlines() if "partial_sum" in x)
