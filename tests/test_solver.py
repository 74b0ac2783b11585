"""Snapshot binding, label binding and the band join against brute force."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from figureproof.functions.numeric import within_tolerance
from figureproof.operators import solve as S


def test_snapshot_binding_last_in_order(spark):
    reg = spark.createDataFrame([("t", dt.date(2025, 12, 30), 1), ("t", dt.date(2025, 12, 31), 2),
                                 ("t", dt.date(2026, 3, 31), 3)], "table string, as_of date, seq int")
    dates = spark.createDataFrame([(dt.date(2025, 12, 31),), (dt.date(2026, 3, 28),), (dt.date(2026, 6, 30),)],
                                  "eval_as_of date")
    got = {r["eval_as_of"]: r["snap_as_of"] for r in S.bind_snapshots(dates, reg).collect()}
    assert got == {dt.date(2025, 12, 31): dt.date(2025, 12, 31), dt.date(2026, 3, 28): dt.date(2026, 3, 31)}


def test_label_binding_exact_embedded(spark):
    labels = spark.createDataFrame([("m", "t", dt.date(2025, 1, 1), "Internal Fraud (INT_FRD)"),
                                    ("m", "t", dt.date(2025, 1, 1), "external")],
                                   "metric string, table string, snap_as_of date, label string")
    values = spark.createDataFrame([("t", dt.date(2025, 1, 1), "evt_typ", "INT_FRD"),
                                    ("t", dt.date(2025, 1, 1), "evt_typ", "EXTERNAL"),
                                    ("t", dt.date(2025, 1, 1), "other", "X")],
                                   "table string, snap_as_of date, column string, value string")
    order = spark.createDataFrame([("t", "evt_typ", 0, 1), ("t", "other", 0, 2)],
                                  "table string, column string, hop int, ordinal int")
    got = {r["label"]: (r["column"], r["value"]) for r in S.bind_dimensions(labels, values, order).collect()}
    assert got == {"Internal Fraud (INT_FRD)": ("evt_typ", "INT_FRD"), "external": ("evt_typ", "EXTERNAL")}


def test_two_term_band_join_equals_brute_force(spark):
    rnd = random.Random(7)
    cells, targets = [], []
    d = dt.date(2025, 3, 31)
    vals = {f"c{i}": round(rnd.uniform(-500, 5000), 2) for i in range(12)}
    vals["z"] = 0.0
    for m, v in vals.items():
        cells.append(("t", d, None, None, None, None, m, v, 1))
    names = sorted(vals)
    for a, b in itertools.permutations(names, 2):
        targets.append(vals[a] - vals[b])
        targets.append(vals[a] + vals[b])
        if vals[b]:
            targets.append(vals[a] / vals[b])
    targets = rnd.sample(targets, 25) + [0.0, 1234.5]
    cdf = spark.createDataFrame(cells, "table string, as_of date, dim string, dim_value string, fcol string, "
                                       "fvalue string, measure string, s double, n long") \
               .withColumn("s", F.col("s").cast("decimal(38,4)"))
    gp = spark.createDataFrame([(f"m{i}", "t", d, t) for i, t in enumerate(targets)],
                               "metric string, table string, snap_as_of date, reported double") \
              .withColumn("reported", F.round("reported", 4).cast("decimal(38,6)")) \
              .withColumn("report_id", F.lit("r"))
    got = {(r["metric"], r["lhs_col"], r["op"], r["rhs_col"]) for r in S.two_term_hits(gp, cdf).collect()}
    rep = {r["metric"]: float(r["reported"]) for r in gp.collect()}
    brute = set()
    for mname, r in rep.items():
        for a, b in itertools.permutations(names, 2):
            for op in "+-/":
                if op == "+" and a > b:
                    continue
                va, vb = vals[a], vals[b]
                c = va + vb if op == "+" else va - vb if op == "-" else (va / vb if vb else None)
                if c is None:
                    continue
                ok = (abs(c) == 0) if r == 0 else abs(c - r) <= 0.005 * abs(r) + 1e-9
                if ok:
                    brute.add((mname, a, op, b))
    # the engine decides in DECIMAL(38,6); allow only rounding-edge differences
    assert got <= brute and len(brute - got) <= 1
    assert len(got) >= 25


def test_documentation_hits(spark):
    from figureproof.operators.drift import documentation_hits
    names = spark.createDataFrame([("Order Value",), ("Line Count",), ("Booked Order Value",)], "name string")
    docs = spark.createDataFrame([(1, "The ORDER value rose."), (2, "border value contains it"), (3, None),
                                  (4, "booked order value, order value"), (5, "line")], "doc_id long, text string")
    got = {r["name"]: r["doc_hits"] for r in documentation_hits(names, docs).collect()}
    assert got == {"Order Value": 3, "Line Count": 0, "Booked Order Value": 1}


def test_two_term_nearest_is_the_best_failing_pair(spark):
    """The rank join finds the same smallest error among failing pairs as
    brute force over all ordered pairs and operators."""
    rnd = random.Random(11)
    d = dt.date(2025, 6, 30)
    vals = {f"m{i}": round(rnd.uniform(-300, 9000), 2) for i in range(10)}
    cells = [("t", d, None, None, None, None, m, v, 1) for m, v in vals.items()]
    targets = [round(rnd.uniform(-50, 40), 3) for _ in range(15)] + [0.0]
    cdf = spark.createDataFrame(cells, "table string, as_of date, dim string, dim_value string, fcol string, "
                                       "fvalue string, measure string, s double, n long") \
               .withColumn("s", F.col("s").cast("decimal(38,4)"))
    gp = spark.createDataFrame([(f"q{i}", "t", d, t) for i, t in enumerate(targets)],
                               "metric string, table string, snap_as_of date, reported double") \
              .withColumn("reported", F.col("reported").cast("decimal(38,6)")).withColumn("report_id", F.lit("r"))
    from figureproof.functions.numeric import relative_error
    got = (S.two_term_nearest(gp, cdf).withColumn("err", relative_error("computed", "reported"))
             .groupBy("metric").agg(F.min("err").alias("e")).collect())
    got = {r["metric"]: r["e"] for r in got}
    names = sorted(vals)
    for i, r in enumerate(targets):
        best = None
        for a, b in itertools.permutations(names, 2):
            for op in "+-/":
                va, vb = vals[a], vals[b]
                if op == "/" and vb == 0:
                    continue
                c = va + vb if op == "+" else va - vb if op == "-" else va / vb
                e = abs(c) if r == 0 else abs(c - r) / abs(r)
                ok = (c == 0) if r == 0 else abs(c - r) <= 0.005 * abs(r)
                if not ok and (best is None or e < best):
                    best = e
        assert abs(got[f"q{i}"] - best) < 1e-6 * max(1.0, best), (i, r, got[f"q{i}"], best)


CELLS = ("table string, as_of date, dim string, dim_value string, fcol string, fvalue string, measure string, s double, n long")


def test_nearest_failing_pair_beside_passing_twins(spark):
    from figureproof.functions.numeric import relative_error
    d = dt.date(2025, 6, 30)
    vals = {"a": 60.0, "b": 50.0, "c": 50.0, "d": 50.0, "e": 50.0, "f": 49.0}
    cdf = spark.createDataFrame([("t", d, None, None, None, None, m, v, 1) for m, v in vals.items()], CELLS) \
               .withColumn("s", F.col("s").cast("decimal(38,4)"))
    gp = spark.createDataFrame([("r", "q", "t", d)], "report_id string, metric string, table string, snap_as_of date") \
              .withColumn("reported", F.lit(10).cast("decimal(38,6)"))
    got = (S.two_term_nearest(gp, cdf).withColumn("err", relative_error("computed", "reported"))
             .orderBy("err", "lhs_col").first())
    assert (got["lhs_col"], got["op"], got["rhs_col"], float(got["computed"])) == ("a", "-", "f", 11.0)


def test_filters_of_a_column_with_many_values(spark):
    d = dt.date(2025, 6, 30)
    rows = [("t", d, None, None, "f", f"v{i}", "m", float(i + 1), 1) for i in range(13)]
    rows += [("t", d, None, None, "f", f"v{i}", "*", None, 1) for i in range(13)]
    cdf = spark.createDataFrame(rows, CELLS).withColumn("s", F.col("s").cast("decimal(38,4)"))
    gp = spark.createDataFrame([("r", "q", "t", d)], "report_id string, metric string, table string, snap_as_of date") \
              .withColumn("reported", F.lit(10).cast("decimal(38,6)"))
    got = S.filtered_hits(gp, cdf, S.filter_columns(cdf)).collect()
    assert len(got) == 26 and {float(r["computed"]) for r in got if r["pred_op"] == "="} == {float(i + 1) for i in range(13)}


def test_label_matches_equal_all_pairs(spark):
    from difflib import SequenceMatcher
    rnd = random.Random(3)
    d = dt.date(2025, 1, 1)
    word = lambda: "".join(rnd.choice("abcdeABC ") for _ in range(rnd.randint(1, 9))).strip() or "x"
    labels = sorted({word() for _ in range(60)})
    values = sorted({word() for _ in range(60)} | {w[:-1] + "z" for w in labels if len(w) > 6} | {w[1:] for w in labels if len(w) > 7})
    ldf = spark.createDataFrame([("k", "t", d, w) for w in labels], "metric string, table string, snap_as_of date, label string")
    vdf = spark.createDataFrame([("t", d, "c", w) for w in values], "table string, snap_as_of date, column string, value string")
    got = {r["label"]: r["value"] for r in S.label_matches(ldf, vdf).collect()}
    want = {}
    for a in labels:
        best = []
        for b in values:
            x, y = a.lower(), b.lower()
            ratio = SequenceMatcher(None, x, y).ratio()
            if x == y:
                best.append((1, -1.0, b))
            elif len(b) >= 3 and y in x:
                best.append((2, -1.0, b))
            elif ratio >= 0.85:
                best.append((3, -ratio, b))
        if best:
            want[a] = min(best)[2]
    assert got == want and any(True for _ in got)


def test_sequence_ratio_equals_the_definition(spark):
    from difflib import SequenceMatcher
    from figureproof.functions.naming import seq_ratio
    rnd = random.Random(5)
    rows = [("".join(rnd.choice("abc de") for _ in range(rnd.randint(0, 18))), "".join(rnd.choice("abc de") for _ in range(rnd.randint(0, 18))))
            for _ in range(150)] + [("net exposure amount", "exposure amt net"), ("", ""), ("a", "")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", seq_ratio("a", "b").alias("r")).collect()
    assert all(abs(r["r"] - SequenceMatcher(None, r["a"], r["b"]).ratio()) < 1e-12 for r in got)


def test_repeated_reference_keys_bind_nothing(spark):
    from figureproof.operators.joins import one_hop
    fact = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "k long, v double")
    ref = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, name string")
    got = sorted((r["k"], r["v"], r["name"]) for r in one_hop(fact, ref, "k", "id", ["name"]).collect())
    assert got == [(1, 10.0, "a"), (2, 20.0, None), (3, 30.0, None)]


def test_column_letters(spark):
    from figureproof.sources.cells import column_letters
    got = [r[0] for r in spark.createDataFrame([(c,) for c in (1, 26, 27, 52, 53, 702, 703, 16384)], "c int").select(column_letters(F.col("c"))).collect()]
    assert got == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "XFD"]


def test_shared_tables_follow_their_files(spark, tmp_path):
    from figureproof.session import shared
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    read = lambda: shared(spark, ("probe", str(tmp_path)), lambda: spark.read.parquet(path).count())
    assert read() == 3 and read() == 3
    spark.range(5).write.mode("append").parquet(path)
    assert read() == 8


def test_a_registered_query_lists_its_folder_once(spark, tmp_path, monkeypatch):
    from figureproof import session
    from figureproof.plans import publish_queries, registry
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    listed, state = [], session._state
    monkeypatch.setattr(session, "_state", lambda *a: listed.append(a) or state(*a))

    def probe(spark, sf_dir):
        return [session.shared(spark, (n, sf_dir), lambda: spark.read.parquet(path).count()) for n in ("a", "b", "a")]
    monkeypatch.setattr(publish_queries, "scorecard", probe)
    query = registry.queries()["scorecard"]
    assert query(spark, str(tmp_path)) == [3, 3, 3] and len(listed) == 1
    spark.range(5).write.mode("append").parquet(path)
    assert query(spark, str(tmp_path)) == [8, 8, 8] and len(listed) == 2


WORKBOOK = """<workbook>
  <datasources><datasource name="shop">
    <column name="[C1]" datatype="real">
      <calculation class="tableau"
                   formula="SUM([Net (USD)])" />
    </column>
    <column caption="Two" name="[C2]"><calculation formula="COUNTD([shop_id])"/></column>
    <column caption="Raw" name="[raw]" />
    <column caption="Three &amp; more" name="[C3]"><calculation formula="COUNT(*)"/></column>
  </datasource></datasources>
  <worksheets>
    <worksheet name="Overview">
      <datasource-dependencies>
        <column name="[region]" role="dimension" />
        <column-instance column="[C1]" />
      </datasource-dependencies>
    </worksheet>
  </worksheets>
</workbook>"""


def test_pretty_printed_workbook(spark):
    from figureproof.sources import workbook as WB
    wb = spark.createDataFrame([("a.twb", WORKBOOK)], "file string, xml string")
    got = {r["name"]: (r["caption"], r["sql"]) for r in WB.calculated_fields(wb).withColumn("sql", WB.to_sql("formula")).collect()}
    assert got == {"[C1]": ("C1", 'SUM("Net (USD)")'), "[C2]": ("Two", "COUNT(DISTINCT shop_id)"), "[C3]": ("Three & more", None)}
    assert [(r["name"], r["worksheets"]) for r in WB.worksheet_usage(wb).collect()] == [("[C1]", ["Overview"])]
    assert [(r["sheet"], r["name"], r["role"]) for r in WB.shelf_roles(wb).collect()] == [("Overview", "[region]", "dimension")]
