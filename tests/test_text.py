"""Prose and BI-formula helpers on small frames."""

from pyspark.sql import functions as F

from figureproof.functions import prose as PR
from figureproof.sources import workbook as WB


def test_clean_name_and_terms(spark):
    df = spark.createDataFrame([("The Credit RWA",), ("Total Exposure Total Exposure",), ("A B C",)], "n string")
    got = [r[0] for r in df.select(PR.clean_name("n")).collect()]
    assert got == ["Credit RWA", "Total Exposure", "A B C"]
    t = spark.createDataFrame([(" gross exposure, ",)], "t string")
    assert t.select(PR.clean_term("t")).first()[0] == "gross exposure"


def test_formula_patterns(spark):
    text = ("Net Exposure is calculated as gross exposure less eligible collateral held, measured daily. "
            "Risk Total represents the sum of weighted assets across entities.")
    df = spark.createDataFrame([(text,)], "text string")
    st = [r[0] for r in df.select(F.explode(F.array(*[
        F.when(F.col("text").rlike(p), F.lit(s)) for p, s in PR.FORMULA_PATTERNS]))).collect() if r[0]]
    assert st == ["A - B", "SUM(A)"]
    first = df.select(F.regexp_extract_all("text", F.lit(PR.FORMULA_PATTERNS[0][0]), 3)).first()[0]
    assert first == ["collateral held"]


def test_approval_and_dates(spark):
    df = spark.createDataFrame([("Reviewed by the board. Effective March 1, 2024",), ("draft, dated june 3, 2023",),
                                ("nothing here",)], "t string")
    rows = df.select(PR.approval("t"), PR.doc_date("t")).collect()
    assert [tuple(r) for r in rows] == [(True, "March 1, 2024"), (False, "june 3, 2023"), (False, None)]


def test_bi_formula_translation(spark):
    df = spark.createDataFrame([("SUM([Sales]) - SUM([Cost])",), ("COUNTD([cust_id])",), ("SUM([a]",),
                                ("ZN(SUM([a]))",), ("SUM(IF [x] = 1 THEN [a] END)",)], "f string")
    got = [r[0] for r in df.select(WB.to_sql("f")).collect()]
    assert got == ["SUM(Sales) - SUM(Cost)", "COUNT(DISTINCT cust_id)", None, None, None]
    refs = df.select(WB.referenced("f")).first()[0]
    assert refs == ["sales", "cost"]


def test_printed_titles_dates_and_footnotes(spark):
    import datetime as dt
    from figureproof.operators import figures as FG
    pages = spark.createDataFrame([("r", 1, "Quarterly Report\nAs of June 30, 2026\nNet Exposure — prior quarter (as of March 31, 2026): 1,234.5 USD millions\n"
                                    "Prior quarter (March 31, 2026) Order Count: 77"),
                                   ("s", 1, "Report as of June 30, 2026")], "report_id string, page_no int, text string")
    assert {r["report_id"]: r["as_of"] for r in FG.report_dates(pages).collect()} == {"r": dt.date(2026, 6, 30), "s": dt.date(2026, 6, 30)}
    grid = spark.createDataFrame([("r", 1, 1, i, "Table 3: Net Exposure by asset class (USD millions)", c, v)
                                  for i, (c, v) in enumerate([("Asset class", "Value"), ("Loans", "1.5"), ("Total", "1.5")])],
                                 "report_id string, page_no int, table_no int, row_no int, title string, c0 string, c1 string")
    got = {(r["metric"], r["dim"], r["label"], r["unit"], float(r["raw"]), r["as_of"]) for r in FG.extract(pages, grid).collect()}
    now, before = dt.date(2026, 6, 30), dt.date(2026, 3, 31)
    assert got == {("Net Exposure", "asset_class", "Loans", "USD millions", 1.5e6, now), ("Net Exposure", None, None, "USD millions", 1.5e6, now),
                   ("Net Exposure", None, None, "USD millions", 1234.5e6, before), ("Order Count", None, None, None, 77.0, before)}


def test_formulas_and_statements_of_cut_texts_are_those_of_whole_texts(spark):
    import random
    from figureproof.plans import text_queries as TQ
    rng = random.Random(9)
    bits = ["Net Exposure", "The Risk Total", " is defined as", " is  calculated\nas", " gross exposure", " less eligible", " less", " collateral held", ",", ".", ";",
            " measured before", " represents", " represent the sum of", " is the sum of", " weighted assets", " aggregates", " across", " é", "🙂", " plus", " x", "\t", " divided by",
            " during", " Total Fee", " is derived as the aggregate", "(", "-"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["Net Exposure is calculated as gross exposure less eligible collateral held, measured daily. Fee represents all that is paid.", "", None,
              "One two\nFee Total\n\nis   derived as fees plus dues.", "Fee aggregates x1 across desks"]
    df = spark.createDataFrame([(str(i), t, "document") for i, t in enumerate(texts)], "doc string, text string, kind string")
    flat = df.select("doc", PR.flatten("text").alias("flat"))
    got = {(r.doc, r.structure, r.said) for r in TQ.formulas(df).collect()}
    whole = set()
    for pat, structure in PR.FORMULA_PATTERNS:
        whole |= {(r.doc, structure, r.m.strip(" ")) for r in flat.select("doc", F.explode(F.regexp_extract_all("flat", F.lit(pat), 0)).alias("m")).collect()}
    assert {(d, s) for d, s, _ in got} == {(d, s) for d, s, _ in whole} and got <= whole and len(got) > 20
    said = sorted((r.doc, r.sentence) for r in TQ.statements(df).collect())
    every = flat.select("doc", F.explode(F.regexp_extract_all("flat", F.lit(PR.STATEMENT), 0)).alias("m")).collect()
    assert said == sorted((r.doc, r.m.strip(" ")) for r in every) and len(said) > 20
    # what states nothing does not reach the patterns
    dull = spark.createDataFrame([("Some words here, and more. " * 50 + "Fee represents all dues.",)], "flat string")
    assert dull.select(PR.stating("flat", PR.STATEMENT_END)).first()[0].strip() == "Fee represents all dues."


def test_hypotheses_mine_the_texts_once(spark):
    from figureproof.plans import naming_queries as NQ
    assert not [f for f in NQ._hypotheses(spark, "/root/testdata/sf0.001").inputFiles() if "documents" in f]


def test_printed_lines_read_the_marts_once(spark):
    from figureproof.plans import report as R
    figs = R._publish(spark, "/root/testdata/sf0.001")
    assert not [f for f in figs.inputFiles() if "lineitem" in f or "orders" in f]
    assert figs.count() == R.report_figures(spark, "/root/testdata/sf0.001").count() > 20


def test_a_formula_of_many_texts_is_spread_over_the_columns_once(spark):
    from figureproof.plans import naming_queries as NQ
    def hyp(n):
        return spark.createDataFrame([("Fee", "Fee", f"d{i}", "A / B", "extended price", "line quantity") for i in range(n)]
                                     + [("Fee", "The Fee", f"d{i}", "SUM(A)", "total price", None) for i in range(n)],
                                     "name string, hname string, doc string, structure string, term_a string, term_b string")
    one, many = (sorted(map(str, NQ.prose_terms(spark, "/root/testdata/sf0.001", hyp(n)).collect())) for n in (1, 30))
    assert many == one and len(set(one)) == len(one) > 2
