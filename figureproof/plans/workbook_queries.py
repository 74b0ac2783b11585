"""A BI workbook per report edition, rendered for the metrics that the report
prints, and the query that reads it back (S8, F19, F20).

Each metric that the BI team keeps becomes a calculated field (caption = metric
name, formula in BI syntax); every workbook also carries a distinct count, a
malformed formula and one with an unsupported function. Two worksheets use
the fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import workbook as WB
from . import report as R

# The field that the BI team keeps for a metric, and the fields
# that every workbook carries besides.
BI_FIELDS = [("rpt_q1", "Order Value", "SUM([o_totalprice])"), ("rpt_q1", "Order Count", "COUNT(*)"),
             ("rpt_q1", "Shipped Quantity", "SUM([l_quantity])"), ("rpt_q1", "Line Count", "COUNT(*)"),
             ("rpt_q2", "Booked Order Value", "SUM([o_totalprice])"), ("rpt_q2", "Order Count", "COUNT(*)"),
             ("rpt_q2", "Shipped Quantity", "SUM(IF [l_returnflag] <> 'R' THEN [l_quantity] END)"),
             ("rpt_q2", "Average Unit Price", "SUM([l_extendedprice]) / SUM([l_quantity])")]
EXTRA_FIELDS = [("Distinct Customers", "COUNTD([o_custkey])"),
                ("Broken Field", "SUM([o_totalprice]"),
                ("Flagged Quantity", "SUM(IF [l_returnflag] = 'R' THEN [l_quantity] END)")]
# Fixed value: SQL text of a one- or two-term aggregate.
SQL_TERMS = (r"^(SUM|COUNT|AVG|MIN|MAX)\((DISTINCT )?([a-z0-9_]+|\*)\)"
             r"(?: ([-+/]) (SUM|COUNT|AVG|MIN|MAX)\(([a-z0-9_]+)\))?$")


def _xml_escape(c: F.Column) -> F.Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                               F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = R.report_figures(spark, sf_dir).select("report_id", "metric").distinct()
    kept = spark.createDataFrame(BI_FIELDS, "report_id string, metric string, formula string")
    fields = printed.join(kept, ["report_id", "metric"]).select("report_id", F.col("metric").alias("caption"), "formula")
    reports = fields.select("report_id").distinct()
    extra = reports.select("report_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("caption"), F.lit(f).alias("formula")) for c, f in EXTRA_FIELDS])).alias("e")) \
        .select("report_id", "e.caption", "e.formula")
    allf = fields.unionByName(extra)
    w = Window.partitionBy("report_id").orderBy("caption")
    allf = allf.withColumn("n", F.row_number().over(w))
    fx = F.concat(F.lit('<column caption="'), _xml_escape(F.col("caption")), F.lit('" name="[Calculation_'),
                  F.col("n").cast("string"), F.lit(']"><calculation class="tableau" formula="'),
                  _xml_escape(F.col("formula")), F.lit('"/></column>'))
    inst = F.concat(F.lit('<column-instance column="[Calculation_'), F.col("n").cast("string"), F.lit(']"/>'))
    # a workbook holds one field per metric of its report: bounded per group
    per = allf.groupBy("report_id").agg(
        F.array_sort(F.collect_list(F.struct("n", fx.alias("fx"), inst.alias("inst")))).alias("f"))
    xml = F.concat(
        F.lit('<workbook><datasources><datasource name="shop">'),
        F.array_join(F.transform("f", lambda s: s["fx"]), ""),
        F.lit('</datasource></datasources><worksheets><worksheet name="Summary"><datasource-dependencies>'),
        F.array_join(F.transform("f", lambda s: s["inst"]), ""),
        F.lit('</datasource-dependencies></worksheet><worksheet name="Detail"><datasource-dependencies>'),
        F.element_at(F.col("f"), 1)["inst"],
        F.lit("</datasource-dependencies></worksheet></worksheets></workbook>"))
    return per.select(F.concat(F.col("report_id"), F.lit(".twb")).alias("file"), xml.alias("xml"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    wb = workbooks(spark, sf_dir)
    cf = WB.calculated_fields(wb)
    use = WB.worksheet_usage(wb)
    out = (cf.join(use, ["file", "name"], "left")
             .withColumn("sql", WB.to_sql("formula"))
             .withColumn("refs", WB.referenced("formula")))
    # one owning table must hold every referenced column (mart catalog)
    from ..operators import profile as P
    cat = P.column_catalog(spark, R.marts(spark, sf_dir)).select("table", F.lower("column").alias("col"))
    need = out.select("file", "name", F.explode("refs").alias("col"))
    owners = (need.join(cat, "col").groupBy("file", "name", "table").agg(F.count(F.lit(1)).alias("k"))
                  .join(out.select("file", "name", F.size("refs").alias("nrefs")), ["file", "name"])
                  .where(F.col("k") == F.col("nrefs"))
                  .groupBy("file", "name").agg(F.count(F.lit(1)).alias("n_owners"), F.min("table").alias("owner")))
    g = lambda i: F.nullif(F.regexp_extract("sql", SQL_TERMS, i), F.lit(""))
    key = F.upper(F.concat(g(1), F.lit("("), F.col("owner"), F.lit("."), g(3), F.lit(")"),
                           F.coalesce(F.concat(F.lit(" "), g(4), F.lit(" "), g(5), F.lit("("), F.col("owner"),
                                               F.lit("."), g(6), F.lit(")")), F.lit(""))))
    o = out.join(owners, ["file", "name"], "left")
    # a named field is needed: the cube holds sums, counts and averages
    ok_key = (F.col("n_owners") == 1) & F.col("sql").rlike(SQL_TERMS) & g(2).isNull()
    return o.withColumn("key", F.when(ok_key, key)).withColumn("g", F.struct(
        g(1).alias("lhs_agg"), g(3).alias("lhs_col"), g(4).alias("op"), g(5).alias("rhs_agg"), g(6).alias("rhs_col")))


def bi_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select(
        "file", "caption", "formula", "sql", F.array_join(F.array_sort("refs"), ",").alias("referenced"),
        F.array_join(F.coalesce("worksheets", F.array().cast("array<string>")), ",").alias("worksheets"), "key")


def bi_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose formula is a candidate of one owning table (F20), by caption."""
    f = _fields(spark, sf_dir).where("key IS NOT NULL")
    return f.select("caption", F.col("owner").alias("table"), "g.lhs_agg", "g.lhs_col", "g.op",
                    F.when(F.col("g.op").isNotNull(), F.col("owner")).alias("rhs_table"), "g.rhs_agg", "g.rhs_col").distinct()


def oracle() -> dict[str, str]:
    from . import fingerprint_sql as FS
    marts = {"orders": ["as_of", "o_orderkey", "o_custkey", "o_totalprice", "o_totalprice_v1", "o_orderstatus",
                        "o_orderpriority", "c_mktsegment"],
             "lineitem": ["as_of", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                          "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]}
    return {"bi_formula": FS.bi_formula_sql(marts)}
