"""Report pages rendered from the published figures, and the extraction
queries that read them back (C9, S10, F8-F13, P2, P9, W8, A13, J15, J21).

The rendered report is what a PDF decoder would hand the engine: page
text (as-of line, prior-quarter footnotes) and table grids (title, rows of
label and printed value). The oracle for the extraction is the published
report itself: a correct round trip reproduces it exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import figures as X
from ..session import materialize, shared
from . import report as R


def _printed(value: str, unit: str) -> F.Column:
    v = F.col(value).cast("double")
    return (F.when(F.col(unit) == "mm", F.format_number(v, 3))
             .when(F.col(value) == F.floor(F.col(value)), F.format_number(v, 0))
             .otherwise(F.format_number(v, 2)))


def render(figures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pages, grid)`` of every edition."""
    f = figures
    page_w = Window.partitionBy("report_id").orderBy("first_pos", "metric")
    metric_pages = (f.groupBy("report_id", "metric").agg(F.min("pos").alias("first_pos"))
                     .withColumn("page_no", F.dense_rank().over(page_w)))
    f = f.join(metric_pages.select("report_id", "metric", "page_no"), ["report_id", "metric"])
    cur = f.where(F.col("as_of") == F.col("edition_as_of"))
    totals = cur.where(F.col("dim").isNull()).select("report_id", "metric", F.col("value").alias("total"),
                                                     "unit")
    brk = cur.where(F.col("dim").isNotNull())
    dims = brk.select("report_id", "metric", "page_no", "dim", "unit").distinct()
    dims = dims.withColumn("table_no", F.dense_rank().over(
        Window.partitionBy("report_id", "metric").orderBy("dim")))
    title = F.concat(F.col("metric"), F.lit(" by "), F.col("dim"), F.lit(" ("), F.col("unit"), F.lit(")"))
    header = dims.select("report_id", "page_no", "table_no", title.alias("title"), F.lit(0).alias("row_no"),
                         F.lit("label").alias("c0"), F.lit("value").alias("c1"))
    rows = (brk.join(dims.select("report_id", "metric", "dim", "table_no"), ["report_id", "metric", "dim"])
               .withColumn("row_no", F.row_number().over(
                   Window.partitionBy("report_id", "metric", "dim").orderBy("label")))
               .select("report_id", "page_no", "table_no", title.alias("title"), "row_no",
                       F.col("label").alias("c0"), _printed("value", "unit").alias("c1")))
    n = brk.groupBy("report_id", "metric", "dim").agg(F.count(F.lit(1)).alias("n"))
    tot_rows = (dims.join(n, ["report_id", "metric", "dim"]).join(totals.drop("unit"), ["report_id", "metric"])
                    .select("report_id", "page_no", "table_no", title.alias("title"),
                            (F.col("n") + 1).alias("row_no"), F.lit("Total").alias("c0"),
                            _printed("total", "unit").alias("c1")))
    # metrics without a breakdown go to the summary table of their unit (page 0)
    plain = totals.join(dims.select("report_id", "metric").distinct(), ["report_id", "metric"], "left_anti")
    sw = Window.partitionBy("report_id", "unit").orderBy("metric")
    stitle = F.concat(F.lit(X.SUMMARY_TITLE + " ("), F.col("unit"), F.lit(")"))
    units = plain.select("report_id", "unit").distinct().withColumn(
        "table_no", F.dense_rank().over(Window.partitionBy("report_id").orderBy("unit")) * -1)
    s_head = units.select("report_id", F.lit(0).alias("page_no"), "table_no", stitle.alias("title"),
                          F.lit(0).alias("row_no"), F.lit("metric").alias("c0"), F.lit("value").alias("c1"))
    s_rows = (plain.join(units, ["report_id", "unit"])
                   .select("report_id", F.lit(0).alias("page_no"), "table_no", stitle.alias("title"),
                           F.row_number().over(sw).alias("row_no"), F.col("metric").alias("c0"),
                           _printed("total", "unit").alias("c1")))
    grid = header.unionByName(rows).unionByName(tot_rows).unionByName(s_head).unionByName(s_rows)
    # page text: the as-of line on every page, footnotes on the metric's page
    date_txt = F.date_format("edition_as_of", "MMMM d, yyyy")
    eds = f.select("report_id", "edition_as_of").distinct()
    pages_no = (metric_pages.select("report_id", "page_no")
                .unionByName(plain.select("report_id", F.lit(0).alias("page_no"))).distinct())
    head = pages_no.join(eds, "report_id").select(
        "report_id", "page_no", F.lit(0).alias("line_no"),
        F.concat(F.lit("Quarterly report as of "), date_txt).alias("line"))
    prior = (f.where(F.col("dim").isNull() & (F.col("as_of") < F.col("edition_as_of")))
              .select("report_id", "page_no", F.col("pos").alias("line_no"),
                      F.concat(F.lit("Prior quarter ("), F.date_format("as_of", "MMMM d, yyyy"), F.lit(") "),
                               F.col("metric"), F.lit(": "), _printed("value", "unit")).alias("line")))
    # the text layer of a page also carries its tables
    table_lines = grid.select("report_id", "page_no",
                              (F.lit(100_000) + (F.col("table_no") + 100) * 1000 + F.col("row_no")).alias("line_no"),
                              F.when(F.col("row_no") == 0, F.col("title"))
                               .otherwise(F.concat_ws(" ", "c0", "c1")).alias("line"))
    lines = head.unionByName(prior).unionByName(table_lines)
    # a page has a handful of lines (its footnotes): bounded per group
    pages = (lines.groupBy("report_id", "page_no")
                  .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))),
                                                lambda s: s["line"]), "\n").alias("text")))
    return pages, grid


def _extracted(spark: SparkSession, sf_dir: str):
    def build():
        pages, grid = render(R.report_figures(spark, sf_dir))
        pages = materialize(pages, "pages")
        grid = materialize(grid, "grid")
        return pages, grid, materialize(X.extract(pages, grid), "extracted")
    return shared(spark, ("extracted", sf_dir), build)


def figure_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ex = _extracted(spark, sf_dir)
    return ex.select("report_id", "metric", "dim", "label", "as_of",
                     F.round(F.col("value").cast("double"), 6).alias("value"), "unit",
                     F.col("parent_total_id").isNotNull().alias("has_parent"))


def figure_text_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _, ex = _extracted(spark, sf_dir)
    chk = X.text_check(ex.where(F.col("page_no").isNotNull()), pages)
    # summary-table figures live on page 0, footnotes on their metric page
    return (chk.groupBy("report_id")
               .agg(F.count(F.lit(1)).cast("bigint").alias("n_figures"),
                    F.count_if("in_text").cast("bigint").alias("n_in_text")))


def figure_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ex = _extracted(spark, sf_dir)
    c = X.consistency(ex)
    return c.select("report_id", "metric", "dim", F.col("n").cast("bigint").alias("n"),
                    F.round(F.col("children").cast("double"), 6).alias("children"),
                    F.round(F.col("parent").cast("double"), 6).alias("parent"), "ok")


def extraction_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published figures found among the extracted ones (same metric,
    dimension, label and date; value within 1 %)."""
    _, _, ex = _extracted(spark, sf_dir)
    pub = R.report_figures(spark, sf_dir)
    e = ex.select("report_id", "metric", "dim", "label", "as_of", F.col("value").alias("ev"))
    j = pub.join(e, [pub.report_id == e.report_id, pub.metric == e.metric, pub.dim.eqNullSafe(e.dim),
                     pub.label.eqNullSafe(e.label), pub.as_of == e.as_of], "left")
    hit = F.coalesce(F.when(pub.value == 0, e.ev == 0).otherwise(
        F.abs(e.ev - pub.value) <= F.lit(0.01) * F.abs(pub.value)), F.lit(False))
    per = j.groupBy(pub.report_id, pub.metric, pub.dim, pub.label, pub.as_of).agg(F.max(hit.cast("int")).alias("hit"))
    return (per.groupBy("report_id")
               .agg(F.count(F.lit(1)).cast("bigint").alias("published"),
                    F.sum("hit").cast("bigint").alias("found"))
               .withColumn("recall", F.round(F.col("found") / F.col("published"), 6)))


# ----------------------------------------------------------------------- oracle

def oracle(figures_ctes: str) -> dict[str, str]:
    """``figures_ctes``: the DuckDB CTE text ending with a ``figs`` CTE."""
    out = {}
    out["figure_extract"] = figures_ctes + """
SELECT DISTINCT report_id, metric, dim, label, as_of, round(value, 6) AS value, unit, dim IS NOT NULL AS has_parent
FROM figs"""
    out["figure_text_check"] = figures_ctes + """
SELECT report_id, CAST(count(*) AS BIGINT) AS n_figures, CAST(count(*) AS BIGINT) AS n_in_text
FROM (SELECT DISTINCT report_id, metric, dim, label, as_of, value FROM figs) GROUP BY report_id"""
    out["figure_consistency"] = figures_ctes + """,
kids AS (SELECT report_id, metric, dim, count(*) AS n, sum(value) AS children FROM figs
         WHERE dim IS NOT NULL GROUP BY ALL),
par AS (SELECT report_id, metric, value AS parent FROM figs WHERE dim IS NULL AND as_of = edition_as_of)
SELECT k.report_id, k.metric, k.dim, CAST(k.n AS BIGINT) AS n, round(k.children, 6) AS children,
       round(p.parent, 6) AS parent,
       CASE WHEN p.parent = 0 THEN k.children = 0
            ELSE abs(k.children - p.parent) <= 0.005 * abs(p.parent) END AS ok
FROM kids k JOIN par p USING (report_id, metric)"""
    out["extraction_recall"] = figures_ctes + """
SELECT report_id, CAST(count(*) AS BIGINT) AS published, CAST(count(*) AS BIGINT) AS found, 1.0 AS recall
FROM figs GROUP BY report_id"""
    return out


# The cross-check cell every workbook carries (names real columns).
CROSS_CHECK_LABEL = "Filled order value (check)"
CROSS_CHECK_FORMULA = '=AVERAGEIF(o_orderstatus,"F",o_totalprice)'
INTERNAL_NAMES = ["_xlnm.Print_Area", "Print_Titles"]


def workbook_cells(spark: SparkSession, sf_dir: str):
    """The report tables as spreadsheet cells (one sheet per table; the
    Total row is a SUM formula over the rows above) plus named ranges."""
    _, grid, _ = _extracted(spark, sf_dir)
    g = grid.where(F.col("table_no") > 0)
    sheet = F.concat(F.col("report_id"), F.lit("_p"), F.col("page_no").cast("string"), F.lit("_t"),
                     F.col("table_no").cast("string"))
    n = g.groupBy("report_id", "page_no", "table_no").agg(F.max("row_no").alias("last"))
    gg = g.join(n, ["report_id", "page_no", "table_no"])
    file = F.concat(F.col("report_id"), F.lit(".xlsx"))
    labels = gg.select(file.alias("file"), sheet.alias("sheet"), (F.col("row_no") + 1).alias("row"),
                       F.lit(1).alias("col"), F.col("c0").alias("value"))
    total = F.lower("c0") == "total"
    vals = gg.select(file.alias("file"), sheet.alias("sheet"), (F.col("row_no") + 1).alias("row"),
                     F.lit(2).alias("col"),
                     F.when(total, F.concat(F.lit("=SUM(B2:B"), F.col("row_no").cast("string"), F.lit(")")))
                      .otherwise(F.col("c1")).alias("value"))
    reports = grid.select("report_id").distinct()
    check = reports.select(file.alias("file"), F.lit("checks").alias("sheet"), F.explode(F.array(
        F.struct(F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit(CROSS_CHECK_LABEL).alias("value")),
        F.struct(F.lit(1).alias("row"), F.lit(2).alias("col"), F.lit(CROSS_CHECK_FORMULA).alias("value")))).alias("c")) \
        .select("file", "sheet", "c.row", "c.col", "c.value")
    cells = labels.unionByName(vals).unionByName(check)
    tables = g.select("report_id", "page_no", "table_no", "title").distinct()
    nm = tables.select(file.alias("file"),
                       F.regexp_replace(F.regexp_extract("title", r"^(.+?) \(", 1), "[^A-Za-z0-9]+", "_").alias("name"),
                       F.concat(sheet, F.lit("!B2")).alias("ref"))
    internal = reports.select(file.alias("file"), F.explode(F.array(*[F.lit(x) for x in INTERNAL_NAMES])).alias("name"),
                              F.lit("").alias("ref"))
    return cells, nm.unionByName(internal)


def cell_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from formula cells and named ranges."""
    from ..operators import profile as Pf
    from ..sources import cells as CL
    from ..sources.tables import read_tables
    cells, names = workbook_cells(spark, sf_dir)
    cols = Pf.column_catalog(spark, read_tables(spark, sf_dir))
    ev = CL.formula_evidence(cells, cols).unionByName(CL.named_evidence(names))
    return ev.select("file", "source_type", "raw_name", "definition", "resolved_expression",
                     F.round("confidence", 6).alias("confidence"), "ambiguous")


def oracle_cells(figures_ctes: str, schema: dict) -> dict[str, str]:
    from ..sources import cells as CL
    cols = ", ".join(f"('{c}')" for t, cs in schema.items() for c, _ in cs)
    chk = CROSS_CHECK_FORMULA.replace("'", "''")
    aggmap = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CL.AGGREGATES.items())
    aggpat = CL.AGG_CALL.replace("'", "''")
    return {"cell_evidence": figures_ctes + f""",
pg AS (SELECT report_id, metric, dense_rank() OVER (PARTITION BY report_id ORDER BY min(pos), metric) AS page_no
       FROM figs GROUP BY report_id, metric),
bt AS (SELECT f.report_id, f.metric, f.dim, f.unit, p.page_no, count(*) AS n
       FROM figs f JOIN pg p USING (report_id, metric) WHERE f.dim IS NOT NULL AND f.as_of = f.edition_as_of
       GROUP BY ALL),
tb AS (SELECT *, dense_rank() OVER (PARTITION BY report_id, metric ORDER BY dim) AS table_no FROM bt),
fc AS (SELECT report_id || '.xlsx' AS file, report_id || '_p' || page_no || '_t' || table_no AS sheet,
              '=SUM(B2:B' || (n + 1) || ')' AS value, 'total' AS raw_name FROM tb
       UNION ALL SELECT DISTINCT report_id || '.xlsx', 'checks', '{chk}',
              lower(regexp_replace(trim(regexp_replace('{CROSS_CHECK_LABEL}', '[^a-zA-Z0-9\\s_]', '', 'g')), '\\s+', '_', 'g'))
       FROM figs),
cc AS (SELECT DISTINCT lower(c) AS word FROM (VALUES {cols}) v(c)),
w AS (SELECT fc.*, generate_subscripts(regexp_extract_all(lower(value), '\\b[a-z_]+\\b', 0), 1) AS p,
             unnest(regexp_extract_all(lower(value), '\\b[a-z_]+\\b', 0)) AS word FROM fc),
nw AS (SELECT file, sheet, value, count(*) AS n_words FROM w GROUP BY ALL),
m AS (SELECT file, sheet, value, count(*) AS n_matched, arg_min(word, p) AS first_col
      FROM w JOIN cc USING (word) GROUP BY ALL),
fa AS (SELECT *, CASE upper(regexp_extract(value, '{aggpat}', 1)) {aggmap} END AS agg FROM fc
       WHERE regexp_matches(value, '{aggpat}'))
SELECT fc.file, 'excel_formula' AS source_type, fc.raw_name,
       'Excel formula: ' || fc.value || ' (sheet: ' || fc.sheet || ')' AS definition,
       CASE WHEN m.first_col IS NOT NULL THEN fc.agg || '(' || m.first_col || ')' END AS resolved_expression,
       round(CASE WHEN m.first_col IS NOT NULL THEN least(m.n_matched / nw.n_words, 1.0) ELSE 0.1 END, 6) AS confidence,
       m.first_col IS NULL AS ambiguous
FROM fa fc LEFT JOIN nw USING (file, sheet, value) LEFT JOIN m USING (file, sheet, value)
UNION ALL
SELECT report_id || '.xlsx', 'excel_named', regexp_replace(metric || ' by ' || dim, '[^A-Za-z0-9]+', '_', 'g'),
       'Named range: ' || regexp_replace(metric || ' by ' || dim, '[^A-Za-z0-9]+', '_', 'g'), NULL, 0.3, TRUE
FROM tb"""}
