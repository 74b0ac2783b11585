"""Report pages -> figures.

Pages arrive as decoded text plus table grids (PDF decoding is outside the
engine). Extraction is row-local regex work plus joins keyed by report:
no page or report is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import parse_long_date, parse_number, raw_value

# The patterns of titles, dates and footnotes.
TITLE = r"^(?:Table\s+\d+:\s+)?(.+?)(\s+by\s+(.+?))?\s*\(([^)]*)\)\s*$"
# the heading's date; one in brackets belongs to a footnote
AS_OF = r"(?:As of|(?<!\()as of)\s+([A-Z][a-z]+\s+[0-9]{1,2},\s+[0-9]{4})"
FOOTNOTE = r"Prior quarter \(([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})\) ([^:]+): ([-0-9,.]+)"
NAMED_FOOTNOTE = (r"([A-Z][A-Za-z0-9 /&-]+?)\s+[—–-]+\s+prior quarter\s+\(as of\s+([^)]+)\):"
                  r"\s+(-?[\d,]+(?:\.\d+)?)(?:\s+(USD millions|USD billions|%))?")
CHILD_TOLERANCE = 0.005
SUMMARY_TITLE = "Key figures"


def dim_key(text) -> F.Column:
    """lower_snake of a printed dimension name."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")


def fig_id(report, metric, as_of, dim, label, value) -> F.Column:
    """P2 over extracted columns."""
    dims = F.when(dim.isNull(), F.lit("")).otherwise(F.concat_ws("=", dim, label))
    return F.substring(F.sha2(F.concat_ws("|", report, metric, as_of.cast("string"), dims,
                                          value.cast("string")), 256), 1, 16)


def report_dates(pages: DataFrame) -> DataFrame:
    """the as-of date of each report, from the first page that has one."""
    d = pages.select("report_id", "page_no",
                     parse_long_date(F.regexp_extract("text", AS_OF, 1)).alias("as_of"))
    return (d.where(F.col("as_of").isNotNull()).groupBy("report_id")
             .agg(F.min_by("as_of", "page_no").alias("as_of")))


def grid_figures(grid: DataFrame, dates: DataFrame) -> DataFrame:
    """table rows -> figures. Row 0 is the header. In a table titled
    ``metric by dim (unit)`` the ``Total`` row is the parent total and every
    other row a breakdown; in a table without ``by`` each row is a total of
    the metric named by its label."""
    g = (grid.where(F.col("row_no") > 0)
             .withColumn("t_metric", F.regexp_extract("title", TITLE, 1))
             .withColumn("t_dim", F.regexp_extract("title", TITLE, 3))
             .withColumn("unit", F.regexp_extract("title", TITLE, 4))
             .withColumn("value", parse_number("c1"))
             .join(dates, "report_id"))
    has_dim = F.col("t_dim") != ""
    is_total = F.lower(F.trim("c0")) == "total"
    metric = F.when(has_dim, F.col("t_metric")).otherwise(F.trim("c0"))
    dim = F.when(has_dim & ~is_total, dim_key("t_dim"))
    label = F.when(has_dim & ~is_total, F.trim("c0"))
    out = g.select("report_id", "page_no", "table_no", "row_no", metric.alias("metric"), dim.alias("dim"),
                   label.alias("label"), "value", "unit", "as_of",
                   (has_dim & ~is_total).alias("is_child"))
    # parent of a breakdown row: the Total row of the same table
    parent = (out.where(F.col("dim").isNull() & (F.col("table_no") > 0))
                 .select("report_id", "page_no", "table_no",
                         fig_id(F.col("report_id"), F.col("metric"), F.col("as_of"), F.col("dim"),
                                F.col("label"), F.col("value")).alias("parent_total_id")))
    return (out.join(parent, ["report_id", "page_no", "table_no"], "left")
               .withColumn("parent_total_id", F.when(F.col("is_child"), F.col("parent_total_id")))
               .drop("is_child"))


def footnote_figures(pages: DataFrame) -> DataFrame:
    """prior-quarter footnotes of either form -> earlier totals, with the
    printed unit where there is one."""
    def found(pattern, date, name, value, unit):
        groups = [F.regexp_extract_all("text", F.lit(pattern), i).alias(f"g{i}") for i in range(1, 4 + (unit is not None))]
        return F.transform(F.arrays_zip(*groups), lambda z: F.struct(
            z[f"g{date}"].alias("date"), z[f"g{name}"].alias("metric"), z[f"g{value}"].alias("value"),
            (F.nullif(z[f"g{unit}"], F.lit("")) if unit else F.lit(None).cast("string")).alias("unit")))
    both = F.concat(found(FOOTNOTE, 1, 2, 3, None), found(NAMED_FOOTNOTE, 2, 1, 3, 4))
    z = pages.select("report_id", "page_no", F.posexplode(both).alias("row_no", "z"))
    return z.select("report_id", "page_no", F.lit(10_000).alias("table_no"), "row_no",
                    F.trim("z.metric").alias("metric"), F.lit(None).cast("string").alias("dim"),
                    F.lit(None).cast("string").alias("label"), parse_number("z.value").alias("value"),
                    F.col("z.unit").alias("unit"), parse_long_date("z.date").alias("as_of"),
                    F.lit(None).cast("string").alias("parent_total_id"))


def extract(pages: DataFrame, grid: DataFrame) -> DataFrame:
    """Figures of every report; footnotes inherit the unit of their
    metric's table; duplicates by figure id keep the first (W8)."""
    dates = report_dates(pages)
    gf = grid_figures(grid, dates)
    fn = footnote_figures(pages)
    units = gf.groupBy("report_id", "metric").agg(F.min("unit").alias("m_unit"))
    fn = (fn.join(units, ["report_id", "metric"], "left")
            .withColumn("unit", F.coalesce("unit", "m_unit")).drop("m_unit"))
    allf = gf.unionByName(fn.select(*gf.columns))
    allf = allf.withColumn("figure_id", fig_id(F.col("report_id"), F.col("metric"), F.col("as_of"),
                                               F.col("dim"), F.col("label"), F.col("value")))
    w = Window.partitionBy("figure_id").orderBy("page_no", "table_no", "row_no")
    return (allf.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")
                .withColumn("raw", raw_value("value", "unit")))


def printed_forms(value) -> F.Column:
    """The forms a number may be printed in."""
    v = F.col(value) if isinstance(value, str) else value
    d = v.cast("double")
    return F.array(v.cast("decimal(38,6)").cast("string"),
                   F.regexp_replace(F.regexp_replace(v.cast("decimal(38,6)").cast("string"), r"0+$", ""), r"\.$", ""),
                   F.format_number(d, 0), F.format_number(d, 1), F.format_number(d, 2), F.format_number(d, 3))


def text_check(figs: DataFrame, page_text: DataFrame) -> DataFrame:
    """Keep figures whose printed form occurs in their report's text
    (semi-join on report, then a per-row containment test)."""
    j = figs.join(page_text.select("report_id", "page_no", "text"), ["report_id", "page_no"])
    found = F.exists(printed_forms("value"), lambda s: F.instr(F.col("text"), s) > 0)
    return j.withColumn("in_text", found).drop("text")


def consistency(figs: DataFrame, tol: float = CHILD_TOLERANCE) -> DataFrame:
    """Per parent and dimension, do the children sum to the parent
    (within tolerance on printed values)? A zero parent needs a zero sum."""
    kids = (figs.where(F.col("parent_total_id").isNotNull())
                .groupBy("report_id", "parent_total_id", "dim")
                .agg(F.sum("value").alias("children"), F.count(F.lit(1)).alias("n")))
    par = figs.select("report_id", F.col("figure_id").alias("parent_total_id"), "metric",
                      F.col("value").alias("parent"))
    j = kids.join(par, ["report_id", "parent_total_id"])
    ok = F.when(F.col("parent") == 0, F.col("children") == 0).otherwise(
        F.abs(F.col("children") - F.col("parent")) <= F.lit(tol) * F.abs(F.col("parent")))
    return j.withColumn("ok", ok)
