"""Spreadsheet cells.

Input is already-decoded cells ``file, sheet, row, col, value`` and named
ranges ``file, name, ref`` (xlsx decoding is outside the engine). Formula
cells are the values starting with ``=``; their label is the cell to the
left, else the cell above, when that cell is a non-blank non-formula (two
left self-joins on shifted coordinates); the aggregate is the first known
spreadsheet function in the formula.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spreadsheet aggregate -> SQL aggregate.
AGGREGATES = {"SUM": "SUM", "COUNT": "COUNT", "COUNTA": "COUNT", "COUNTIF": "COUNT", "COUNTIFS": "COUNT",
              "AVERAGE": "AVG", "AVERAGEIF": "AVG", "AVERAGEIFS": "AVG", "MIN": "MIN", "MAX": "MAX"}
AGG_CALL = r"(?i)\b(" + "|".join(AGGREGATES) + r")\s*\("
NAMED_CONFIDENCE = 0.3
UNGROUNDED_CONFIDENCE = 0.1


def _agg_map():
    return F.create_map(*[x for k, v in AGGREGATES.items() for x in (F.lit(k), F.lit(v))])


def column_letters(col) -> F.Column:
    """1 -> A, 26 -> Z, 27 -> AA, ... 18278 -> ZZZ (a sheet ends before)."""
    one = lambda x: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (x + 1).cast("int"), F.lit(1))
    c = F.when(col <= 26, one(col - 1))
    c = c.when(col <= 702, F.concat(one(F.floor((col - 27) / 26)), one((col - 27) % 26)))
    return c.otherwise(F.concat(one(F.floor((col - 703) / 676)), one(F.floor((col - 703) / 26) % 26), one((col - 703) % 26)))


def clean_label(c) -> F.Column:
    """Letters, digits and blanks stay; lower case, blanks as underscores: 'Order Value (mm)' -> 'order_value_mm'."""
    x = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^a-zA-Z0-9\s_]", "")
    return F.lower(F.regexp_replace(F.trim(x), r"\s+", "_"))


def formula_evidence(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """C13 formula pass: one row per formula cell with a known aggregate."""
    f = cells.where(F.col("value").startswith("="))
    plain = cells.where(~F.col("value").startswith("=") & (F.trim("value") != ""))
    left = plain.select("file", "sheet", "row", (F.col("col") + 1).alias("col"), F.col("value").alias("left"))
    above = plain.select("file", "sheet", (F.col("row") + 1).alias("row"), "col", F.col("value").alias("above"))
    j = (f.join(left, ["file", "sheet", "row", "col"], "left").join(above, ["file", "sheet", "row", "col"], "left"))
    label = F.trim(F.coalesce("left", "above"))
    agg = F.element_at(_agg_map(), F.upper(F.regexp_extract("value", AGG_CALL, 1)))
    letter = column_letters(F.col("col"))
    name = F.when(label.isNotNull(), clean_label(label)).otherwise(
        F.concat(F.col("sheet"), F.lit("_"), letter, F.col("row").cast("string")))
    base = (j.where(F.col("value").rlike(AGG_CALL))
             .select("file", "sheet", "row", "col", "value", agg.alias("agg"), name.alias("raw_name")))
    # grounding: formula words that are physical column names (J24 on a formula)
    cols = columns.select(F.lower("column").alias("word")).distinct()
    words = base.select("file", "sheet", "row", "col",
                        F.posexplode(F.regexp_extract_all(F.lower("value"), F.lit(r"\b[a-z_]+\b"), 0)).alias("p", "word"))
    nw = words.groupBy("file", "sheet", "row", "col").agg(F.count(F.lit(1)).alias("n_words"))
    m = (words.join(cols, "word").groupBy("file", "sheet", "row", "col")
              .agg(F.count(F.lit(1)).alias("n_matched"), F.min_by("word", "p").alias("first_col")))
    out = base.join(nw, ["file", "sheet", "row", "col"], "left").join(m, ["file", "sheet", "row", "col"], "left")
    expr = F.when(F.col("first_col").isNotNull(), F.concat(F.col("agg"), F.lit("("), F.col("first_col"), F.lit(")")))
    conf = F.when(F.col("first_col").isNotNull(), F.least(F.col("n_matched") / F.col("n_words"), F.lit(1.0))) \
            .otherwise(F.lit(UNGROUNDED_CONFIDENCE))
    return out.select("file", F.lit("excel_formula").alias("source_type"), "raw_name",
                      F.concat(F.lit("Excel formula: "), F.col("value"), F.lit(" (sheet: "), F.col("sheet"),
                               F.lit(")")).alias("definition"),
                      expr.alias("resolved_expression"), conf.alias("confidence"), expr.isNull().alias("ambiguous"))


def named_evidence(names: DataFrame) -> DataFrame:
    """C13 named-range pass: internal names (``_*``, ``Print*``) skipped."""
    n = names.where(~F.col("name").startswith("_") & ~F.col("name").startswith("Print"))
    return n.select("file", F.lit("excel_named").alias("source_type"), F.col("name").alias("raw_name"),
                    F.concat(F.lit("Named range: "), F.col("name")).alias("definition"),
                    F.lit(None).cast("string").alias("resolved_expression"),
                    F.lit(NAMED_CONFIDENCE).alias("confidence"), F.lit(True).alias("ambiguous"))
