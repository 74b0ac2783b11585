"""BI workbook XML (S8) and formula translation.

One workbook per row. Each ``column`` element with a calculation gives one row
with its own caption, name and formula, joined with the worksheets that use it,
and translated to SQL: ``[col]`` -> ``col`` (quoted where it must be),
``COUNTD(x)`` -> ``COUNT(DISTINCT x)``; a formula that uses any other function,
names no column or does not pair its brackets is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Aggregate functions a formula may use.
SUPPORTED = ["SUM", "COUNT", "COUNTD", "AVG", "MIN", "MAX"]
FIELD_REF = r"\[([^\]]+)\]"
FUNCTION_CALL = r"([A-Za-z_]+)\s*\("
CONTROL_WORDS = r"(?i)\b(IF|CASE|THEN|ELSE|ELSEIF|END)\b"
# a column that SQL can name as it stands; others are quoted
PLAIN_NAME = "^[A-Za-z_][A-Za-z0-9_]*$"

# Elements of a workbook and their attributes.
COLUMN = r"(?s)(<column\b[^>]*?(?:/>|>.*?</column>))"
WORKSHEET = r"(?s)<worksheet\b([^>]*)>(.*?)</worksheet>"
COLUMN_INSTANCE = r"<column-instance\b[^>]*?\bcolumn=(\"[^\"]+\"|'[^']+')"
DEPENDENT = r"(<column\b[^>]*>)"


def _attribute(tag, name: str) -> F.Column:
    """The value of an attribute in a tag, unescaped; NULL without it."""
    both = F.regexp_extract(tag, r"(?s)\s" + name + r"\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    v = F.substring(both, F.lit(2), F.length(both) - 2)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&amp;", "&")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return F.when(both != "", v)


def _without_brackets(c) -> F.Column:
    return F.regexp_replace(c, r"^\[|\]$", "")


def calculated_fields(workbooks: DataFrame) -> DataFrame:
    """``file, pos, caption, name, formula`` of every calculated field: one element each, so
    caption, name and formula belong together; a field without a caption is called by its name."""
    sources = F.regexp_replace("xml", r"(?s)<worksheets\b.*?</worksheets>", "")
    z = workbooks.select("file", F.posexplode(F.regexp_extract_all(sources, F.lit(COLUMN), 1)).alias("pos", "e"))
    tag = F.regexp_extract("e", r"(?s)^(<column\b[^>]*>)", 1)
    calc = F.regexp_extract("e", r"(?s)(<calculation\b[^>]*>)", 1)
    f = z.select("file", "pos", _attribute(tag, "caption").alias("c"), _attribute(tag, "name").alias("name"),
                 _attribute(calc, "formula").alias("formula")).where("formula <> ''")
    return f.select("file", "pos", F.coalesce("c", _without_brackets("name")).alias("caption"), "name", "formula")


def _worksheets(workbooks: DataFrame) -> DataFrame:
    z = workbooks.select("file", F.explode(F.arrays_zip(
        F.regexp_extract_all("xml", F.lit(WORKSHEET), 1).alias("tag"),
        F.regexp_extract_all("xml", F.lit(WORKSHEET), 2).alias("body"))).alias("z"))
    return z.select("file", _attribute(F.concat(F.lit("<worksheet"), F.col("z.tag"), F.lit(">")), "name").alias("sheet"),
                    F.col("z.body").alias("body"))


def worksheet_usage(workbooks: DataFrame) -> DataFrame:
    """``file, name, worksheets`` (sorted): which sheets reference a field."""
    refs = _worksheets(workbooks).select("file", "sheet", F.explode(F.regexp_extract_all("body", F.lit(COLUMN_INSTANCE), 1)).alias("q"))
    refs = refs.withColumn("name", F.substring("q", F.lit(2), F.length("q") - 2))
    return refs.groupBy("file", "name").agg(F.array_sort(F.collect_set("sheet")).alias("worksheets"))


def shelf_roles(workbooks: DataFrame) -> DataFrame:
    """``file, sheet, name, role``: how the columns on a sheet are used (dimension or measure)."""
    e = _worksheets(workbooks).select("file", "sheet", F.explode(F.regexp_extract_all("body", F.lit(DEPENDENT), 1)).alias("e"))
    return e.select("file", "sheet", _attribute("e", "name").alias("name"), _attribute("e", "role").alias("role")).where("role IS NOT NULL")


def to_sql(formula) -> F.Column:
    """BI formula -> SQL text, NULL when rejected (an unsupported function, brackets
    that do not pair, control words, no column)."""
    f = F.col(formula) if isinstance(formula, str) else formula
    bare = F.regexp_replace(f, FIELD_REF, "c")
    funcs = F.transform(F.regexp_extract_all(bare, F.lit(FUNCTION_CALL), 1), lambda x: F.upper(x))
    ok_funcs = F.forall(funcs, lambda x: x.isin(*SUPPORTED))
    opens = F.length(bare) - F.length(F.replace(bare, F.lit("("), F.lit("")))
    closes = F.length(bare) - F.length(F.replace(bare, F.lit(")"), F.lit("")))
    brackets = F.length(f) - F.length(F.replace(f, F.lit("["), F.lit(""))) == F.length(f) - F.length(F.replace(f, F.lit("]"), F.lit("")))
    sql = F.regexp_replace(f, r"(?i)COUNTD\s*\(", "COUNT(DISTINCT ")
    sql = F.regexp_replace(sql, r"\[([A-Za-z_][A-Za-z0-9_]*)\]", "$1")
    sql = F.regexp_replace(sql, FIELD_REF, '"$1"')
    return F.when(ok_funcs & (opens == closes) & brackets & (F.size(funcs) > 0) & f.rlike(FIELD_REF)
                  & ~bare.rlike(CONTROL_WORDS), sql)


def referenced(formula) -> F.Column:
    f = F.col(formula) if isinstance(formula, str) else formula
    return F.array_distinct(F.transform(F.regexp_extract_all(f, F.lit(FIELD_REF), 1), lambda x: F.lower(x)))
