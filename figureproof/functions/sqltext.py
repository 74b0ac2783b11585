"""Statement-log text functions (S5, P11, F21) as native expressions: splitting,
classing, literal-free shapes. What is inside a statement, functions/scopes.py
finds out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns.
COMMENT_LINE = r"(?m)^\s*--[^\n]*$"
STRING_LITERAL = r"'([^']|'')*'"
NUMBER_LITERAL = r"\b[0-9]+(\.[0-9]+)?\b"
AGGREGATES = ["sum", "count", "avg", "min", "max", "median", "mode", "quantile", "percentile_cont", "percentile_disc",
              "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "corr", "covar_pop", "covar_samp",
              "any_value", "array_agg", "string_agg", "listagg", "approx_count_distinct", "count_if", "bool_and", "bool_or"]
_AGG = r"(?i)\b(" + "|".join(AGGREGATES) + ")"
AGG_NAME = _AGG + r"\s*\("
SET_OPERATION = r"(?i)\b(union|intersect|except)\b"
SELECT_START = r"(?is)^\s*(with|select)\b"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_statements(text) -> Column:
    """Drop ``--`` comment lines, split on ``;``, trim, drop blanks."""
    body = F.when(F.contains(_c(text), F.lit("--")), F.regexp_replace(_c(text), COMMENT_LINE, "")).otherwise(_c(text))
    # strip all whitespace (trim() removes only spaces)
    return F.filter(F.transform(F.split(body, ";"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r"))), lambda s: s != "")


def shape(sql) -> Column:
    """literal-stripped, whitespace-collapsed, upper-cased statement."""
    s = F.when(F.contains(_c(sql), F.lit("'")), F.regexp_replace(_c(sql), STRING_LITERAL, "?")).otherwise(_c(sql))
    s = F.regexp_replace(s, NUMBER_LITERAL, "?")
    return F.upper(F.trim(F.regexp_replace(s, r"\s+", " ")))


def shape_hash(sql) -> Column:
    return F.sha2(shape(sql), 256)


def balanced_quotes(sql) -> Column:
    stripped = F.regexp_replace(_c(sql), STRING_LITERAL, "")
    return ~F.instr(stripped, "'").cast("boolean")


def flat(sql) -> Column:
    """White space flattened to single blanks."""
    return F.trim(F.regexp_replace(_c(sql), r"\s+", " "))


def without_literals(sql) -> Column:
    return F.regexp_replace(_c(sql), STRING_LITERAL, "''")


def set_operation(sql) -> Column:
    """A UNION, INTERSECT or EXCEPT outside of all brackets: the parts between
    brackets are looked at in turn, with the depth of each."""
    parts = F.split(without_literals(sql), r"(?=[()])")
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("found"))

    def step(acc, part):
        depth = acc["depth"] + F.when(part.startswith("("), 1).when(part.startswith(")"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["found"] | ((depth == 0) & part.rlike(SET_OPERATION))).alias("found"))
    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def parsable(sql) -> Column:
    """Not blank, quotes and brackets in pairs."""
    s = without_literals(sql)
    pairs = (F.length(s) - F.length(F.replace(s, F.lit("("), F.lit("")))
             == F.length(s) - F.length(F.replace(s, F.lit(")"), F.lit(""))))
    return (F.trim(_c(sql)) != "") & balanced_quotes(sql) & pairs


def classify(sql) -> Column:
    """Noise (unparsable or blank), structural (not one SELECT, set
    operations included), analytical (any aggregate call) or noise."""
    s = _c(sql)
    return (F.when(~parsable(s), "noise")
             .when(~s.rlike(SELECT_START) | set_operation(s), "structural")
             .when(without_literals(s).rlike(AGG_NAME), "analytical")
             .otherwise("noise"))


# A candidate key ``AGG(T.C) [op AGG(T.C)] [WHERE C op 'V']``
# (F20), read as the expression before `` WHERE `` and the predicate after.
KEY_EXPR = (r"^(SUM|COUNT|AVG)\(([A-Z0-9_]+)\.([A-Z0-9_]+|\*)\)"
            r"(?: ([-+/]) (SUM|COUNT|AVG)\(([A-Z0-9_]+)\.([A-Z0-9_]+|\*)\))?$")
KEY_PRED = r"^([A-Z0-9_]+)(=|<>)'(.*)'$"
