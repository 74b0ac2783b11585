"""Scopes of logged statements: which tables each part of a statement reads.

A statement is cut into tokens once; everything else is array expressions over
them. Brackets are paired by one aggregate whose state is the stack of open
ones. A bracket that holds SELECT or WITH is a scope, the statement itself is
the outermost one (opened at -1). A word starts a clause if its innermost bracket is
that of its scope, so the FROM of EXTRACT, the WHERE of FILTER or the ORDER BY
of a window start none, and a word inside a literal or a quoted name is no word
at all. The parts of a set operation are separate segments of their scope.

Tables of a FROM are entries ``(scope, seg, alias, tbl, target)``. Subqueries and
common table expressions are entries with the scope they stand for, and are
replaced by that scope's own entries, under their alias, until only tables
are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tokens of a statement, and the words that start a clause or are never an alias.
_PART = r'(?:"[^"]*(?:""[^"]*)*"|`[^`]*`|[A-Za-z_][A-Za-z0-9_$]*)'
TOKEN = (r"(?s)'[^']*(?:''[^']*)*'|" + _PART + r"(?:\." + _PART + r")*(?:\.\*)?|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
         r"|\s+|<>|<=|>=|!=|\|\||::|.")
NAME = r"^" + _PART
CLAUSES = ["with", "select", "from", "join", "on", "using", "where", "group", "having", "qualify", "window", "order", "limit",
           "offset", "fetch", "union", "intersect", "except"]
SET_WORDS = ["union", "intersect", "except"]
JOIN_WORDS = ["left", "right", "full", "inner", "cross", "outer", "natural", "semi", "anti", "lateral"]
RESERVED = CLAUSES + JOIN_WORDS + [
    "and", "or", "not", "in", "is", "null", "like", "ilike", "between", "case", "when", "then", "else", "end", "as", "distinct", "all",
    "any", "some", "true", "false", "asc", "desc", "nulls", "first", "last", "exists", "by", "over", "partition", "rows", "range",
    "preceding", "following", "unbounded", "current", "row", "filter", "within", "cast", "interval", "date", "timestamp", "time",
    "escape", "recursive", "tablesample"]


def among(c: Column, words: list[str]) -> Column:
    """Is it one of the words? (As text: one expression to parse instead of a call per word.)"""
    return F.array_contains(F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")"), c)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _word(raw: Column, i: Column) -> Column:
    """The token at a place in lower case; NULL outside."""
    return F.lower(F.get(raw, i))


def _next(raw: Column, i: Column) -> Column:
    """Place of the next token that is no blank (white space is single blanks)."""
    return F.when(F.get(raw, i + 1) == " ", i + 2).otherwise(i + 1).cast("int")


def _prev(raw: Column, i: Column) -> Column:
    return F.when(F.get(raw, i - 1) == " ", i - 2).otherwise(i - 1).cast("int")


def _pairs(raw: Column) -> Column:
    """Spans ``(open, close)`` of all brackets, by closing."""
    ends = F.filter(F.transform(raw, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["t"].isin("(", ")"))
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<struct<open:int,close:int>>").alias("out"))

    def step(acc, x):
        n = F.size(acc["stack"])
        push = F.struct(F.concat(acc["stack"], F.array(x["i"])).alias("stack"), acc["out"].alias("out"))
        pop = F.struct(F.slice(acc["stack"], 1, F.greatest(n - 1, F.lit(0))).alias("stack"),
                       F.concat(acc["out"], F.array(F.struct(F.element_at(acc["stack"], F.greatest(n, F.lit(1))).alias("open"),
                                                             x["i"].alias("close")))).alias("out"))
        return F.when(x["t"] == "(", push).when(n > 0, pop).otherwise(acc)
    return F.aggregate(ends, start, step, lambda acc: acc["out"])


def _innermost(spans: Column, i: Column) -> Column:
    """Opening place of the innermost of ``spans`` around a place; -1 without one."""
    return F.coalesce(F.array_max(F.transform(F.filter(spans, lambda s: (s["open"] < i) & (i < s["close"])), lambda s: s["open"])), F.lit(-1))


def last_part(path: Column) -> Column:
    """The last part of a dotted name, unquoted, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, "(" + _PART + r"|\*)$", 1), '["`]', ""))


def qualifier(path: Column) -> Column:
    """The part before the last one; NULL without."""
    q = F.regexp_extract(path, "(" + _PART + r")\.(?:" + _PART + r"|\*)$", 1)
    return F.when(q != "", F.lower(F.regexp_replace(q, '["`]', "")))


def _is_name(t: Column) -> Column:
    return t.rlike(NAME) & ~among(F.lower(t), RESERVED)


def scoped(df: DataFrame, sql: str = "sql") -> DataFrame:
    """``df`` with ``raw`` (tokens), ``spans`` (brackets), ``scopes``, ``kws`` (the
    clause words: place, word, scope) and ``entries`` (the tables of each scope)."""
    raw = F.col("raw")
    x = df.withColumn("raw", F.regexp_extract_all(F.col(sql), F.lit(TOKEN), 0)).withColumn("spans", _pairs(raw))
    x = x.withColumn("scopes", F.filter("spans", lambda s: _word(raw, _next(raw, s["open"])).isin("select", "with")))
    places = F.filter(F.transform(raw, lambda t, i: F.struct(i.alias("i"), F.lower(t).alias("w"))), lambda k: among(k["w"], CLAUSES))
    x = x.withColumn("kws", F.filter(F.transform(places, lambda k: F.struct(
        k["i"].alias("i"), k["w"].alias("w"), _innermost(F.col("scopes"), k["i"]).alias("scope"),
        _innermost(F.col("spans"), k["i"]).alias("inner"))), lambda k: (k["inner"] == k["scope"])
        & ((k["w"] != "group") | (_word(raw, _next(raw, k["i"])) == "by")) & ((k["w"] != "from") | (_word(raw, _prev(raw, k["i"])) != "distinct"))))
    # where the items of a FROM begin: behind FROM and JOIN, and behind the commas of that clause
    begins = F.transform(F.filter("kws", lambda k: k["w"].isin("from", "join")), lambda k: F.struct(
        k["scope"].alias("scope"), k["i"].alias("at"), _next(raw, k["i"]).alias("p")))
    commas = F.filter(F.transform(F.filter(F.transform(raw, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda c: c["t"] == ","),
                                  lambda c: F.struct(_innermost(F.col("scopes"), c["i"]).alias("scope"), c["i"].alias("at"),
                                                     _next(raw, c["i"]).alias("p"), _innermost(F.col("spans"), c["i"]).alias("inner"))),
                      lambda c: (c["inner"] == c["scope"]) & clause(F.col("kws"), c["scope"], c["at"]).isin("from", "join"))
    starts = F.concat(begins, F.transform(commas, lambda c: F.struct(c["scope"].alias("scope"), c["at"].alias("at"), c["p"].alias("p"))))
    x = x.withColumn("starts", starts).withColumn("direct", F.array_sort(F.filter(F.transform("starts", _entry), lambda e: (
        e["tbl"].isNotNull() | e["target"].isNotNull()))))
    # the scope that a common table expression names: NAME AS (
    ctes = F.transform(F.filter("scopes", lambda s: (_word(raw, _prev(raw, s["open"])) == "as")), lambda s: F.struct(
        last_part(F.get(raw, _cte_name(raw, s["open"]))).alias("name"), s["open"].alias("open")))
    x = x.withColumn("ctes", ctes)
    named = F.transform("direct", lambda e: _let(F.filter("ctes", lambda c: (c["name"] == e["tbl"]) & (c["open"] != e["scope"])), lambda c: F.when(
        F.size(c) > 0, F.struct(e["scope"].alias("scope"), e["seg"].alias("seg"), F.coalesce(e["alias"], e["tbl"]).alias("alias"),
                                F.lit(None).cast("string").alias("tbl"), F.get(c, F.lit(0))["open"].alias("target"))).otherwise(F.struct(
            e["scope"].alias("scope"), e["seg"].alias("seg"), e["alias"].alias("alias"), e["tbl"].alias("tbl"), e["target"].alias("target")))))
    x = x.withColumn("direct", named)
    # as many rounds as there are scopes: each replaces a scope by its own entries
    entries = F.aggregate("scopes", F.col("direct"), lambda acc, _: F.array_distinct(F.flatten(F.transform(acc, lambda e: F.when(
        e["target"].isNull(), F.array(e)).otherwise(F.transform(F.filter("direct", lambda d: d["scope"] == e["target"]), lambda d: F.struct(
            e["scope"].alias("scope"), e["seg"].alias("seg"), e["alias"].alias("alias"), d["tbl"].alias("tbl"), d["target"].alias("target"))))))))
    return x.withColumn("entries", F.filter(entries, lambda e: e["tbl"].isNotNull())).drop("starts", "direct", "ctes")


def _cte_name(raw: Column, open_: Column) -> Column:
    """Place of the name in ``NAME AS (``."""
    return _prev(raw, _prev(raw, open_))


def _entry(s: Column) -> Column:
    """The table or subquery that begins at ``s.p``, with its alias."""
    raw, p = F.col("raw"), s["p"]
    close = F.get(F.transform(F.filter("spans", lambda b: b["open"] == p), lambda b: b["close"]), F.lit(0))
    sub = F.exists("scopes", lambda b: b["open"] == p)
    after = _next(raw, F.when(sub, close).otherwise(p).cast("int"))
    alias_at = F.when(_word(raw, after) == "as", _next(raw, after)).otherwise(after).cast("int")
    alias = F.when(_is_name(F.get(raw, alias_at)), last_part(F.get(raw, alias_at)))
    table = F.when(_is_name(F.get(raw, p)) & (F.coalesce(_word(raw, _next(raw, p)), F.lit("")) != "("), last_part(F.get(raw, p)))
    return F.struct(s["at"].alias("at"), s["scope"].alias("scope"), segment(F.col("kws"), s["scope"], s["at"]).alias("seg"), alias.alias("alias"),
                    F.when(~sub, table).alias("tbl"), F.when(sub, p).alias("target"))


def segment(kws: Column, scope: Column, i: Column) -> Column:
    """How many set operations of the scope stand before a place."""
    return F.size(F.filter(kws, lambda k: (k["scope"] == scope) & (k["i"] < i) & among(k["w"], SET_WORDS)))


def clause(kws: Column, scope: Column, i: Column) -> Column:
    """The clause of its scope that a place belongs to."""
    before = F.filter(kws, lambda k: (k["scope"] == scope) & (k["i"] < i))
    return F.coalesce(F.get(before, F.size(before) - 1)["w"], F.lit(""))


def clause_text(scope: Column, seg: Column, word: str) -> Column:
    """The text of a clause of a scope's segment, up to the next clause or the scope's end; NULL without one."""
    raw, kws = F.col("raw"), F.col("kws")
    own = F.filter(kws, lambda k: (k["scope"] == scope) & (k["w"] == word) & (segment(kws, scope, k["i"]) == seg))
    end = F.coalesce(F.get(F.transform(F.filter("spans", lambda s: s["open"] == scope), lambda s: s["close"]), F.lit(0)), F.size(raw))
    return _let(F.get(own, F.lit(0)), lambda k: F.when(k.isNotNull(), _let(F.coalesce(
        F.get(F.transform(F.filter(kws, lambda n: (n["scope"] == scope) & (n["i"] > k["i"])), lambda n: n["i"]), F.lit(0)), end),
        lambda stop: F.nullif(F.trim(F.array_join(F.slice(raw, k["i"] + 2, F.greatest(stop - k["i"] - 1, F.lit(0))), "")), F.lit("")))))


def references() -> Column:
    """Column references ``(i, qual, col, scope)``: names that are no table, alias, function, type or keyword."""
    raw = F.col("raw")
    at = F.filter(F.transform(raw, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: x["t"].rlike(NAME) & ~among(F.lower(x["t"]), RESERVED))

    def column(x):
        before, after = _word(raw, _prev(raw, x["i"])), _word(raw, _next(raw, x["i"]))
        return (~F.coalesce(before, F.lit("")).isin("as", "from", "join", "::") & (F.coalesce(after, F.lit("")) != "(")
                & ~F.coalesce(before, F.lit("")).rlike("^['0-9]"))
    return F.transform(F.filter(at, column), lambda x: F.struct(
        x["i"].alias("i"), qualifier(x["t"]).alias("qual"), last_part(x["t"]).alias("col"), _innermost(F.col("scopes"), x["i"]).alias("scope")))


def levels(scope: Column) -> Column:
    """The scopes around a scope, itself first, the statement last."""
    close = F.coalesce(F.get(F.transform(F.filter("scopes", lambda s: s["open"] == scope), lambda s: s["close"]), F.lit(0)), F.size("raw"))
    around = F.transform(F.filter("scopes", lambda s: (s["open"] < scope) & (s["close"] > close)), lambda s: s["open"])
    return F.array_distinct(F.concat(F.array(scope), F.reverse(F.array_sort(around)), F.array(F.lit(-1))))
