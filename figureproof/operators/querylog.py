"""Query-log mining (S5, A7, A8, P11, F21-F23, J12): statements -> shapes,
aggregate calls, dimensions and joins resolved to catalog columns.

The log itself is read once: split, classed, hashed and rolled up by shape with
partial aggregation. Everything else works on the shapes, one row each, through
their first statement; counts are weighted by the executions of the shape. A
statement's scopes and their tables are arrays of its row (functions/scopes.py): a
reference takes along the tables it may mean, those of its own scope first, then
those of the scopes around it, and meets only the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scopes as SC
from ..functions import sqltext as Q
from ..session import materialize


def statements(log: DataFrame) -> DataFrame:
    """``log(stmt_id, user_id, ts, text)`` -> one row per statement with
    its position inside the text (log order = (stmt_id, pos))."""
    return (log.select("stmt_id", "user_id", "ts",
                       F.posexplode(Q.split_statements("text")).alias("pos", "sql"))
               .withColumn("class", Q.classify("sql"))
               .withColumn("shape_hash", Q.shape_hash("sql")))


def shapes(stmts: DataFrame) -> DataFrame:
    """Roll-up per literal-stripped shape of the parsable statements:
    executions, first statement in log order, distinct users, last execution.
    Whether a statement is parsable, and its class, show in its shape: both are
    found from the first statement. The rows are counted per (shape, user) first,
    in numbers alone, so no text is sorted and a hot shape is spread over its users;
    the text is fetched for the first places only."""
    # a missing id comes first
    part = stmts.groupBy("shape_hash", "user_id", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.min("stmt_id").alias("id"), F.max(F.col("stmt_id").isNull()).alias("no_id"))
    rolled = part.groupBy("shape_hash").agg(
        F.sum("n").alias("execution_count"), F.countDistinct("user_id").alias("distinct_users"), F.max("last").alias("last_executed_at"),
        F.min(F.struct(F.when(~F.col("no_id"), F.col("id")).alias("stmt_id"), "pos")).alias("first_at"))
    rolled = materialize(rolled, "shape-counts")
    at = rolled.select("shape_hash", "first_at.stmt_id", "first_at.pos").alias("f")
    same_id = F.col("s.stmt_id").eqNullSafe(F.col("f.stmt_id"))
    # the entries are found by their ids before they are split
    of_first = stmts.select("stmt_id", "pos", "sql").alias("s").join(at, same_id, "left_semi")
    said = of_first.join(at, same_id & (F.col("s.pos") == F.col("f.pos")))
    # an id may be repeated: only a statement of the shape counts
    first = materialize(said.where(Q.shape_hash("sql") == F.col("shape_hash")).groupBy("shape_hash").agg(F.min("sql").alias("first_sql")), "shape-texts")
    return (rolled.join(first, "shape_hash").where(Q.parsable("first_sql")).withColumn("class", Q.classify("first_sql"))
                  .select("shape_hash", "execution_count", "first_sql", "distinct_users", "last_executed_at", "first_at", "class"))


SHAPE = ["shape_hash", "execution_count", "distinct_users", "last_executed_at", "first_at"]


def _analytical(shape_rows: DataFrame) -> DataFrame:
    return SC.scoped(shape_rows.where("class = 'analytical'").select(*SHAPE, Q.flat("first_sql").alias("sql")))


def _around(i, scope, qual, col) -> F.Column:
    """The tables that a reference may mean, ``(level, tbl)``: level 0 are those of its own scope. A qualified one
    means the alias, or the table without one; ``*`` the first table."""
    def of(level, n):
        own = F.filter("entries", lambda e: (e["scope"] == level) & (e["seg"] == SC.segment(F.col("kws"), level, i)))
        meant = (F.when(col == "*", F.when(qual.isNull(), F.slice(own, 1, 1)).otherwise(F.filter(own, lambda e: F.coalesce(e["alias"], e["tbl"]) == qual)))
                  .when(qual.isNotNull(), F.filter(own, lambda e: F.coalesce(e["alias"], e["tbl"]) == qual)).otherwise(own))
        return F.transform(meant, lambda e: F.struct(n.alias("level"), e["tbl"].alias("tbl")))
    return F.array_distinct(F.flatten(F.transform(SC.levels(scope), of)))


def _resolve(refs: DataFrame, keys: list[str], catalog: DataFrame) -> DataFrame:
    """Rows with ``qual, col, around`` -> (tbl, kind) of the catalog, at the first level where a table has the column.

    There an unqualified name must belong to one table alone. Others are dropped. ``keys`` tell the references apart.
    """
    cat = catalog.select(F.lower("table").alias("c_tbl"), F.lower("column").alias("c_col"), "kind")
    cat = cat.unionByName(cat.select("c_tbl", F.lit("*").alias("c_col"), F.lit(None).cast("string").alias("kind")).distinct())
    x = refs.withColumn("a", F.explode("around")).select("*", "a.level", "a.tbl").drop("a", "around")
    hit = x.join(cat, (F.col("tbl") == F.col("c_tbl")) & (F.col("col") == F.col("c_col"))).drop("c_tbl", "c_col")
    w = Window.partitionBy(*keys)
    near = hit.withColumn("first", F.min("level").over(w)).where("level = first")
    one = near.withColumn("n", F.count(F.lit(1)).over(w))
    return one.where("n = 1").drop("n", "first", "level")


def aggregate_calls(shape_rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """one row per aggregate call of an analytical shape: the shape's
    counts, ``cpos, agg`` (COUNT_DISTINCT is its own), ``is_distinct, tbl, col``
    (the first column of the argument; all must resolve) and ``filter``, the
    WHERE text of the call's own SELECT (NULL without one)."""
    s = _analytical(shape_rows).withColumn("refs", SC.references())
    raw = F.col("raw")
    names = F.filter(F.transform(raw, lambda t, i: F.struct(F.lower(t).alias("fn"), i.alias("i"))), lambda x: SC.among(x["fn"], Q.AGGREGATES))
    opened = F.transform(names, lambda x: F.struct(x["fn"].alias("fn"), x["i"].alias("i"), SC._next(raw, x["i"]).alias("open")))
    calls = (s.withColumn("call", F.explode(F.filter(opened, lambda x: F.get(raw, x["open"]) == "("))).select("*", "call.fn", "call.i", "call.open").drop("call")
             .withColumn("close", F.get(F.transform(F.filter("spans", lambda b: b["open"] == F.col("open")), lambda b: b["close"]), F.lit(0)))
             .withColumn("scope", SC._innermost(F.col("scopes"), F.col("i"))).withColumn("cpos", F.col("i")))
    first = SC._next(raw, F.col("open"))
    calls = calls.withColumn("is_distinct", SC._word(raw, first) == "distinct")
    first = F.when(F.col("is_distinct"), SC._next(raw, first)).otherwise(first).cast("int")
    inside = F.filter("refs", lambda r: (r["i"] > F.col("open")) & (r["i"] < F.col("close")))
    star = F.array(F.struct(first.alias("i"), F.lit(None).cast("string").alias("qual"), F.lit("*").alias("col"), F.col("scope").alias("scope")))
    calls = (calls.withColumn("agg", F.when(F.col("is_distinct") & (F.col("fn") == "count"), "COUNT_DISTINCT").otherwise(F.upper("fn")))
             .withColumn("args", F.when(F.get(raw, first) == "*", star).otherwise(inside)).withColumn("n_refs", F.size("args"))
             .withColumn("filter", SC.clause_text(F.col("scope"), SC.segment(F.col("kws"), F.col("scope"), F.col("i")), "where")))
    keep = [*SHAPE, "filter", "cpos", "agg", "is_distinct", "n_refs"]
    refs = calls.select(*keep, "entries", "kws", "scopes", "spans", "raw", F.posexplode("args").alias("rpos", "r")).select(
        *keep, "rpos", "r.qual", "r.col", _around(F.col("r.i"), F.col("r.scope"), F.col("r.qual"), F.col("r.col")).alias("around"))
    found = _resolve(refs, ["shape_hash", "cpos", "rpos"], catalog)
    w = Window.partitionBy("shape_hash", "cpos")
    return (found.withColumn("got", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy("rpos")))
                 .where("got = n_refs AND k = 1")
                 .select(*SHAPE, "cpos", "agg", "is_distinct", "tbl", "col", "filter"))


def dimension_columns(shape_rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """columns within GROUP BY and WHERE of every SELECT of an analytical shape, those of a subquery
    there and of a FILTER's WHERE among them, with the time flag."""
    s = _analytical(shape_rows)
    raw = F.col("raw")

    def of_dimension(r):
        filtered = F.exists("spans", lambda b: (b["open"] < r["i"]) & (r["i"] < b["close"]) & (SC._word(raw, SC._next(raw, b["open"])) == "where"))
        within = F.exists(SC.levels(r["scope"]), lambda level: SC.clause(F.col("kws"), level, r["i"]).isin("where", "group"))
        return within | filtered
    refs = s.select("*", F.posexplode(F.filter(SC.references(), of_dimension)).alias("rpos", "r")).select(
        *SHAPE, "rpos", "r.qual", "r.col", _around(F.col("r.i"), F.col("r.scope"), F.col("r.qual"), F.col("r.col")).alias("around"))
    return (_resolve(refs, ["shape_hash", "rpos"], catalog)
            .select(*SHAPE, "tbl", "col", (F.col("kind") == "time").alias("is_time")).distinct())


# What may stand before and behind an equality that is a condition of its own.
BEFORE_EQUALITY = ["on", "and", "or", "not", "("]
BEHIND_EQUALITY = ["", "and", "or", ")", *SC.CLAUSES, *SC.JOIN_WORDS]


def join_conditions(shape_rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every ``a.x = b.y`` of each JOIN ... ON, both sides resolved through
    the aliases, oriented from the existing table to the introduced one."""
    s = _analytical(shape_rows)
    raw, kws = F.col("raw"), F.col("kws")

    def joined(k):
        before = F.filter(kws, lambda j: (j["scope"] == k["scope"]) & (j["i"] < k["i"]) & (j["w"] == "join"))
        behind = F.filter(kws, lambda j: (j["scope"] == k["scope"]) & (j["i"] > k["i"]))
        end = F.get(F.transform(F.filter("spans", lambda b: b["open"] == k["scope"]), lambda b: b["close"]), F.lit(0))
        return F.struct(k["i"].alias("on"), k["scope"].alias("scope"), F.get(before, F.size(before) - 1)["i"].alias("join"),
                        F.coalesce(F.get(behind, F.lit(0))["i"], end, F.size(raw)).alias("stop"))
    ons = F.filter(F.transform(F.filter("kws", lambda k: k["w"] == "on"), joined), lambda j: j["join"].isNotNull())
    e = s.withColumn("j", F.explode(ons)).select("*", "j.on", "j.scope", "j.join", "j.stop").drop("j")
    # words before JOIN, up to three of them
    p1 = SC._prev(raw, F.col("join"))
    p2 = SC._prev(raw, p1)
    p3 = SC._prev(raw, p2)
    is_join = lambda p: SC.among(F.coalesce(SC._word(raw, p), F.lit("")), SC.JOIN_WORDS)
    words = F.concat_ws(" ", F.when(is_join(p1) & is_join(p2) & is_join(p3), SC._word(raw, p3)),
                        F.when(is_join(p1) & is_join(p2), SC._word(raw, p2)), F.when(is_join(p1), SC._word(raw, p1)))
    item = SC._next(raw, F.col("join"))
    e = (e.withColumn("join_type", F.when(words == "", "INNER").otherwise(F.upper(words)))
          .withColumn("introduced", F.when(SC._is_name(F.get(raw, item)), SC.last_part(F.get(raw, item)))).where("introduced IS NOT NULL"))
    equals = F.filter(F.transform(raw, lambda t, i: F.struct(t.alias("t"), i.alias("i"), SC._prev(raw, i).alias("l"), SC._next(raw, i).alias("r"))),
                      lambda x: (x["t"] == "=") & (x["i"] > F.col("on")) & (x["i"] < F.col("stop")) & SC._is_name(F.get(raw, x["l"]))
                      & SC._is_name(F.get(raw, x["r"])) & SC.among(SC._word(raw, SC._prev(raw, x["l"])), BEFORE_EQUALITY)
                      & SC.among(F.coalesce(SC._word(raw, SC._next(raw, x["r"])), F.lit("")), BEHIND_EQUALITY))
    base = e.select("*", F.explode(equals).alias("q")).select("*", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.col("q.l").alias("i")), F.struct(F.lit("r").alias("side"), F.col("q.r").alias("i")))).alias("x"))
    t = F.get(raw, F.col("x.i"))
    named = base.withColumns({"side": F.col("x.side"), "qual": SC.qualifier(t), "col": SC.last_part(t), "at": F.col("q.i")})
    sides = named.select(*SHAPE, "at", "join_type", "introduced", "side", "qual", "col",
                         _around(F.col("x.i"), F.col("scope"), F.col("qual"), F.col("col")).alias("around"))
    both = (_resolve(sides, ["shape_hash", "at", "side"], catalog)
            .groupBy(*SHAPE, "at", "join_type", "introduced").agg(
                *[F.max(F.when(F.col("side") == x, F.col(c))).alias(x + c[0]) for x in ("l", "r") for c in ("tbl", "col")])
            .where("lt IS NOT NULL AND rt IS NOT NULL"))
    flip = F.col("rt") != F.col("introduced")
    return both.select(*SHAPE, "join_type",
                       F.when(flip, F.col("rt")).otherwise(F.col("lt")).alias("from_table"),
                       F.when(flip, F.col("rc")).otherwise(F.col("lc")).alias("from_column"),
                       F.when(flip, F.col("lt")).otherwise(F.col("rt")).alias("to_table"),
                       F.when(flip, F.col("lc")).otherwise(F.col("rc")).alias("to_column"))


def _by_shape(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and shape."""
    return rows.groupBy(*keys, *SHAPE).agg(F.count(F.lit(1)).alias("n"))


def usage_rollup(calls: DataFrame) -> DataFrame:
    """A9 (log part): per (table, column, agg): calls, statements, users."""
    return (_by_shape(calls, ["tbl", "col", "agg", "is_distinct"]).groupBy("tbl", "col", "agg", "is_distinct")
            .agg(F.sum(F.col("n") * F.col("execution_count")).alias("calls"),
                 F.sum("execution_count").alias("statements"), F.sum("distinct_users").alias("users")))


def dimension_rollup(dims: DataFrame) -> DataFrame:
    """A10: per column: shapes, statements and users it was seen with."""
    return (dims.groupBy("tbl", "col", "is_time").agg(
        F.countDistinct("shape_hash").alias("shapes"), F.sum("execution_count").alias("statements"),
        F.sum("distinct_users").alias("users")))


def join_rollup(joins: DataFrame) -> DataFrame:
    """A10: one row per join edge with the statements it was seen in; the
    join type of its first occurrence."""
    edge = ["from_table", "from_column", "to_table", "to_column"]
    per = joins.groupBy(*edge, "shape_hash", "execution_count", "first_at").agg(F.min("join_type").alias("join_type"))
    return per.groupBy(*edge).agg(F.min_by("join_type", "first_at").alias("join_type"),
                                  F.sum("execution_count").alias("statements"), F.count(F.lit(1)).alias("shapes"))
