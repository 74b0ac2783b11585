"""Evidence roll-up and trust scoring.

Evidence rows are ``table, column, agg, source, executions, users,
last_seen``; the roll-up is one group-by per (table, column, agg) and the
usage normaliser is a window over the table (catalog-sized partitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Authority of each evidence source.
SOURCE_AUTHORITY = {
    "numeric_fingerprint": 0.98, "tableau_calc": 0.85, "dbt_metric": 1.00, "dbt_model": 0.85, "data_dictionary": 0.85,
    "ddl_constraint": 0.75, "looker_measure": 0.80, "tableau_field": 0.78, "brd_approved": 0.90, "brd_draft": 0.65,
    "excel_named": 0.70, "excel_formula": 0.50, "pdf_report": 0.55, "confluence_page": 0.60,
    "ddl_naming_convention": 0.45, "query_log_complex": 0.60, "query_log_simple": 0.40, "ad_hoc": 0.20,
}
# Signal weights (must sum to 1) and thresholds.
WEIGHTS = {"authority": 0.30, "usage": 0.25, "agreement": 0.20, "recency": 0.15, "certified": 0.10}
AUTO_MERGE = 0.85
DROP = 0.50
COMPLEX_MIN_KEYS = 2


def check_weights(w=WEIGHTS):
    if abs(sum(w.values()) - 1.0) > 1e-9:
        raise ValueError("trust weights must sum to 1")


EVIDENCE = ["table", "column", "agg", "source", "executions", "users", "last_seen", "filter", "first_at"]


def statement_complexity(calls: DataFrame) -> DataFrame:
    """A shape with at least two distinct aggregate keys on a table is complex for that table."""
    return (calls.groupBy("shape_hash", "tbl")
                 .agg((F.countDistinct("agg", "col") >= COMPLEX_MIN_KEYS).alias("complex")))


def log_evidence(calls: DataFrame) -> DataFrame:
    """One row per aggregate call of a shape, weighted by the shape's executions and users."""
    return (calls.join(statement_complexity(calls), ["shape_hash", "tbl"])
                 .select(F.col("tbl").alias("table"), F.col("col").alias("column"), "agg",
                         F.when(F.col("complex"), "query_log_complex").otherwise("query_log_simple").alias("source"),
                         F.col("execution_count").alias("executions"), F.col("distinct_users").alias("users"),
                         F.col("last_executed_at").alias("last_seen"), "filter", "first_at"))


def _unseen(rows: DataFrame) -> DataFrame:
    """Evidence that no execution stands behind."""
    return rows.select("table", "column", "agg", "source", F.lit(0).cast("long").alias("executions"),
                       F.lit(0).cast("long").alias("users"), F.lit(None).cast("timestamp").alias("last_seen"),
                       F.lit(None).cast("string").alias("filter"),
                       F.lit(None).cast("struct<stmt_id:bigint,pos:int>").alias("first_at"))


def role_evidence(roles: DataFrame) -> DataFrame:
    """C14: a measure-input column is evidence for SUM(column)."""
    return _unseen(roles.where(F.col("role") == "measure_input")
                   .select(F.lower("table").alias("table"), F.lower("column").alias("column"),
                           F.lit("SUM").alias("agg"), F.lit("ddl_naming_convention").alias("source")))


def document_evidence(exprs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Expressions ``AGG(column)`` read from documents and workbooks
    (``expression, source``), attached to every table that has the column."""
    pat = r"(?i)^\s*([a-z_]+)\s*\(\s*(distinct\s+)?([a-z_][a-z0-9_]*)\s*\)\s*$"
    e = exprs.select(F.upper(F.regexp_extract("expression", pat, 1)).alias("fn"),
                     F.regexp_extract("expression", pat, 2).alias("d"),
                     F.lower(F.regexp_extract("expression", pat, 3)).alias("column"), "source").where("fn <> ''")
    e = e.withColumn("agg", F.when((F.col("fn") == "COUNT") & (F.col("d") != ""), "COUNT_DISTINCT").otherwise(F.col("fn")))
    cat = catalog.select(F.lower("table").alias("table"), F.lower("column").alias("column"))
    return _unseen(e.join(cat, "column").select("table", "column", "agg", "source").distinct())


def bundle(evidence: DataFrame) -> DataFrame:
    """Per (table, column, agg): executions, users, last seen, the
    sorted set of sources, the filters of the statements behind it in log
    order (NULL for a statement without one)."""
    variants = (evidence.where("executions > 0").groupBy("table", "column", "agg", "filter").agg(F.min("first_at").alias("at"))
                .groupBy("table", "column", "agg").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "filter"))),
                                                                   lambda v: v["filter"]).alias("filters")))
    b = (evidence.groupBy("table", "column", "agg").agg(
        F.sum("executions").alias("executions"), F.sum("users").alias("users"),
        F.max("last_seen").alias("last_seen"), F.array_sort(F.collect_set("source")).alias("sources")))
    return (b.join(variants, ["table", "column", "agg"], "left")
             .withColumn("filters", F.coalesce("filters", F.array().cast("array<string>"))))


def _authority_map():
    return F.create_map(*[x for k, v in SOURCE_AUTHORITY.items() for x in (F.lit(k), F.lit(v))])


def recency(last_seen, now) -> F.Column:
    """Whole elapsed days: <=7 -> 1, <=30 -> .8, <=90 -> .5, <=365 -> .2, else 0."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(last_seen)) / 86400)
    return (F.when(F.col(last_seen).isNull() if isinstance(last_seen, str) else last_seen.isNull(), 0.0)
             .when(days <= 7, 1.0).when(days <= 30, 0.8).when(days <= 90, 0.5)
             .when(days <= 365, 0.2).otherwise(0.0))


def score(b: DataFrame, now, certified: DataFrame | None = None) -> DataFrame:
    """C11: five signals and the weighted total."""
    check_weights()
    m = _authority_map()
    w = Window.partitionBy("table")
    out = (b.withColumn("authority", F.coalesce(F.array_max(F.transform(
                "sources", lambda s: F.coalesce(F.element_at(m, s), F.lit(0.0)))), F.lit(0.0)))
            .withColumn("max_exec", F.max("executions").over(w))
            .withColumn("usage", F.when(F.col("max_exec") > 0,
                                        F.log1p("executions") / F.log1p("max_exec")).otherwise(0.0))
            .withColumn("agreement", F.least(F.size("sources") / 4.0, F.lit(1.0)))
            .withColumn("recency", recency("last_seen", F.lit(now).cast("timestamp"))))
    if certified is not None:
        out = (out.join(certified.select("table", "column", "agg", F.lit(1.0).alias("certified")),
                        ["table", "column", "agg"], "left").fillna({"certified": 0.0}))
    else:
        out = out.withColumn("certified", F.lit(0.0))
    total = (F.col("authority") * WEIGHTS["authority"] + F.col("usage") * WEIGHTS["usage"]
             + F.col("agreement") * WEIGHTS["agreement"] + F.col("recency") * WEIGHTS["recency"]
             + F.col("certified") * WEIGHTS["certified"])
    return (out.withColumn("total", total)
               .withColumn("review_required", F.col("total") < AUTO_MERGE)
               .withColumn("kept", F.col("total") > DROP)
               .withColumn("summary", summary()))


def summary() -> F.Column:
    """one line of justification per scored expression."""
    r2 = lambda c: F.round(F.col(c), 2).cast("string")
    return F.concat(
        F.when(F.size("sources") > 0, F.array_join("sources", ", ")).otherwise(F.lit("no sources")),
        F.lit(" ("), F.when(F.col("certified") > 0, "certified").otherwise("not certified"), F.lit("); "),
        F.col("executions").cast("string"), F.lit(" executions across "), F.col("users").cast("string"),
        F.lit(" distinct users; last seen "),
        F.coalesce(F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"), F.lit("never")),
        F.lit("; source_authority="), r2("authority"), F.lit(", usage_frequency="), r2("usage"),
        F.lit(", recency="), r2("recency"))
