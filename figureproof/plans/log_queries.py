"""The statement log fixture, rendered by Spark from ``events`` (one log
entry per event, so the log grows with the table), and the registered
log-mining queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import querylog as L
from ..sources.tables import read_table, read_tables
from . import log_oracle as O

# The statement templates, one per event type. ``{u}`` user,
# ``{v}`` value, ``{i}`` event id, ``{d}`` event date.
TEMPLATES = {
    "click": "-- click report for user {u}\nSELECT e.event_type, SUM(e.value) AS total FROM events e "
             "WHERE e.user_id = {u} GROUP BY e.event_type;",
    "view": "SELECT user_id, COUNT(*) FROM events WHERE value > {v} GROUP BY user_id;\n"
            "SELECT q.user_id, SUM(COALESCE(ROUND(q.value), 0)) FILTER (WHERE q.event_type <> 'limit 3') AS kept\n"
            "FROM (SELECT user_id, value, event_type FROM \"events\" WHERE event_id > {i}) q GROUP BY q.user_id;",
    "purchase": "SELECT c.c_mktsegment, AVG(o.o_totalprice), COUNT(DISTINCT o.o_custkey) FROM orders o "
                "JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' "
                "AND o.o_totalprice > {v} GROUP BY c.c_mktsegment;",
    "signup": "INSERT INTO events VALUES ({i}, '{d}', {u}, 'signup', {v});\n"
              "SELECT COUNT(*) FROM events WHERE event_type = 'signup' AND user_id = {u};",
    "error": "-- investigate\nSELECT * FROM events WHERE event_id = {i};",
}


def _render(template: str) -> F.Column:
    parts = {"u": F.col("user_id").cast("string"), "v": F.col("value").cast("string"),
             "i": F.col("event_id").cast("string"), "d": F.to_date("ts").cast("string")}
    out, rest = [], template
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        out += [F.lit(pre), parts[key]]
    out.append(F.lit(rest))
    return F.concat(*out)


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_events(read_table(spark, sf_dir, "events"))


def render_events(ev: DataFrame) -> DataFrame:
    """One log entry per event (works on batch and streaming frames)."""
    text = None
    for t, tpl in TEMPLATES.items():
        text = (F.when(F.col("event_type") == t, _render(tpl)) if text is None
                else text.when(F.col("event_type") == t, _render(tpl)))
    return ev.select(F.col("event_id").alias("stmt_id"), "user_id", "ts", text.alias("text"))


def _catalog(spark, sf_dir):
    return P.column_catalog(spark, read_tables(spark, sf_dir))


def _shapes(spark, sf_dir):
    """The log's shapes, one row each: all mining works on them."""
    from ..session import materialize, shared
    return shared(spark, ("shapes", sf_dir), lambda: materialize(L.shapes(L.statements(log_table(spark, sf_dir))), "shapes"))


def query_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).select(
        "shape_hash", F.col("execution_count").cast("bigint").alias("execution_count"),
        F.col("distinct_users").cast("bigint").alias("distinct_users"), "last_executed_at", "first_sql", "class")


def log_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = L.aggregate_calls(_shapes(spark, sf_dir), _catalog(spark, sf_dir))
    return L.usage_rollup(calls).select(
        F.col("tbl").alias("table"), F.col("col").alias("column"), "agg", "is_distinct",
        F.col("calls").cast("bigint").alias("calls"), F.col("statements").cast("bigint").alias("statements"),
        F.col("users").cast("bigint").alias("users"))


def log_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = L.dimension_columns(_shapes(spark, sf_dir), _catalog(spark, sf_dir))
    return L.dimension_rollup(g).select(
        F.col("tbl").alias("table"), F.col("col").alias("column"), "is_time", F.col("shapes").cast("bigint").alias("shapes"),
        F.col("statements").cast("bigint").alias("statements"), F.col("users").cast("bigint").alias("users"))


def log_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = L.join_rollup(L.join_conditions(_shapes(spark, sf_dir), _catalog(spark, sf_dir)))
    return j.select("from_table", "from_column", "to_table", "to_column", "join_type",
                    F.col("statements").cast("bigint").alias("statements"), F.col("shapes").cast("bigint").alias("shapes"))


# ----------------------------------------------------------------------- oracle

def oracle(schema) -> dict[str, str]:
    return O.log_queries()


# ----------------------------------------------------------------------- evidence and trust

# Fixed value: the scoring clock of the fixture.
TRUST_NOW = "2024-02-15 00:00:00"


def _document_expressions(spark, sf_dir):
    """Expressions read from spreadsheets and BI workbooks: ``expression, source``."""
    from .report_text import cell_evidence
    from .workbook_queries import bi_formula
    cells = cell_evidence(spark, sf_dir).where("resolved_expression IS NOT NULL AND NOT ambiguous").select(
        F.col("resolved_expression").alias("expression"), F.col("source_type").alias("source"))
    bi = bi_formula(spark, sf_dir).where("sql IS NOT NULL").select(F.col("sql").alias("expression"), F.lit("tableau_calc").alias("source"))
    return cells.unionByName(bi)


def _evidence(spark, sf_dir):
    from ..operators import trust as TR
    cat = _catalog(spark, sf_dir)
    calls = L.aggregate_calls(_shapes(spark, sf_dir), cat)
    # roles come from the schemas alone: no table scan
    roles = cat.withColumn("role", P.role(F.col("column"), F.col("kind")))
    ev = (TR.log_evidence(calls).unionByName(TR.role_evidence(roles))
          .unionByName(TR.document_evidence(_document_expressions(spark, sf_dir), cat)))
    return TR.bundle(ev)


def evidence_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _evidence(spark, sf_dir)
    return b.select("table", "column", "agg", F.col("executions").cast("bigint").alias("executions"),
                    F.col("users").cast("bigint").alias("users"), "last_seen",
                    F.array_join("sources", ",").alias("sources"), F.array_join("filters", "; ", "-").alias("filters"))


def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import trust as TR
    s = TR.score(_evidence(spark, sf_dir), TRUST_NOW)
    return s.select("table", "column", "agg", F.round("authority", 6).alias("authority"),
                    F.round("usage", 6).alias("usage"), F.round("agreement", 6).alias("agreement"),
                    F.round("recency", 6).alias("recency"), F.round("certified", 6).alias("certified"),
                    F.round("total", 6).alias("total"), "review_required", "kept", "summary")


def oracle_evidence(schema, cell_sql: str, bi_sql: str) -> dict[str, str]:
    from .catalog_queries import oracle as cat_oracle
    ev = O.evidence_ctes(schema, cat_oracle(schema)["column_roles"], cell_sql, bi_sql)
    auth = O.AUTHORITY
    out = {}
    out["evidence_bundle"] = ev + """
SELECT "table", "column", agg, CAST(executions AS BIGINT) AS executions, CAST(users AS BIGINT) AS users,
       last_seen, array_to_string(sources, ',') AS sources, filters FROM b"""
    w = {"authority": 0.30, "usage": 0.25, "agreement": 0.20, "recency": 0.15, "certified": 0.10}
    auto_merge, drop = 0.85, 0.50
    out["trust_score"] = ev + f""",
sc AS (
  SELECT *,
    CAST(coalesce(list_max(list_transform(sources, lambda s: CASE s {auth} ELSE 0.0 END)), 0.0) AS DOUBLE) AS authority,
    CASE WHEN max(executions) OVER (PARTITION BY "table") > 0
         THEN ln(1 + executions) / ln(1 + max(executions) OVER (PARTITION BY "table")) ELSE 0.0 END AS usage,
    CAST(least(len(sources) / 4.0, 1.0) AS DOUBLE) AS agreement,
    CAST(CASE WHEN last_seen IS NULL THEN 0.0
         WHEN floor((epoch(TIMESTAMP '{TRUST_NOW}') - epoch(last_seen)) / 86400) <= 7 THEN 1.0
         WHEN floor((epoch(TIMESTAMP '{TRUST_NOW}') - epoch(last_seen)) / 86400) <= 30 THEN 0.8
         WHEN floor((epoch(TIMESTAMP '{TRUST_NOW}') - epoch(last_seen)) / 86400) <= 90 THEN 0.5
         WHEN floor((epoch(TIMESTAMP '{TRUST_NOW}') - epoch(last_seen)) / 86400) <= 365 THEN 0.2
         ELSE 0.0 END AS DOUBLE) AS recency,
    CAST(0.0 AS DOUBLE) AS certified
  FROM b)
SELECT "table", "column", agg, round(authority, 6) AS authority, round(usage, 6) AS usage,
       round(agreement, 6) AS agreement, round(recency, 6) AS recency, round(certified, 6) AS certified,
       round(authority * {w['authority']} + usage * {w['usage']} + agreement * {w['agreement']}
             + recency * {w['recency']} + certified * {w['certified']}, 6) AS total,
       authority * {w['authority']} + usage * {w['usage']} + agreement * {w['agreement']}
             + recency * {w['recency']} + certified * {w['certified']} < {auto_merge} AS review_required,
       authority * {w['authority']} + usage * {w['usage']} + agreement * {w['agreement']}
             + recency * {w['recency']} + certified * {w['certified']} > {drop} AS kept,
       CASE WHEN len(sources) > 0 THEN array_to_string(sources, ', ') ELSE 'no sources' END || ' (' ||
       CASE WHEN certified > 0 THEN 'certified' ELSE 'not certified' END || '); ' ||
       CAST(executions AS VARCHAR) || ' executions across ' || CAST(users AS VARCHAR) ||
       ' distinct users; last seen ' || coalesce(strftime(last_seen, '%Y-%m-%d %H:%M:%S'), 'never') ||
       '; source_authority=' || CAST(round(authority, 2) AS VARCHAR) ||
       ', usage_frequency=' || CAST(round(usage, 2) AS VARCHAR) ||
       ', recency=' || CAST(round(recency, 2) AS VARCHAR) AS summary
FROM sc"""
    return out


# ----------------------------------------------------------------------- streaming

def signal_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events files read as a stream (availableNow); each statement
    shape is emitted once, written by foreachBatch to the batch's folder; the
    query returns what was emitted."""
    from ..streaming import signals as SG
    schema = read_table(spark, sf_dir, "events").schema
    sink = SG.run_available(spark, f"{sf_dir}/events*.parquet", schema, render_events)
    return SG.read_sink(spark, sink, SG.SIGNAL).select("shape_hash", "class")


def usage_window_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.signals import latest_usage, run_usage_window
    schema = read_table(spark, sf_dir, "events").schema
    sink = run_usage_window(spark, f"{sf_dir}/events*.parquet", schema, render_events)
    return latest_usage(spark, sink).select("window_start", "shape_hash",
                                            F.col("executions").cast("bigint").alias("executions"))
