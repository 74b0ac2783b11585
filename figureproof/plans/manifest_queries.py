"""A manifest rendered from the catalog and the mined log aggregates,
written as one JSON object and read back through the manifest source (S6, S7).

Models: one per driver table, with its columns, types and row count. Metrics: one per
mined aggregate of the statement log (``COUNT(*)`` has no expression, so
its name stands in), depending on a macro and then on the model of its
table.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from ..session import checkpoint_dir, shared
from ..sources import manifest as M
from ..sources.tables import read_tables
from .log_queries import log_aggregates

PROJECT = "shop"


def _metric_name() -> F.Column:
    col = F.when(F.col("column") == "*", F.lit("rows")).otherwise(F.col("column"))
    return F.concat(F.lower("agg"), F.lit("_"), col)


def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows") for t, df in read_tables(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts)


def render_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object with a ``nodes`` and a ``metrics`` map (catalog-sized)."""
    cat = P.column_catalog(spark, read_tables(spark, sf_dir)).join(_row_counts(spark, sf_dir), "table")
    models = (cat.groupBy("table", "rows")
                 .agg(F.map_from_entries(F.collect_list(F.struct(
                     "column", F.struct(F.col("column").alias("name"), F.col("spark_type").alias("data_type")))))
                      .alias("columns"))
                 .select(F.concat(F.lit(f"model.{PROJECT}."), F.col("table")).alias("id"), F.struct(
                     F.lit("model").alias("resource_type"), F.col("table").alias("name"), "columns", F.struct("rows").alias("meta")).alias("node")))
    aggs = log_aggregates(spark, sf_dir)
    expr = F.when(F.col("column") == "*", F.lit(None).cast("string")).otherwise(
        F.concat(F.regexp_replace("agg", "_DISTINCT$", ""), F.lit("("), F.when(F.col("is_distinct"), F.lit("DISTINCT ")).otherwise(F.lit("")),
                 F.col("column"), F.lit(")")))
    mets = aggs.select(F.concat(F.lit(f"metric.{PROJECT}."), _metric_name()).alias("id"), F.struct(
        _metric_name().alias("name"), F.struct(expr.alias("expr")).alias("type_params"),
        F.struct(F.array(F.lit(f"macro.{PROJECT}.fiscal_quarter"),
                         F.concat(F.lit(f"model.{PROJECT}."), F.col("table"))).alias("nodes")).alias("depends_on")).alias("node"))
    as_map = lambda df, name: df.agg(F.map_from_entries(F.collect_list(F.struct("id", "node"))).alias(name))
    # one row each: the second is a scalar of the first
    return as_map(models, "nodes").select(F.to_json(F.struct("nodes", as_map(mets, "metrics").scalar().alias("metrics"))).alias("value"))


def _manifest_files(spark: SparkSession, sf_dir: str) -> str:
    path = os.path.join(checkpoint_dir(spark), "figureproof", "manifest-" + uuid.uuid4().hex)
    render_manifest(spark, sf_dir).coalesce(1).write.text(path)
    return path


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.read_manifest(spark, shared(spark, ("manifest", sf_dir), lambda: _manifest_files(spark, sf_dir)))


def certified_metric_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's files read as a stream; every certified metric once,
    though the stream is run twice over the same sink."""
    from ..streaming import signals as SG
    path = _manifest_files(spark, sf_dir)
    sink = SG.run_certified(spark, path)
    SG.run_certified(spark, path, sink_dir=sink)
    return SG.read_sink(spark, sink, SG.METRIC).select("metric", "expr", "model")


def manifest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.model_columns(_nodes(spark, sf_dir))


def manifest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metrics(_nodes(spark, sf_dir))


def oracle(log_aggregates_sql: str, schema_sf_dir: str) -> dict[str, str]:
    import pyarrow as pa
    import pyarrow.parquet as pq
    from ..sources.tables import DRIVER_TABLES

    def spark_type(t):
        if pa.types.is_int64(t):
            return "bigint"
        if pa.types.is_int32(t):
            return "int"
        if pa.types.is_float64(t):
            return "double"
        if pa.types.is_float32(t):
            return "float"
        if pa.types.is_timestamp(t):
            return "timestamp_ntz" if t.tz is None else "timestamp"
        if pa.types.is_list(t):
            return f"array<{spark_type(t.value_type)}>"
        return "string"
    rows = []
    for t in DRIVER_TABLES:
        for f in pq.read_schema(f"{schema_sf_dir}/{t}.parquet"):
            rows.append(f"SELECT '{t}' AS model, '{f.name}' AS \"column\", '{spark_type(f.type)}' AS data_type,"
                        f" CAST(count(*) AS BIGINT) AS rows FROM {t}")
    return {
        "manifest_models": " UNION ALL ".join(rows),
        "manifest_metrics": f"""
WITH a AS ({log_aggregates_sql})
SELECT lower(agg) || '_' || CASE WHEN "column" = '*' THEN 'rows' ELSE "column" END AS metric,
       CASE WHEN "column" = '*' THEN lower(agg) || '_rows' WHEN is_distinct THEN 'COUNT(DISTINCT ' || "column" || ')'
            ELSE agg || '(' || "column" || ')' END AS expr,
       "table" AS model
FROM a"""}


def certified_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence is certified when a manifest metric has the same
    whitespace-free lower-case expression and the same model (or none);
    the trust score is recomputed with the certification signal."""
    from ..operators import trust as TR
    from .log_queries import TRUST_NOW, _evidence
    b = _evidence(spark, sf_dir)
    norm = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    ev_expr = F.when(F.col("agg") == "COUNT_DISTINCT", F.concat(F.lit("COUNT(DISTINCT "), F.col("column"), F.lit(")"))).otherwise(
        F.concat(F.col("agg"), F.lit("("), F.col("column"), F.lit(")")))
    m = manifest_metrics(spark, sf_dir).select(norm(F.col("expr")).alias("nexpr"), F.col("model").alias("m_table"))
    ev = b.withColumn("nexpr", norm(ev_expr))
    cert = (ev.join(m, "nexpr")
              .where(F.col("m_table").isNull() | (F.col("m_table") == "") | (F.col("m_table") == F.col("table")))
              .select("table", "column", "agg").distinct())
    s = TR.score(b, TRUST_NOW, cert)
    return s.select("table", "column", "agg", F.round("certified", 6).alias("certified"),
                    F.round("total", 6).alias("total"), "review_required")


def oracle_certified(trust_sql: str, metrics_sql: str) -> str:
    from ..operators import trust as TR
    w = TR.WEIGHTS
    head = trust_sql[:trust_sql.rindex('SELECT "table", "column", agg, round(authority')]
    return head.replace("    CAST(0.0 AS DOUBLE) AS certified\n  FROM b)", f"""    CAST(CASE WHEN EXISTS (
      SELECT 1 FROM ({metrics_sql}) mm
      WHERE regexp_replace(lower(mm.expr), '\\s+', '', 'g') = CASE WHEN b.agg = 'COUNT_DISTINCT' THEN 'count(distinct' || b."column" || ')' ELSE lower(b.agg || '(' || b."column" || ')') END
        AND (mm.model IS NULL OR mm.model = '' OR mm.model = b."table")) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS certified
  FROM b)""") + f"""
SELECT "table", "column", agg, round(certified, 6) AS certified,
       round(authority * {w['authority']} + usage * {w['usage']} + agreement * {w['agreement']} + recency * {w['recency']} + certified * {w['certified']}, 6) AS total,
       authority * {w['authority']} + usage * {w['usage']} + agreement * {w['agreement']} + recency * {w['recency']} + certified * {w['certified']} < {TR.AUTO_MERGE} AS review_required
FROM sc"""
