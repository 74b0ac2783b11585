"""dbt-style manifests.

A manifest file is one JSON object with a ``nodes`` and a ``metrics`` map; some
exports write one node per line instead. Both are read with an explicit schema
(no inference pass). Models give one row per column; metrics give name,
expression (``type_params.expr``, else the name) and the model of their first
``model.*`` dependency.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType([
    T.StructField("unique_id", T.StringType()),
    T.StructField("resource_type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("columns", T.MapType(T.StringType(), T.StructType([
        T.StructField("name", T.StringType()), T.StructField("data_type", T.StringType())]))),
    T.StructField("type_params", T.StructType([T.StructField("expr", T.StringType())])),
    T.StructField("depends_on", T.StructType([T.StructField("nodes", T.ArrayType(T.StringType()))])),
    T.StructField("meta", T.StructType([T.StructField("rows", T.LongType())])),
])
MANIFEST_SCHEMA = T.StructType([T.StructField("nodes", T.MapType(T.StringType(), NODE_SCHEMA)),
                                T.StructField("metrics", T.MapType(T.StringType(), NODE_SCHEMA))])


def nodes_of(manifests: DataFrame) -> DataFrame:
    """One row per node of manifest objects, whichever map holds it; the key of the map is the id."""
    empty = F.create_map().cast(MANIFEST_SCHEMA["nodes"].dataType)
    both = F.concat(F.map_entries(F.coalesce("nodes", empty)), F.map_entries(F.coalesce("metrics", empty)))
    kind = F.coalesce("e.value.resource_type", F.split("e.key", r"\.")[0])
    return manifests.select(F.explode(both).alias("e")).select(
        F.col("e.key").alias("unique_id"), kind.alias("resource_type"),
        *[F.col(f"e.value.{f.name}").alias(f.name) for f in NODE_SCHEMA.fields[2:]])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the manifest objects below ``path``, one object per file."""
    return nodes_of(spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").json(path))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of files that hold one node per line."""
    return spark.read.schema(NODE_SCHEMA).option("mode", "PERMISSIVE").json(path)


def model_columns(nodes: DataFrame) -> DataFrame:
    """``model, column, data_type, rows`` for every column of every model."""
    return (nodes.where(F.col("resource_type") == "model")
                 .select(F.col("name").alias("model"), F.col("meta.rows").alias("rows"), F.explode("columns").alias("k", "c"))
                 .select("model", F.col("c.name").alias("column"), F.col("c.data_type").alias("data_type"), "rows"))


def metrics(nodes: DataFrame) -> DataFrame:
    """``metric, expr, model`` (model NULL when no model dependency)."""
    m = nodes.where(F.col("resource_type") == "metric")
    first_model = F.try_element_at(F.filter("depends_on.nodes", lambda n: n.startswith("model.")), F.lit(1))
    models = nodes.where(F.col("resource_type") == "model").select(
        F.col("unique_id").alias("model_id"), F.col("name").alias("model"))
    return (m.select(F.col("name").alias("metric"), F.coalesce("type_params.expr", "name").alias("expr"),
                     first_model.alias("model_id"))
             .join(models, "model_id", "left").drop("model_id"))
