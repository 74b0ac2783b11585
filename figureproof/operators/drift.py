"""Drift between report editions.

Inputs are the verdicts of two editions (one row per metric with its
resolved key). Renames pair disappeared with appeared names that resolve
to the same expression (one-to-one, in name order); redefinitions are
kept names whose expression changed, or whose old expression no longer
reproduces the new figure. A finding's documentation is the documents that
contain one of its names, each counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def naming_documents(names: DataFrame, docs: DataFrame) -> DataFrame:
    """``name, doc_id`` of every document whose text contains the name,
    whatever the case. One scan: the names (report-sized) are one array, the
    value of a scalar subquery, and each text keeps those that it contains."""
    listed = names.select("name").where("name IS NOT NULL").agg(F.collect_set("name").alias("n")).scalar()
    text = docs.select("doc_id", F.lower("text").alias("t"), listed.alias("n"))
    return (text.select("doc_id", F.explode(F.filter("n", lambda n: F.contains(F.col("t"), F.lower(n)))).alias("name"))
                .distinct())


def documentation_hits(names: DataFrame, docs: DataFrame) -> DataFrame:
    """Number of documents containing each name."""
    hits = naming_documents(names, docs).groupBy("name").agg(F.count(F.lit(1)).alias("doc_hits"))
    return (names.select("name").distinct().join(hits, "name", "left")
                 .select("name", F.coalesce("doc_hits", F.lit(0)).cast("bigint").alias("doc_hits")))


def last_two_editions(verdicts: DataFrame) -> DataFrame:
    """Tag the two most recent editions by date (then id) old/new."""
    eds = verdicts.select("report_id", "edition_as_of").distinct()
    w = Window.orderBy(F.col("edition_as_of").desc(), F.col("report_id").desc())
    # editions are report-sized (a handful of rows): a global order is fine
    r = eds.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return r.withColumn("side", F.when(F.col("r") == 1, "new").otherwise("old")).drop("r")


def diff(verdicts: DataFrame, recheck: DataFrame) -> DataFrame:
    """``verdicts(report_id, edition_as_of, metric, key)``; ``recheck``:
    ``metric, still_ok`` — whether the old expression reproduces the new
    grand total. Returns ``kind, old_name, new_name, old_key, new_key``."""
    ed = last_two_editions(verdicts)
    v = verdicts.join(ed, ["report_id", "edition_as_of"])
    old = v.where("side = 'old'").select(F.col("metric").alias("name"), F.col("key").alias("old_key"))
    new = v.where("side = 'new'").select(F.col("metric").alias("name"), F.col("key").alias("new_key"))
    gone = old.join(new, "name", "left_anti")
    came = new.join(old, "name", "left_anti")
    wk = lambda k: Window.partitionBy(k).orderBy("name")
    g = (gone.where(F.col("old_key").isNotNull()).withColumn("r", F.row_number().over(wk("old_key")))
             .select(F.col("name").alias("old_name"), F.col("old_key").alias("pair_key"), "r", "old_key"))
    c = (came.where(F.col("new_key").isNotNull()).withColumn("r", F.row_number().over(wk("new_key")))
             .select(F.col("name").alias("new_name"), F.col("new_key").alias("pair_key"), "r", "new_key"))
    ren = (g.join(c, ["pair_key", "r"])
            .select(F.lit("renamed").alias("kind"), "old_name", "new_name", "old_key", "new_key"))
    kept = old.join(new, "name").join(recheck, F.col("name") == F.col("metric"), "left")
    redef = (kept.where(F.col("old_key").isNotNull()
                        & ((F.col("new_key").isNotNull() & (F.col("old_key") != F.col("new_key")))
                           | ((F.col("new_key").isNull() | (F.col("old_key") == F.col("new_key")))
                              & (F.col("still_ok") == False))))  # noqa: E712
                 .select(F.lit("redefined").alias("kind"), F.col("name").alias("old_name"),
                         F.col("name").alias("new_name"), "old_key", "new_key"))
    appeared = (came.join(ren.select(F.col("new_name").alias("name")), "name", "left_anti")
                    .select(F.lit("appeared").alias("kind"), F.lit(None).cast("string").alias("old_name"),
                            F.col("name").alias("new_name"), F.lit(None).cast("string").alias("old_key"),
                            "new_key"))
    disappeared = (gone.join(ren.select(F.col("old_name").alias("name")), "name", "left_anti")
                       .select(F.lit("disappeared").alias("kind"), F.col("name").alias("old_name"),
                               F.lit(None).cast("string").alias("new_name"), "old_key",
                               F.lit(None).cast("string").alias("new_key")))
    return ren.unionByName(redef).unionByName(appeared).unionByName(disappeared)
