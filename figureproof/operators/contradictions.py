"""Contradictions between sources.

Every source states how a metric is defined: ``metric_name, definition, source,
source_date, source_type, structure`` (NULL where no structure can be read).
Names mean the same metric if they are equal ignoring case, one ends in the
other, or they are 0.85 similar; what such links connect is a group, under its
shortest name. A group with statements of two structures or more is a
contradiction, and all its statements are sides, ranked by the trust in their
kind of source.

Names are joined, never compared pair by pair: endings by an equi-join on
every ending of a name, similar ones by a join of word sets with the rarest
words first. A group's statements are never gathered in one place: structures
and trust levels are counted per group, and joined back to the statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming as NM
from . import simjoin as SJ
from .trust import SOURCE_AUTHORITY

# Fixed value: names from this similarity on mean the same metric.
SAME_METRIC = 0.85

STATEMENT = ["metric_name", "definition", "source", "source_date", "source_type", "structure"]


def expression_structure(sql: Column) -> Column:
    """the structure of a BI field's SQL, by its operator."""
    return (F.when(F.contains(sql, F.lit(" - ")), "A - B").when(F.contains(sql, F.lit(" + ")), "A + B")
             .when(F.contains(sql, F.lit(" / ")), "A / B").otherwise("SUM(A)"))


def source_trust(source_type: Column) -> Column:
    e = F.lit(0.0)
    for k, v in SOURCE_AUTHORITY.items():
        e = F.when(source_type == k, F.lit(v)).otherwise(e)
    return e


def _words(names: DataFrame) -> DataFrame:
    """``lname, side, toks``: the words of a name as business text and as an identifier, in one order."""
    t = names.select("lname", F.lit("text").alias("side"), NM.business_words("lname").alias("toks")).unionByName(
        names.select("lname", F.lit("ident").alias("side"), NM.identifier_words("lname").alias("toks")))
    return SJ.rare_first(t, ["lname", "side"])


def same_metric(names: DataFrame) -> DataFrame:
    """Links ``a, b`` between different lower-case names (``lname``) of the same metric."""
    n = names.select("lname").distinct()
    ends = n.select(F.col("lname").alias("a"), F.explode(F.transform(
        F.sequence(F.lit(2), F.greatest(F.char_length("lname"), F.lit(2))), lambda i: F.substr("lname", i, F.char_length("lname")))).alias("lname"))
    endings = ends.join(n, "lname").select("a", F.col("lname").alias("b"))
    # 0.85 is out of reach of the sequence ratio, which counts 0.8: the words decide
    w = _words(n)
    alike = SJ.dice_pairs(w.where("side = 'text'").select(F.col("lname").alias("a"), "toks"),
                          w.where("side = 'ident'").select(F.col("lname").alias("b"), "toks"), "a", "b", SAME_METRIC)
    return endings.unionByName(alike).where("a <> b").distinct()


def metric_groups(names: DataFrame) -> DataFrame:
    """``lname, metric``: each name with the shortest name of its group (the first of equally short ones)."""
    n = names.select("lname").distinct()
    root = SJ.groups(same_metric(n), n, "lname")
    short = root.groupBy("root").agg(F.min_by("lname", F.struct(F.char_length("lname"), F.col("lname"))).alias("metric"))
    return root.join(short, "root").select("lname", "metric")


def find(statements: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row per side of every contradiction, with what fingerprinting found.

    ``accepted(metric, key, band)``: the mapping of each metric; the first one in
    name order whose metric is the group's (by name or 0.85 similar) is noted (J19).
    """
    st = statements.select(*STATEMENT, F.lower("metric_name").alias("lname")).distinct()
    sides = st.join(metric_groups(st), "lname").withColumn("trust", source_trust(F.col("source_type")))
    split = (sides.groupBy("metric").agg(F.array_sort(F.collect_set("structure")).alias("s"),
                                         F.count(F.lit(1)).alias("n_sides")).where(F.size("s") > 1)
             .select("metric", F.array_join("s", ", ").alias("structures"), "n_sides"))
    levels = sides.join(split.select("metric"), "metric", "left_semi").select("metric", "trust").distinct()
    ranked = levels.withColumn("trust_rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.col("trust").desc())))
    return (sides.join(split, "metric").join(ranked, ["metric", "trust"]).join(_found(split.select("metric"), accepted), "metric", "left")
            .select("metric", "structures", "n_sides", "trust_rank", "trust", "source_type", "source", "source_date", "metric_name",
                    "definition", "structure", "empirical_key", "empirical_band"))


def _found(metrics: DataFrame, accepted: DataFrame) -> DataFrame:
    names = accepted.select(F.lower("metric").alias("name"), F.col("key").alias("empirical_key"), F.col("band").alias("empirical_band"))
    both = metrics.select(F.col("metric").alias("lname")).unionByName(names.select(F.col("name").alias("lname"))).distinct()
    w = _words(both)
    alike = SJ.dice_pairs(w.where("side = 'text'").select(F.col("lname").alias("name"), "toks"),
                          w.where("side = 'ident'").select(F.col("lname").alias("metric"), "toks"), "name", "metric", SAME_METRIC)
    same = both.select(F.col("lname").alias("name"), F.col("lname").alias("metric"))
    met = alike.unionByName(same).distinct().join(metrics, "metric").join(names, "name")
    first = met.groupBy("metric").agg(F.min_by(F.struct("empirical_key", "empirical_band"), F.struct("name", "empirical_key")).alias("e"))
    return first.select("metric", "e.empirical_key", "e.empirical_band")
