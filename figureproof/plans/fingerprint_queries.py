"""Registered fingerprint queries (driver contract): each takes
``(spark, sf_dir)`` and returns a DataFrame whose columns match the DuckDB
oracle in ``fingerprint_sql``. Outputs are cast to plain types (DOUBLE
rounded, BIGINT, STRING, DATE, BOOLEAN) so both engines hash alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import relative_error, within_tolerance
from ..operators import solve as S
from . import report as R
from .fingerprint import resolve
from ..session import materialize


# Caption similarity from which a BI field is a candidate.
BI_TIER1_FLOOR = 0.4
BI_TIER3_FLOOR = 0.3


def _d(c, nd=4):
    return F.round(F.col(c).cast("double"), nd)


def report_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.report_figures(spark, sf_dir)
    return f.select("report_id", "edition_as_of", "pos", "metric", _d("value", 6).alias("value"),
                    "unit", "as_of", "dim", "label")


def measure_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.report_cube(spark, sf_dir)
    return c.select("table", "as_of", "dim", "dim_value", "fcol", "fvalue", "measure",
                    _d("s").alias("s"), F.col("n").cast("bigint").alias("n"))


def _setup(spark, sf_dir):
    cells = R.report_cube(spark, sf_dir)
    figs = S.prepare(R.report_figures(spark, sf_dir))
    groups = S.metric_groups(figs)
    points = materialize(S.constraint_points(figs, groups), "points")
    snaps = materialize(S.bind_snapshots(points, S.snapshot_registry(cells)), "snaps")
    return cells, points, snaps


def _scored(df: DataFrame) -> DataFrame:
    return (df.withColumn("key", S.canonical_key())
              .withColumn("ok", within_tolerance("computed", "reported"))
              .withColumn("err", relative_error("computed", "reported")))


def value_space_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, points, snaps = _setup(spark, sf_dir)
    h = _scored(S.tier2_hits(points, snaps, cells))
    return h.select("report_id", "metric", "key", _d("computed").alias("computed"),
                    _d("reported").alias("reported"), "ok", F.round("err", 6).alias("err"))


def filtered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, points, snaps = _setup(spark, sf_dir)
    gp = S.grand_points(points, snaps).select("report_id", "metric", "table", "snap_as_of", "reported")
    h = _scored(S.filtered_hits(gp, cells, S.filter_columns(cells)))
    return h.select("report_id", "metric", "key", _d("computed").alias("computed"), "ok",
                    F.round("err", 6).alias("err"))


def two_term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, points, snaps = _setup(spark, sf_dir)
    gp = S.grand_points(points, snaps).select("report_id", "metric", "table", "snap_as_of", "reported")
    h = _scored(S.two_term_hits(gp, cells))
    return h.select("report_id", "metric", "key", _d("computed").alias("computed"),
                    _d("reported").alias("reported"))


def seeds(spark: SparkSession, sf_dir: str, sims: DataFrame) -> DataFrame:
    """What names, BI fields and prose suggest for each metric."""
    from . import naming_queries as NQ
    from .workbook_queries import bi_candidates
    none = F.lit(None).cast("string")
    cols = ["metric", "tier", "table", "lhs_agg", "lhs_col", "op", "rhs_table", "rhs_agg", "rhs_col", "name_sim"]
    names = sims.where(F.col("sim") >= NQ.TIER1_MIN_COLUMN_SIMILARITY).select(
        "metric", F.lit(1).alias("tier"), "table", F.lit("SUM").alias("lhs_agg"), F.col("column").alias("lhs_col"),
        none.alias("op"), none.alias("rhs_table"), none.alias("rhs_agg"), none.alias("rhs_col"), F.col("sim").alias("name_sim"))
    bi = materialize(bi_candidates(spark, sf_dir), "bi")
    caps = bi.select(F.col("caption").alias("ident"), none.alias("description"))
    alike = NQ.similar(NQ._metrics(spark, sf_dir), caps, BI_TIER3_FLOOR).select(F.col("name").alias("metric"), F.col("ident").alias("caption"), "sim")
    fields = bi.join(alike, "caption")
    tier = lambda t, floor: fields.where(F.col("sim") >= floor).select(
        "metric", F.lit(t).alias("tier"), "table", "lhs_agg", "lhs_col", "op", "rhs_table", "rhs_agg", "rhs_col", F.col("sim").alias("name_sim"))
    hyp = NQ.prose_hypotheses(spark, sf_dir).where(F.lower("name") == F.lower("hname"))
    prose = NQ.prose_terms(spark, sf_dir, hyp).select(
        F.col("name").alias("metric"), F.lit(3).alias("tier"), F.col("t1").alias("table"), F.lit("SUM").alias("lhs_agg"),
        F.col("c1").alias("lhs_col"), "op", F.col("t2").alias("rhs_table"), F.when(F.col("op").isNotNull(), "SUM").alias("rhs_agg"),
        F.col("c2").alias("rhs_col"), F.col("sim").alias("name_sim"))
    return (names.unionByName(tier(1, BI_TIER1_FLOOR)).unionByName(tier(3, BI_TIER3_FLOOR)).unionByName(prose).select(*cols))


def _resolution(spark: SparkSession, sf_dir: str):
    from . import naming_queries as NQ
    from ..session import shared

    def build():
        sims = NQ.metric_similarity(spark, sf_dir).withColumnRenamed("name", "metric")
        return resolve(R.report_figures(spark, sf_dir), R.report_cube(spark, sf_dir), R.column_order(spark, sf_dir),
                       materialize(seeds(spark, sf_dir, sims), "seeds"), sims,
                       spark.createDataFrame(R.MART_HOPS, "table string, other string"))
    return shared(spark, ("resolution", sf_dir), build)


def resolve_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _resolution(spark, sf_dir)
    v = res.verdicts
    return v.select("report_id", "metric", "as_of", "band", "key", "tier",
                    F.col("satisfied").cast("bigint").alias("satisfied"),
                    F.col("total").cast("bigint").alias("total"), "near_key",
                    F.round("near_err", 6).alias("near_err"))


def constraint_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _resolution(spark, sf_dir)
    return res.scored.select("report_id", "metric", "key", "tier",
                             F.col("satisfied").cast("bigint").alias("satisfied"),
                             F.col("total").cast("bigint").alias("total"), "band",
                             F.col("rk").cast("bigint").alias("rank"))


def drift_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 over the two editions of the report fixture, with documentation
    hits counted over every document of ``documents``."""
    from ..operators import drift as D
    from ..sources.tables import read_table
    cells = R.report_cube(spark, sf_dir)
    res = _resolution(spark, sf_dir)
    eds = res.figures.select("report_id", "edition_as_of").distinct()
    verd = materialize(res.verdicts.join(eds, "report_id")
                       .select("report_id", "edition_as_of", "metric", "key"), "verdicts")
    side = D.last_two_editions(verd)
    best = (res.scored.where((F.col("rk") == 1) & (S.band_rank("band") >= 2))
               .join(side.where("side = 'old'"), "report_id")
               .select("metric", "cid", *S.CAND_COLS))
    new_g = res.groups.join(side.where("side = 'new'"), "report_id").select(
        "metric", F.col("as_of").alias("eval_as_of"), "reported")
    snaps = S.bind_snapshots(new_g, S.snapshot_registry(cells))
    pts = (best.join(new_g, "metric").join(snaps, ["eval_as_of", "table"])
               .select("cid", F.col("metric").alias("pid"), "snap_as_of",
                       F.lit(None).cast("string").alias("dim"), F.lit(None).cast("string").alias("dim_value")))
    ev = S.evaluate(best.select("cid", *S.CAND_COLS), pts, cells)
    recheck = materialize(ev.join(best.select("cid", "metric"), "cid").join(new_g, "metric")
                            .select("metric", within_tolerance("computed", "reported").alias("still_ok")),
                          "recheck")
    found = materialize(D.diff(verd, recheck), "drift")
    names = (found.select(F.col("old_name").alias("name")).unionByName(found.select(F.col("new_name").alias("name")))
                  .where(F.col("name").isNotNull()))
    hits = D.naming_documents(names, read_table(spark, sf_dir, "documents"))
    # a document that has both names of a rename counts once
    per = (found.select("kind", "old_name", "new_name", F.explode(F.array_compact(F.array("old_name", "new_name"))).alias("name"))
                .join(hits, "name").groupBy("kind", F.col("old_name").alias("o"), F.col("new_name").alias("n"))
                .agg(F.countDistinct("doc_id").alias("doc_hits")))
    f = found.alias("f")
    out = (f.join(per.withColumnRenamed("kind", "k"), (F.col("f.kind") == F.col("k")) & F.col("old_name").eqNullSafe(F.col("o"))
                  & F.col("new_name").eqNullSafe(F.col("n")), "left")
            .withColumn("doc_hits", F.coalesce("doc_hits", F.lit(0)).cast("bigint")))
    return out.select("kind", "old_name", "new_name", "old_key", "new_key", "doc_hits",
                      (F.col("doc_hits") == 0).alias("undocumented"))
