"""Report-first resolution (C1-C6): which aggregate reproduces each printed
figure, and how sure we are.

Order-free version of the tiered search. Tier 1 (candidates by name: columns
similar to the metric, BI fields with a similar caption) decides a metric if
any of its candidates meets the grand total; else tier 2 (every single-column
SUM and COUNT(*)); else tier 3 (compositions read from prose and BI formulas,
two-term compositions and filtered aggregates of the tables in scope: those of
accepted mappings, of near misses, and one hop away). All candidates of all
metrics and tiers are evaluated at once by joins on the cube; the tier rules
are filters on the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import relative_error, within_tolerance
from ..operators import solve as S
from ..operators.cube import distinct_values
from ..session import materialize


@dataclass
class Resolution:
    figures: DataFrame      # prepared figures (raw value, id)
    groups: DataFrame       # one row per (report, metric)
    hits: DataFrame         # grand-total evaluations of every candidate tried
    constraints: DataFrame  # constraint rows of every survivor
    scored: DataFrame       # one row per survivor with band
    verdicts: DataFrame     # one row per (report, metric)
    bindings: DataFrame     # the column and value that each breakdown label is bound to, per table


def _cid(df: DataFrame) -> DataFrame:
    return (df.withColumn("key", S.canonical_key())
              .withColumn("cid", F.sha2(F.concat_ws("|", "report_id", "metric", "tier", "key"), 256)))


def _tried(df: DataFrame) -> DataFrame:
    return (df.withColumn("ok", within_tolerance("computed", "reported"))
              .withColumn("err", relative_error("computed", "reported")))


def _named(df: DataFrame, sims: DataFrame | None) -> DataFrame:
    """``name_sim`` of a blind candidate: the better of its columns' similarities with the metric."""
    if sims is None:
        return df.withColumn("name_sim", F.lit(0.0))
    l = sims.select("metric", "table", F.col("column").alias("lhs_col"), F.col("sim").alias("ls"))
    r = sims.select("metric", F.col("table").alias("rhs_table"), F.col("column").alias("rhs_col"), F.col("sim").alias("rs"))
    return (df.join(l, ["metric", "table", "lhs_col"], "left").join(r, ["metric", "rhs_table", "rhs_col"], "left")
              .withColumn("name_sim", F.greatest(F.coalesce("ls", F.lit(0.0)), F.coalesce("rs", F.lit(0.0)))).drop("ls", "rs"))


def seeded_hits(seeds: DataFrame, gp: DataFrame, cells: DataFrame) -> DataFrame:
    """Seeds (``metric, tier, table, lhs_agg, lhs_col, op, rhs_table, rhs_agg, rhs_col, name_sim``)
    evaluated at the grand total of every report that prints the metric; one row per
    (report, metric, tier, key) with the highest similarity (W2)."""
    c = gp.join(seeds, ["metric", "table"])
    for x in ("pred_col", "pred_op", "pred_val"):
        c = c.withColumn(x, F.lit(None).cast("string"))
    c = _cid(c)
    w = Window.partitionBy("cid").orderBy(F.col("name_sim").desc())
    c = c.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    none = F.lit(None).cast("string")
    ev = S.evaluate(c.select("cid", *S.CAND_COLS),
                    c.select("cid", F.col("cid").alias("pid"), "snap_as_of", none.alias("dim"), none.alias("dim_value")), cells)
    return _tried(c.join(ev.select("cid", "computed"), "cid")).select(
        "cid", "report_id", "metric", "tier", "key", *S.CAND_COLS, "computed", "reported", "name_sim", "ok", "err")


def score_survivors(surv: DataFrame, points: DataFrame, snaps: DataFrame, cells: DataFrame,
                    col_order: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All constraints of every survivor, tallied and banded; and the bindings of the labels."""
    surv = surv.select("cid", "report_id", "metric", "key", "tier", *S.CAND_COLS,
                       "computed", "reported", "name_sim")
    grand = surv.join(points.where("kind = 'grand_total'").select(
        "report_id", "metric", "figure_id"), ["report_id", "metric"]).select(
        "cid", "report_id", "metric", F.lit("grand_total").alias("kind"), "figure_id",
        "reported", "computed")
    # breakdowns: bind labels to a column per (group, dim, candidate table)
    brk = points.where("kind = 'breakdown'")
    tables = surv.select("report_id", "metric", "table").distinct()
    lab = (brk.join(tables, ["report_id", "metric"])
              .join(snaps, ["eval_as_of", "table"])
              .select("report_id", "metric", "dim", "table", "snap_as_of", "label"))
    vals = distinct_values(cells).select("table", F.col("as_of").alias("snap_as_of"),
                                         "column", "value")
    bound = materialize(S.bind_dimensions(lab, vals, col_order), "bindings")
    bp = (surv.select("cid", "report_id", "metric", "table")
              .join(brk, ["report_id", "metric"])
              .join(snaps, ["eval_as_of", "table"], "left")
              .join(bound, ["report_id", "metric", "dim", "table", "label"], "left")
              .select("cid", F.col("figure_id").alias("pid"), "snap_as_of",
                      F.col("column").alias("dim"), F.col("value").alias("dim_value"),
                      "reported", F.col("figure_id")))
    # prior periods: skipped (not counted) when no snapshot matches
    pp = (surv.select("cid", "report_id", "metric", "table")
              .join(points.where("kind = 'prior_period'"), ["report_id", "metric"])
              .join(snaps, ["eval_as_of", "table"])
              .select("cid", F.col("figure_id").alias("pid"), "snap_as_of",
                      F.lit(None).cast("string").alias("dim"),
                      F.lit(None).cast("string").alias("dim_value"), "reported", "figure_id"))
    pts = bp.unionByName(pp)
    # an unbound breakdown label is not evaluable (computed stays NULL)
    bound_pts = bp.where(F.col("dim").isNotNull()).unionByName(pp)
    ev = S.evaluate(surv.select("cid", *S.CAND_COLS),
                    bound_pts.select("cid", "pid", "snap_as_of", "dim", "dim_value"), cells)
    rest = (pts.join(ev, ["cid", "pid"], "left")
               .join(surv.select("cid", "report_id", "metric"), "cid")
               .join(points.select("figure_id", "kind").distinct(), "figure_id")
               .select("cid", "report_id", "metric", "kind", "figure_id", "reported", "computed"))
    cons = materialize(grand.unionByName(rest)
                       .withColumn("ok", within_tolerance("computed", "reported"))
                       .withColumn("err", relative_error("computed", "reported")), "constraints")
    tally = cons.groupBy("cid").agg(
        F.count_if("ok").alias("satisfied"), F.count(F.lit(1)).alias("total"),
        F.max(F.when(F.col("kind") == "grand_total", F.col("ok"))).alias("grand_ok"))
    scored = (surv.join(tally, "cid")
                  .withColumn("band", S.band("satisfied", "total", "grand_ok"))
                  .withColumn("score", F.col("satisfied") / F.col("total")))
    return cons, scored, bound


def pick_best(scored: DataFrame) -> DataFrame:
    """Band, score, fewer parts, name similarity, key."""
    sc = scored.withColumn("complexity", F.col("op").isNotNull().cast("int")
                           + F.col("pred_col").isNotNull().cast("int"))
    w = Window.partitionBy("report_id", "metric").orderBy(
        S.band_rank("band").desc(), F.col("score").desc(), F.col("complexity"),
        F.round("name_sim", 6).desc(), F.col("key"))
    return sc.withColumn("rk", F.row_number().over(w))


G = ["report_id", "metric"]


def resolve(figures: DataFrame, cells: DataFrame, col_order: DataFrame, seeds: DataFrame | None = None,
            sims: DataFrame | None = None, hops: DataFrame | None = None) -> Resolution:
    """``seeds``: candidates of tiers 1 and 3 by metric name (see ``seeded_hits``);
    ``sims`` (``metric, table, column, sim``): name similarity of the columns;
    ``hops`` (``table, other``): the tables one join away from a table (J11, see ``joingraph.paths``)."""
    # report-sized inputs are written once so later self-joins start from a scan
    figs = materialize(S.prepare(figures), "figures")
    groups = materialize(S.metric_groups(figs), "groups")
    points = materialize(S.constraint_points(figs, groups), "points")
    snaps = materialize(S.bind_snapshots(points, S.snapshot_registry(cells)), "snaps")
    gp = S.grand_points(points, snaps).select("report_id", "metric", "table", "snap_as_of", "reported")

    # ---- every candidate of every tier at the grand total
    t2 = _tried(_cid(S.tier2_hits(points, snaps, cells).withColumn("tier", F.lit(2))).withColumn("name_sim", F.lit(0.0)))
    blind = S.filtered_hits(gp, cells, S.filter_columns(cells)).unionByName(S.two_term_hits(gp, cells))
    blind = _tried(_named(_cid(blind.withColumn("tier", F.lit(3))), sims))
    cols = ["report_id", "metric", "tier", "key", *S.CAND_COLS, "computed", "reported", "name_sim", "ok", "err"]
    tried = t2.select(*cols, F.lit("all").alias("origin")).unionByName(blind.select(*cols, F.lit("blind").alias("origin")))
    if seeds is not None:
        tried = tried.unionByName(seeded_hits(seeds, gp, cells).select(*cols, F.lit("seed").alias("origin")))
    tried = materialize(tried.withColumn("cid", F.sha2(F.concat_ws("|", *G, "tier", "origin", "key"), 256)), "tried")

    # ---- tier rules: the first tier with a candidate that meets the total decides
    first = (tried.where("ok AND tier < 3").groupBy(*G).agg(F.min("tier").alias("decided")))
    decided = groups.select(*G).join(first, G, "left").withColumn("decided", F.coalesce("decided", F.lit(3)))
    t2_ran = decided.where("decided >= 2").select(*G)
    open_groups = decided.where("decided = 3").select(*G)
    plain = tried.where("tier < 3").join(decided, G).where("tier = decided").drop("decided")
    t3 = tried.where("tier = 3").join(open_groups, G, "left_semi")

    # one constraint pass scores the survivors of every tier
    surv = plain.where("ok").unionByName(t3.where("ok"))
    cons_all, scored, bindings = score_survivors(surv, points, snaps, cells, col_order)
    scored = materialize(scored.join(surv.select("cid", "origin"), "cid"), "scored")

    # ---- tier-3 scope of blind candidates: accepted tables, this metric's near misses, one hop
    accepted = pick_best(scored.where("tier < 3")).where((F.col("rk") == 1) & (S.band_rank("band") >= 2)).select("table").distinct()
    near = (tried.where((F.col("tier") == 2) & ~F.col("ok") & (F.col("err") <= S.NEAR_MISS_WINDOW))
                 .select(*G, "table").join(open_groups, G, "left_semi"))
    tables = cells.select("table").distinct()
    # the accepted tables go with every open metric: both are lists of the report's size
    on = F.lit(1).alias("on")
    scope = near.unionByName(open_groups.select(*G, on).join(accepted.select("table", on), "on").drop("on"))
    if hops is not None:
        scope = scope.unionByName(scope.join(hops, "table").select(*G, F.col("other").alias("table")))
    scope = materialize(scope.join(tables, "table", "left_semi").select(*G, "table").distinct(), "scope")
    in_scope = [*G, "table"]
    kept = (scored.where("origin <> 'blind'")
            .unionByName(scored.where("origin = 'blind'").join(scope, in_scope, "left_semi").select(*scored.columns)))
    # One candidate per key, with its highest similarity
    w2 = Window.partitionBy(*G, "key").orderBy(F.col("name_sim").desc(), "origin")
    kept = kept.withColumn("r", F.row_number().over(w2)).where("r = 1").drop("r")
    ranked = materialize(pick_best(kept), "ranked")
    constraints = cons_all.join(ranked.select("cid"), "cid", "left_semi")
    best = ranked.where((F.col("rk") == 1) & (S.band_rank("band") >= 2))

    # ---- W5: best near miss among the failed totals of the tiers that ran
    t3_tried = (t3.where("origin = 'seed'").unionByName(t3.where("origin = 'blind'").join(scope, in_scope, "left_semi")))
    tn = S.two_term_nearest(gp.join(scope, in_scope, "left_semi"), cells).withColumn("tier", F.lit(3))
    tn = _tried(_cid(tn).withColumn("name_sim", F.lit(0.0)))
    hits = (tried.where("tier = 1").unionByName(tried.where("tier = 2").join(t2_ran, G, "left_semi")).unionByName(t3_tried)
            .select(*G, "key", "ok", "err").unionByName(tn.select(*G, "key", "ok", "err")))
    wn = Window.partitionBy(*G).orderBy("err", "key")
    near_best = (hits.where(~F.col("ok") & F.col("err").isNotNull()).withColumn("r", F.row_number().over(wn)).where("r = 1")
                     .select(*G, F.col("key").alias("near_key"), F.col("err").alias("near_err")))
    verdicts = materialize(groups.join(best.select(*G, "band", "key", "table", "tier", "satisfied", "total", "score"), G, "left")
                           .join(near_best, G, "left")
                           .withColumn("band", F.coalesce("band", F.lit("UNMAPPABLE"))), "verdicts")
    recheck = tried.select("cid", *G, "tier", "key", *S.CAND_COLS, "computed", "reported", "ok", "err")
    return Resolution(figs, groups, recheck, constraints, ranked, verdicts, bindings)
