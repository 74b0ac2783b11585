"""Constraint solver over the measure cube (J2, J3, J4, J6, J7, A3, A14-A16,
W1, W3, W5, C4-C6).

Everything here joins report-sized tables (figures, candidates) with the
cube-sized long table; no step touches fact rows. Pairings are equi-joins
(on snapshot date, table, measure, dimension cell) plus a tolerance filter,
never cartesian products: two-term candidates are found with a band join
(equi-join on a value bucket, see ``two_term_hits``), so the number of pairs
looked at is proportional to the number of near matches, not ``columns²``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import seq_ratio
from ..functions.numeric import TOLERANCE, raw_value, within_tolerance
from ..sources.snapshots import SNAPSHOT_WINDOW_DAYS

# Fixed values.
NEAR_MISS_WINDOW = 0.6
FUZZY_LABEL_FLOOR = 0.85
BAND_RANK = {"CONFIRMED": 4, "PROBABLE": 3, "WEAK": 2, "REJECTED": 1, "UNMAPPABLE": 0}


# --------------------------------------------------------------------------- figures

def figure_id() -> F.Column:
    """16 hex chars of SHA-256 over ``report|metric|date|k=v;...|value``."""
    dims = F.when(F.col("dim").isNull(), F.lit("")).otherwise(
        F.concat_ws("=", F.col("dim"), F.col("label")))
    return F.substring(F.sha2(F.concat_ws(
        "|", F.col("report_id"), F.col("metric"), F.col("as_of").cast("string"), dims,
        F.col("value").cast("string")), 256), 1, 16)


def prepare(figures: DataFrame) -> DataFrame:
    return (figures.withColumn("raw", raw_value("value", "unit"))
                   .withColumn("figure_id", figure_id()))


def metric_groups(figs: DataFrame) -> DataFrame:
    """Per (report, metric) the grand total is the latest total (first in
    print order on ties); metrics without a total are dropped."""
    totals = figs.where(F.col("dim").isNull())
    w = Window.partitionBy("report_id", "metric").orderBy(F.col("as_of").desc(), F.col("pos"),
                                                          F.col("figure_id"))
    return (totals.withColumn("rk", F.row_number().over(w)).where("rk = 1")
                  .select("report_id", "metric", F.col("figure_id").alias("grand_id"),
                          "as_of", F.col("raw").alias("reported")))


def constraint_points(figs: DataFrame, groups: DataFrame) -> DataFrame:
    """Every constraint of every group: ``kind in (grand_total, breakdown,
    prior_period)`` with the date it is evaluated at. Breakdowns are
    evaluated at the group's date; priors at their own (earlier) date."""
    g = groups.select("report_id", "metric", "grand_id", F.col("as_of").alias("g_as_of"))
    f = figs.join(g, ["report_id", "metric"])
    grand = f.where(F.col("figure_id") == F.col("grand_id")).select(
        "report_id", "metric", F.lit("grand_total").alias("kind"), "figure_id",
        F.col("g_as_of").alias("eval_as_of"), "dim", "label", F.col("raw").alias("reported"))
    brk = f.where(F.col("dim").isNotNull()).select(
        "report_id", "metric", F.lit("breakdown").alias("kind"), "figure_id",
        F.col("g_as_of").alias("eval_as_of"), "dim", "label", F.col("raw").alias("reported"))
    prior = f.where(F.col("dim").isNull() & (F.col("as_of") < F.col("g_as_of"))
                    & (F.col("figure_id") != F.col("grand_id"))).select(
        "report_id", "metric", F.lit("prior_period").alias("kind"), "figure_id",
        F.col("as_of").alias("eval_as_of"), "dim", "label", F.col("raw").alias("reported"))
    return grand.unionByName(brk).unionByName(prior)


# --------------------------------------------------------------------------- snapshots

def snapshot_registry(cells: DataFrame) -> DataFrame:
    snaps = cells.select("table", "as_of").distinct()
    return snaps.withColumn("seq", F.dense_rank().over(Window.partitionBy("table").orderBy("as_of")))


def bind_snapshots(dates: DataFrame, registry: DataFrame,
                   window_days: int = SNAPSHOT_WINDOW_DAYS) -> DataFrame:
    """J2 for every (requested date, table): the last snapshot in commit order
    within ``window_days``. Range join as an equi-join on the 2w+1 candidate
    dates of each request, so no cartesian product is planned."""
    d = (dates.select("eval_as_of").distinct()
              .withColumn("probe", F.explode(F.sequence(
                  F.date_sub("eval_as_of", window_days), F.date_add("eval_as_of", window_days)))))
    m = d.join(registry.withColumnRenamed("as_of", "probe"), "probe")
    w = Window.partitionBy("eval_as_of", "table").orderBy(F.col("seq").desc())
    return (m.withColumn("rk", F.row_number().over(w)).where("rk = 1")
             .select("eval_as_of", "table", F.col("probe").alias("snap_as_of")))


# --------------------------------------------------------------------------- candidates

def grammar_fault() -> F.Column:
    """Why a candidate's parts (``CAND_COLS``) are no candidate; NULL if they are one: an operator goes with a right
    side, a predicate with one term, ``*`` with COUNT."""
    two, pred = F.col("op").isNotNull(), F.col("pred_col").isNotNull()
    star = lambda agg, col: (F.col(col) == "*") & (F.col(agg) != "COUNT")
    return (F.when(F.col("lhs_agg").isNull() | F.col("lhs_col").isNull(), "no aggregate of the grammar")
             .when(two != F.col("rhs_col").isNotNull(), "operator and right side do not go together")
             .when(pred & two, "predicate on two terms")
             .when(star("lhs_agg", "lhs_col") | F.coalesce(star("rhs_agg", "rhs_col"), F.lit(False)), "star outside of COUNT"))


def canonical_key(prefix: str = "") -> F.Column:
    """P5: ``AGG(TABLE.COL) [op AGG(TABLE.COL)] [WHERE COL op 'V']`` upper-cased."""
    p = prefix
    lhs = F.concat(F.col(p + "lhs_agg"), F.lit("("), F.col(p + "table"), F.lit("."),
                   F.col(p + "lhs_col"), F.lit(")"))
    rhs = F.concat(F.lit(" "), F.col(p + "op"), F.lit(" "), F.col(p + "rhs_agg"), F.lit("("),
                   F.col(p + "rhs_table"), F.lit("."), F.col(p + "rhs_col"), F.lit(")"))
    pred = F.concat(F.lit(" WHERE "), F.col(p + "pred_col"), F.col(p + "pred_op"), F.lit("'"),
                    F.col(p + "pred_val"), F.lit("'"))
    return F.upper(F.concat(lhs, F.coalesce(rhs, F.lit("")), F.coalesce(pred, F.lit(""))))


CAND_COLS = ["table", "lhs_agg", "lhs_col", "op", "rhs_table", "rhs_agg", "rhs_col",
             "pred_col", "pred_op", "pred_val"]


def _null(t="string"):
    return F.lit(None).cast(t)


def grand_points(points: DataFrame, snaps: DataFrame) -> DataFrame:
    g = points.where("kind = 'grand_total'")
    return g.join(snaps, "eval_as_of")  # one row per (group, table) with a snapshot


def tier2_hits(points: DataFrame, snaps: DataFrame, cells: DataFrame) -> DataFrame:
    """Every SUM(numeric column) and COUNT(*) of every table at the
    grand-total date, with its error. Equi-join on the snapshot date."""
    g = grand_points(points, snaps)
    tot = cells.where("dim IS NULL AND fcol IS NULL").select(
        "table", F.col("as_of").alias("snap_as_of"), "measure", "s", "n")
    j = g.join(tot, ["table", "snap_as_of"])
    val = F.when(F.col("measure") == "*", F.col("n").cast("decimal(38,6)")).otherwise(
        F.col("s").cast("decimal(38,6)"))
    return j.select(
        "report_id", "metric", "table",
        F.when(F.col("measure") == "*", "COUNT").otherwise("SUM").alias("lhs_agg"),
        F.col("measure").alias("lhs_col"), _null().alias("op"), _null().alias("rhs_table"),
        _null().alias("rhs_agg"), _null().alias("rhs_col"), _null().alias("pred_col"),
        _null().alias("pred_op"), _null().alias("pred_val"),
        val.alias("computed"), "reported")


def filter_columns(cells: DataFrame) -> DataFrame:
    """String columns and their values (any snapshot); which of them are worth
    a filter is decided by the tally, not by their number."""
    return cells.where("fcol IS NOT NULL AND dim IS NULL AND measure = '*'").select("table", "fcol", "fvalue").distinct()


def filtered_hits(gp: DataFrame, cells: DataFrame, fcols: DataFrame) -> DataFrame:
    """``SUM(m) WHERE f = v`` and ``SUM(m) WHERE f <> v`` at the grand
    total date for scoped (group, table) rows. ``=`` is the cell itself;
    ``<>`` is the sum over the other non-null values of ``f`` (NULL rows of
    ``f`` fail both predicates)."""
    c = cells.where("dim IS NULL AND fcol IS NOT NULL AND measure <> '*'").select(
        "table", F.col("as_of").alias("snap_as_of"), "measure", "fcol", "fvalue", "s", "n")
    tot = c.groupBy("table", "snap_as_of", "measure", "fcol").agg(
        F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    base = (gp.join(fcols, "table")
              .join(tot, ["table", "snap_as_of", "fcol"]))
    j = base.join(c, ["table", "snap_as_of", "measure", "fcol", "fvalue"], "left")
    eq = F.col("s").cast("decimal(38,6)")
    ne_n = F.col("tn") - F.coalesce(F.col("n"), F.lit(0))
    ne = F.when(ne_n > 0, (F.col("ts") - F.coalesce(F.col("s"), F.lit(0))).cast("decimal(38,6)"))
    common = ["report_id", "metric", "table", F.lit("SUM").alias("lhs_agg"),
              F.col("measure").alias("lhs_col"), _null().alias("op"), _null().alias("rhs_table"),
              _null().alias("rhs_agg"), _null().alias("rhs_col"), F.col("fcol").alias("pred_col")]
    a = j.select(*common, F.lit("=").alias("pred_op"), F.col("fvalue").alias("pred_val"),
                 eq.alias("computed"), "reported")
    b = j.select(*common, F.lit("<>").alias("pred_op"), F.col("fvalue").alias("pred_val"),
                 ne.alias("computed"), "reported")
    return a.unionByName(b)


def two_term_hits(gp: DataFrame, cells: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """``SUM(a) op SUM(b)`` (a <> b, same table, ``+`` once per pair)
    whose value at the grand-total date is within tolerance.

    Band join instead of all pairs: for target ``r`` and half-width
    ``d = tol*|r|``, ``a + b`` and ``a - b`` need ``b`` in an interval of
    width ``2d`` around ``r - a`` / ``a - r``; with ``b`` bucketed by
    ``floor(b/d)`` that interval lies in at most 3 buckets (5 probed against
    float rounding). ``a / b`` needs ``ln|b|`` in an interval of fixed width
    ``ln((1+tol)/(1-tol))`` (sign of ``b`` fixed by ``a`` and ``r``): 2
    buckets (4 probed). Zero targets are exact-equality joins. Every probed
    pair is re-checked exactly in DECIMAL.
    """
    v = (cells.where("dim IS NULL AND fcol IS NULL AND measure <> '*' AND s IS NOT NULL")
              .select("table", F.col("as_of").alias("snap_as_of"), "measure",
                      F.col("s").cast("decimal(38,6)").alias("v")))
    gv = gp.select("report_id", "metric", "table", "snap_as_of", "reported").join(
        v, ["table", "snap_as_of"])
    r = F.col("reported").cast("double")
    delta = F.abs(r) * tol
    x = F.col("v").cast("double")
    lw = math.log((1 + tol) / (1 - tol))

    right = gv.select("report_id", "metric", "table", F.col("measure").alias("rhs_col"),
                      F.col("v").alias("rv"), "reported")
    outs = []
    # + and -: linear buckets of width d (target non-zero)
    nz = gv.where(F.col("reported") != 0)
    nzr = right.where(F.col("reported") != 0)
    rb = nzr.withColumn("bucket", F.floor(F.col("rv").cast("double") / (F.abs(F.col("reported").cast("double")) * tol))).drop("reported")
    for op, center in (("+", r - x), ("-", x - r)):
        lb = nz.withColumn("bucket", F.explode(F.sequence(
            F.floor((center - delta) / delta) - 1, F.floor((center + delta) / delta) + 1)))
        outs.append(lb.join(rb, ["report_id", "metric", "table", "bucket"])
                      .withColumn("op", F.lit(op)))
    # /: log buckets of fixed width; sign(b) = sign(a) * sign(r)
    nzv = nz.where(F.col("v") != 0)
    rlog = (nzr.where(F.col("rv") != 0)
               .withColumn("sgn", F.signum(F.col("rv").cast("double")))
               .withColumn("bucket", F.floor(F.log(F.abs(F.col("rv").cast("double"))) / lw))
               .drop("reported"))
    need = F.log(F.abs(x)) - F.log(F.abs(r))
    lb = (nzv.withColumn("sgn", F.signum(x) * F.signum(r))
             .withColumn("bucket", F.explode(F.sequence(
                 F.floor((need - lw) / lw) - 1, F.floor((need + lw) / lw) + 1))))
    outs.append(lb.join(rlog, ["report_id", "metric", "table", "bucket", "sgn"])
                  .drop("sgn").withColumn("op", F.lit("/")))
    # zero targets: a + b = 0, a - b = 0, a / b = 0 exactly
    z = gv.where(F.col("reported") == 0)
    zr = right.where(F.col("reported") == 0)
    zj = z.join(zr, ["report_id", "metric", "table", "reported"])
    outs.append(zj.where(F.col("v") == -F.col("rv")).withColumn("op", F.lit("+")))
    outs.append(zj.where(F.col("v") == F.col("rv")).withColumn("op", F.lit("-")))
    outs.append(zj.where((F.col("v") == 0) & (F.col("rv") != 0)).withColumn("op", F.lit("/")))

    cols = ["report_id", "metric", "table", "measure", "v", "rhs_col", "rv", "op", "reported"]
    allp = outs[0].select(*cols)
    for o in outs[1:]:
        allp = allp.unionByName(o.select(*cols))
    a, b = F.col("v"), F.col("rv")
    comp = (F.when(F.col("op") == "+", a + b).when(F.col("op") == "-", a - b)
             .otherwise(F.try_divide(a, b))).cast("decimal(38,6)")
    pairs = (allp.where(F.col("measure") != F.col("rhs_col"))
                 .where((F.col("op") != "+") | (F.col("measure") < F.col("rhs_col")))
                 .withColumn("computed", comp)
                 .where(within_tolerance("computed", "reported", tol))
                 .dropDuplicates(["report_id", "metric", "table", "measure", "rhs_col", "op"]))
    return pairs.select(
        "report_id", "metric", "table", F.lit("SUM").alias("lhs_agg"),
        F.col("measure").alias("lhs_col"), "op", F.col("table").alias("rhs_table"),
        F.lit("SUM").alias("rhs_agg"), "rhs_col", _null().alias("pred_col"),
        _null().alias("pred_op"), _null().alias("pred_val"), "computed", "reported")


# --------------------------------------------------------------------------- evaluation

def evaluate(cands: DataFrame, points: DataFrame, cells: DataFrame) -> DataFrame:
    """A1-A3 at arbitrary cells: value of every candidate at every point.

    ``cands``: ``cid`` + CAND_COLS. ``points``: ``cid, pid, snap_as_of, dim,
    dim_value``. Returns ``cid, pid, computed`` (NULL = not evaluable).
    Terms are matched to cube cells by equi-join (null-safe on the
    dimension), ``<>`` filters summed over the other values.
    """
    lhs = cands.select("cid", F.lit("l").alias("side"), "table", F.col("lhs_agg").alias("agg"),
                       F.col("lhs_col").alias("col"), "pred_col", "pred_op", "pred_val")
    rhs = cands.where(F.col("op").isNotNull()).select(
        "cid", F.lit("r").alias("side"), F.col("rhs_table").alias("table"),
        F.col("rhs_agg").alias("agg"), F.col("rhs_col").alias("col"),
        _null().alias("pred_col"), _null().alias("pred_op"), _null().alias("pred_val"))
    terms = lhs.unionByName(rhs)
    tp = terms.join(points, "cid")
    c = cells.select("table", F.col("as_of").alias("snap_as_of"), F.col("dim").alias("c_dim"),
                     F.col("dim_value").alias("c_dv"), F.col("fcol").alias("c_fcol"),
                     F.col("fvalue").alias("c_fv"), F.col("measure").alias("col"), "s", "n")
    cond = [tp["table"] == c["table"], tp["snap_as_of"] == c["snap_as_of"], tp["col"] == c["col"],
            tp["dim"].eqNullSafe(c["c_dim"]), tp["dim_value"].eqNullSafe(c["c_dv"]),
            tp["pred_col"].eqNullSafe(c["c_fcol"])]
    j = tp.join(c, cond, "left").where(
        F.col("pred_op").isNull() | F.col("c_fv").isNull()
        | ((F.col("pred_op") == "=") & (F.col("c_fv") == F.col("pred_val")))
        | ((F.col("pred_op") == "<>") & (F.col("c_fv") != F.col("pred_val"))))
    agg = j.groupBy("cid", "pid", "side", "agg").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"),
        F.count(c["snap_as_of"]).alias("matched"))
    val = (F.when(F.col("matched") == 0, _null("decimal(38,6)"))
            .when(F.col("agg") == "SUM", F.col("s").cast("decimal(38,6)"))
            .when(F.col("agg") == "COUNT", F.col("n").cast("decimal(38,6)"))
            .when(F.col("agg") == "AVG", F.try_divide(F.col("s"), F.col("n").cast("decimal(20,0)")))
            ).cast("decimal(38,6)")
    tv = agg.select("cid", "pid", "side", val.alias("v"))
    l = tv.where("side = 'l'").select("cid", "pid", F.col("v").alias("lv"))
    r = tv.where("side = 'r'").select("cid", "pid", F.col("v").alias("rv"))
    ops = cands.select("cid", "op")
    out = (points.select("cid", "pid").join(ops, "cid")
                 .join(l, ["cid", "pid"], "left").join(r, ["cid", "pid"], "left"))
    a, b = F.col("lv"), F.col("rv")
    comp = (F.when(F.col("op").isNull(), a).when(F.col("op") == "+", a + b)
             .when(F.col("op") == "-", a - b).when(F.col("op") == "/", F.try_divide(a, b)))
    return out.select("cid", "pid", comp.cast("decimal(38,6)").alias("computed"))


# --------------------------------------------------------------------------- labels

def _grams(text, n: int) -> F.Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def label_matches(labels: DataFrame, values: DataFrame) -> DataFrame:
    """Best value per (label, column): exact (case-insensitive) first,
    then a value of 3+ chars embedded in the label, then fuzzy ratio >= 0.85.

    All three are equi-joins: on the lower-cased text; of the label's runs of
    three characters with the value's first three; of runs of two characters,
    of which a ratio of 0.85 always leaves one in common.

    ``labels``: ``key..., table, snap_as_of, label``;
    ``values``: ``table, snap_as_of, column, value``. Returns ``key...,
    table, column, label, value``.
    """
    at = ["table", "snap_as_of"]
    ll = labels.select(*at, "label").distinct().withColumn("ll", F.lower("label"))
    vv = values.select(*at, "value").distinct().withColumn("lv", F.lower("value"))
    exact = ll.join(vv, (ll["ll"] == vv["lv"]) & (ll["table"] == vv["table"]) & (ll["snap_as_of"] == vv["snap_as_of"])) \
              .select(ll["table"], ll["snap_as_of"], "label", "value", F.lit(1).alias("pri"), F.lit(1.0).alias("ratio"))
    l3 = ll.select(*at, "label", "ll", F.explode(_grams(F.col("ll"), 3)).alias("g"))
    v3 = vv.where(F.length("value") >= 3).select(*at, "value", "lv", F.substring("lv", 1, 3).alias("g"))
    embedded = (l3.join(v3, [*at, "g"]).where((F.instr("ll", F.col("lv")) > 0) & (F.col("ll") != F.col("lv")))
                  .select(*at, "label", "value", F.lit(2).alias("pri"), F.lit(1.0).alias("ratio")).distinct())
    l2 = ll.select(*at, "label", "ll", F.explode(_grams(F.col("ll"), 2)).alias("g"))
    v2 = vv.select(*at, "value", "lv", F.explode(_grams(F.col("lv"), 2)).alias("g"))
    bound = 2.0 * F.least(F.length("ll"), F.length("lv")) / (F.length("ll") + F.length("lv"))
    fuzzy = (l2.join(v2, [*at, "g"]).where((bound >= FUZZY_LABEL_FLOOR) & (F.col("ll") != F.col("lv"))
                                           & ((F.length("value") < 3) | (F.instr("ll", F.col("lv")) == 0)))
               .select(*at, "label", "value", "ll", "lv").distinct()
               .withColumn("ratio", seq_ratio("ll", "lv")).where(F.col("ratio") >= FUZZY_LABEL_FLOOR)
               .select(*at, "label", "value", F.lit(3).alias("pri"), "ratio"))
    m = labels.join(exact.unionByName(embedded).unionByName(fuzzy), [*at, "label"]).join(values, [*at, "value"])
    keys = [c for c in labels.columns if c not in ("snap_as_of",)]
    w = Window.partitionBy(*keys, "column").orderBy("pri", F.col("ratio").desc(), "value")
    return m.withColumn("rk", F.row_number().over(w)).where("rk = 1").select(*keys, "column", "value")


def bind_dimensions(labels: DataFrame, values: DataFrame, col_order: DataFrame) -> DataFrame:
    """Per (key..., table) the first column (measure table first, then
    one hop; schema order) whose values account for every label, each label
    to a different value. Returns ``key..., table, column, label, value``."""
    keys = [c for c in labels.columns if c not in ("snap_as_of", "label", "table")]
    n_labels = labels.groupBy(*keys, "table").agg(F.countDistinct("label").alias("nl"))
    m = label_matches(labels, values)
    cover = (m.groupBy(*keys, "table", "column")
              .agg(F.countDistinct("label").alias("ml"), F.countDistinct("value").alias("mv"))
              .join(n_labels, keys + ["table"])
              .where((F.col("ml") == F.col("nl")) & (F.col("mv") == F.col("nl")))
              .join(col_order, ["table", "column"]))
    w = Window.partitionBy(*keys, "table").orderBy("hop", "ordinal", "column")
    best = cover.withColumn("rk", F.row_number().over(w)).where("rk = 1").select(*keys, "table", "column")
    return m.join(best, keys + ["table", "column"])


# --------------------------------------------------------------------------- scoring

def band(satisfied, total, grand_ok) -> F.Column:
    """A15."""
    s, t = F.col(satisfied), F.col(total)
    ratio = s / t
    return (F.when(~F.col(grand_ok), "REJECTED")
             .when(t == 1, "WEAK")
             .when((s >= 4) & (ratio >= 0.90), "CONFIRMED")
             .when((s >= 2) & (ratio >= 0.75), "PROBABLE")
             .otherwise("REJECTED"))


def band_rank(col: str) -> F.Column:
    e = F.lit(0)
    for k, v in BAND_RANK.items():
        e = F.when(F.col(col) == k, F.lit(v)).otherwise(e)
    return e


# distinct partner values looked at on each side of the passing interval: the
# nearest one may be the column itself, another one may lie within rounding of
# the interval's end and pass
_SIDE = 3


def two_term_nearest(gp: DataFrame, cells: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """W5 for two-term candidates: the closest *failing* pairs, without
    enumerating all pairs.

    For a first term ``a`` the partners ``b`` that pass lie in an interval
    (``r - a`` or ``a - r`` plus or minus ``tol * |r|``; for ``a / b`` around
    ``a / r`` on the log scale), and outside of it the error grows with the
    distance, so the best failing partner is the first distinct value below or
    above the interval that is not the column itself. Values are found by
    rank: each end gets the number of distinct values before it (a running
    count over the union, per metric and table) and values join on rank, with
    their two first columns by name. For ``/`` the partners of the other sign
    have an error that falls with ``|b|``: the largest serve.
    """
    v = (cells.where("dim IS NULL AND fcol IS NULL AND measure <> '*' AND s IS NOT NULL")
              .select("table", F.col("as_of").alias("snap_as_of"), "measure",
                      F.col("s").cast("decimal(38,6)").alias("v")))
    gv = gp.select("report_id", "metric", "table", "snap_as_of", "reported").join(
        v, ["table", "snap_as_of"])
    keys = ["report_id", "metric", "table", "cls"]
    r = F.col("reported").cast("double")
    x = F.col("v").cast("double")

    def distinct(points):
        """Distinct partner values, numbered, with their two first columns."""
        d = points.groupBy(*keys, "pv", "rv").agg(F.slice(F.array_sort(F.collect_set("rhs_col")), 1, 2).alias("cols"))
        return d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("pv", "rv")))

    def neighbours(points, queries):
        d = distinct(points)
        ends = (queries.select(*keys, F.col("lo").alias("val"), F.lit(0).alias("hi")).unionByName(
                queries.select(*keys, F.col("hi").alias("val"), F.lit(1).alias("hi"))).distinct())
        # a value equal to an end counts as beyond it on both sides
        line = (d.select(*keys, F.col("pv").alias("val"), F.lit(None).cast("int").alias("hi"), F.lit(1).alias("p"), F.lit(1).alias("o"))
                .unionByName(ends.select(*keys, "val", "hi", F.lit(0).alias("p"), F.when(F.col("hi") == 0, 2).otherwise(0).alias("o"))))
        w = Window.partitionBy(*keys).orderBy("val", "o").rowsBetween(Window.unboundedPreceding, 0)
        n = line.withColumn("n", F.sum("p").over(w)).where("p = 0").select(*keys, "val", "hi", "n").distinct()
        low = n.where("hi = 0").select(*keys, F.col("val").alias("lo"), F.explode(F.sequence(F.col("n") - (_SIDE - 1), F.col("n"))).alias("rank"))
        high = n.where("hi = 1").select(*keys, F.col("val").alias("hi"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + _SIDE)).alias("rank"))
        near = queries.join(low, [*keys, "lo"]).unionByName(queries.join(high, [*keys, "hi"]), allowMissingColumns=False)
        return near.join(d, [*keys, "rank"]).withColumn("rhs_col", F.explode("cols")).drop("cols", "rank", "lo", "hi")

    base = gv.select("report_id", "metric", "table", "reported", "measure", "v")
    pts_lin = gv.select("report_id", "metric", "table", F.lit(0).alias("cls"),
                        F.col("measure").alias("rhs_col"), F.col("v").alias("rv"),
                        F.col("v").cast("double").alias("pv"))
    inside = F.abs(r) * tol * (1 - 1e-9)
    cols = ["report_id", "metric", "table", "measure", "v", "rhs_col", "rv", "op", "reported"]
    outs = []
    for op, t in (("+", r - x), ("-", x - r)):
        q = base.select("report_id", "metric", "table", F.lit(0).alias("cls"), "measure", "v",
                        "reported", (t - inside).alias("lo"), (t + inside).alias("hi"))
        outs.append(neighbours(pts_lin, q).withColumn("op", F.lit(op)).select(*cols))
    # division: partners by sign class on log|b|
    nzb = gv.where(F.col("v") != 0)
    pts_log = nzb.select("report_id", "metric", "table",
                         F.signum(F.col("v").cast("double")).cast("int").alias("cls"),
                         F.col("measure").alias("rhs_col"), F.col("v").alias("rv"),
                         F.log(F.abs(F.col("v").cast("double"))).alias("pv"))
    mid = F.log(F.abs(x)) - F.log(F.abs(r))
    qd = (base.where((F.col("reported") != 0) & (F.col("v") != 0))
              .select("report_id", "metric", "table",
                      (F.signum(x) * F.signum(r)).cast("int").alias("cls"), "measure", "v", "reported",
                      (mid - F.log(F.lit(1 + tol)) * (1 - 1e-9)).alias("lo"), (mid - F.log(F.lit(1 - tol)) * (1 - 1e-9)).alias("hi")))
    outs.append(neighbours(pts_log, qd).withColumn("op", F.lit("/")).select(*cols))
    # largest |b| of each sign class, for every a
    d = distinct(pts_log)
    top = (d.withColumn("back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("pv").desc(), "rv"))).where(F.col("back") <= _SIDE)
             .select("report_id", "metric", "table", "rv", F.explode("cols").alias("rhs_col")))
    outs.append(base.join(top, ["report_id", "metric", "table"]).withColumn("op", F.lit("/")).select(*cols))

    allp = outs[0].select(*cols)
    for o in outs[1:]:
        allp = allp.unionByName(o.select(*cols))
    a, b = F.col("v"), F.col("rv")
    comp = (F.when(F.col("op") == "+", a + b).when(F.col("op") == "-", a - b)
             .otherwise(F.try_divide(a, b))).cast("decimal(38,6)")
    lo = F.least("measure", "rhs_col")
    hi = F.greatest("measure", "rhs_col")
    pairs = (allp.where(F.col("measure") != F.col("rhs_col"))
                 .withColumn("computed", comp)
                 .withColumn("c1", F.when(F.col("op") == "+", lo).otherwise(F.col("measure")))
                 .withColumn("c2", F.when(F.col("op") == "+", hi).otherwise(F.col("rhs_col")))
                 .where(~within_tolerance("computed", "reported"))
                 .dropDuplicates(["report_id", "metric", "table", "c1", "c2", "op"]))
    return pairs.select(
        "report_id", "metric", "table", F.lit("SUM").alias("lhs_agg"), F.col("c1").alias("lhs_col"),
        "op", F.col("table").alias("rhs_table"), F.lit("SUM").alias("rhs_agg"),
        F.col("c2").alias("rhs_col"), _null().alias("pred_col"), _null().alias("pred_op"),
        _null().alias("pred_val"), "computed", "reported")
