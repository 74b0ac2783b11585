"""Published tables and the scorecard (K1-K4, A19-A22, C16, J20, P8, P13,
F25, F31, W4, W10).

Everything here reads the resolution of the report (verdicts, scored
candidates, constraint rows, dimension bindings) and shapes it into the
tables a catalog or semantic layer would ingest; JSON/YAML rendering is
left to the consumer (``to_json`` per row where nesting is wanted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import solve as S
from . import report as R
from .fingerprint_queries import _resolution

# Trust of a band, auto-merge threshold.
BAND_TRUST = {"CONFIRMED": 0.97, "PROBABLE": 0.85, "WEAK": 0.60}
AUTO_MERGE = 0.85

# The planted truth of the report fixture.
GOLD = [
    ("rpt_q1", "Order Value", "SUM(ORDERS.O_TOTALPRICE)"),
    ("rpt_q1", "Order Count", "COUNT(ORDERS.*)"),
    ("rpt_q1", "Shipped Quantity", "SUM(LINEITEM.L_QUANTITY)"),
    ("rpt_q1", "Line Count", "COUNT(LINEITEM.*)"),
    ("rpt_q1", "Capital Buffer", None),
    ("rpt_q2", "Booked Order Value", "SUM(ORDERS.O_TOTALPRICE)"),
    ("rpt_q2", "Order Count", "COUNT(ORDERS.*)"),
    ("rpt_q2", "Shipped Quantity", "SUM(LINEITEM.L_QUANTITY) WHERE L_RETURNFLAG<>'R'"),
    ("rpt_q2", "Average Unit Price", "SUM(LINEITEM.L_EXTENDEDPRICE) / SUM(LINEITEM.L_QUANTITY)"),
    ("rpt_q2", "Capital Buffer", None),
]
TRAP_KEYS = ["SUM(ORDERS.O_TOTALPRICE_V1)"]
GOLD_DRIFT = [("renamed", "Order Value", "Booked Order Value"), ("redefined", "Shipped Quantity", "Shipped Quantity"),
              ("appeared", None, "Average Unit Price"), ("disappeared", "Line Count", None)]


def _trust(band: str) -> F.Column:
    e = F.lit(None).cast("double")
    for k, v in BAND_TRUST.items():
        e = F.when(F.col(band) == k, F.lit(v)).otherwise(e)
    return e


def _slug(name: str) -> F.Column:
    return F.concat(F.lit("m_"), F.regexp_replace(F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]+", "_"),
                                                  "^_+|_+$", ""))


def _metric_type() -> F.Column:
    return (F.when(F.col("op") == "/", "ratio").when(F.col("op").isin("+", "-"), "derived")
             .when(F.col("lhs_agg") == "COUNT", "count").when(F.col("lhs_agg") == "AVG", "average")
             .otherwise("sum"))


def _accepted(spark, sf_dir) -> DataFrame:
    """Best accepted mapping per (report, metric) with its edition date."""
    res = _resolution(spark, sf_dir)
    eds = res.figures.select("report_id", "edition_as_of").distinct()
    best = res.scored.where((F.col("rk") == 1) & (S.band_rank("band") >= 2))
    return best.join(eds, "report_id")


def _latest(df: DataFrame) -> DataFrame:
    """Latest edition wins per metric (date, then report id)."""
    w = Window.partitionBy("metric").orderBy(F.col("edition_as_of").desc(), F.col("report_id").desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _grouping(spark, sf_dir) -> DataFrame:
    """``report_id, metric, dim, table, column``: the columns that the breakdowns of accepted mappings are bound to."""
    b = _resolution(spark, sf_dir).bindings.select("report_id", "metric", "dim", "table", "column").distinct()
    return b.join(_accepted(spark, sf_dir).select("report_id", "metric", "table"), ["report_id", "metric", "table"], "left_semi")


def _joined_edges(spark) -> DataFrame:
    """Columns of a mart that come from a reference table, with the edge they come by."""
    return spark.createDataFrame([(t, c, *e) for (t, c), e in R.JOINED_EDGES.items()],
                                 "table string, column string, from_column string, to_table string, to_column string")


def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: one glossary term per metric (latest edition), with trust and the
    review flag (P8, P13, F25)."""
    a = _latest(_accepted(spark, sf_dir))
    return a.select("metric", _slug("metric").alias("slug"), F.col("key").alias("definition"), "band",
                    _trust("band").alias("trust"), (_trust("band") < AUTO_MERGE).alias("review_required"),
                    _metric_type().alias("metric_type"), "report_id")


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column -> metric edges of accepted mappings, with the ids of
    the satisfied constraints as provenance."""
    res = _resolution(spark, sf_dir)
    a = _accepted(spark, sf_dir)
    cols = (a.select("report_id", "metric", "cid", "table", F.col("lhs_col").alias("column"))
             .unionByName(a.where(F.col("rhs_col").isNotNull())
                           .select("report_id", "metric", "cid", F.col("rhs_table").alias("table"),
                                   F.col("rhs_col").alias("column"))))
    prov = (res.constraints.where("ok").groupBy("cid")
               .agg(F.count(F.lit(1)).cast("bigint").alias("n_satisfied"),
                    F.sort_array(F.collect_set("kind")).alias("kinds")))
    return (cols.join(prov, "cid").select("report_id", "metric", "table", "column", "n_satisfied",
                                          F.array_join("kinds", ",").alias("kinds")))


def glossary_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the glossary terms as a catalog takes them: the sentence of the
    report's commentary as description (else what reproduces the metric), the
    names that a rename left behind as synonyms, and the provenance: constraints
    met and the places of the report they stand at (J20)."""
    from .fingerprint_queries import drift_register
    from .text_queries import commentary, statements
    res = _resolution(spark, sf_dir)
    a = _latest(_accepted(spark, sf_dir))
    said = statements(commentary(spark, sf_dir)).select(F.col("doc"), F.lower("metric_name").alias("lname"), "sentence")
    hint = (a.select("report_id", "metric").join(said, (F.lower("metric") == F.col("lname"))
                                                 & F.col("doc").startswith(F.concat(F.lit("cmt-"), F.col("report_id"), F.lit("-"))))
             .groupBy("report_id", "metric").agg(F.min("sentence").alias("hint")))
    old = (drift_register(spark, sf_dir).where("kind = 'renamed'").groupBy(F.col("new_name").alias("metric"))
           .agg(F.array_join(F.array_sort(F.collect_set("old_name")), ",").alias("synonyms")))
    places = (res.constraints.where("ok").join(res.figures.select("figure_id", "pos"), "figure_id")
              .groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_set("pos")), lambda p: F.concat(F.lit("#"), p.cast("string"))), ",").alias("places")))
    x = a.join(hint, ["report_id", "metric"], "left").join(old, "metric", "left").join(places, "cid", "left")
    plain = F.concat("metric", F.lit(", as published in report "), "report_id", F.lit("; reproduced by "), "key", F.lit("."))
    return x.select(_slug("metric").alias("name"), F.col("metric").alias("display_name"), F.coalesce("hint", plain).alias("description"),
                    F.coalesce("synonyms", F.lit("")).alias("synonyms"), "band", "key", "report_id",
                    F.col("satisfied").cast("bigint").alias("n_satisfied"), F.col("total").cast("bigint").alias("n_total"),
                    F.coalesce("places", F.lit("")).alias("source_locators"))


def column_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of physical columns: measure (used by an accepted mapping),
    filter (its predicate), grouping (bound to a report dimension; of a joined
    column, the one of the reference table)."""
    a = _accepted(spark, sf_dir)
    meas = (a.select("table", F.col("lhs_col").alias("column"))
             .unionByName(a.where(F.col("rhs_col").isNotNull()).select(F.col("rhs_table").alias("table"),
                                                                        F.col("rhs_col").alias("column")))
             .where(F.col("column") != "*").withColumn("tag", F.lit("measure")))
    filt = (a.where(F.col("pred_col").isNotNull()).select("table", F.col("pred_col").alias("column"))
             .withColumn("tag", F.lit("filter")))
    grp = (_grouping(spark, sf_dir).join(_joined_edges(spark), ["table", "column"], "left")
           .select(F.coalesce("to_table", "table").alias("table"), "column", F.lit("grouping").alias("tag")))
    return (meas.unionByName(filt).unionByName(grp).groupBy("table", "column")
                .agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags")))


def semantic_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3/F31 per table: measures (deduplicated per table, column and
    aggregation), metrics (latest edition), dimensions (breakdowns bound to a
    column of the table), entities and relationships (the keys by which bound
    columns are joined)."""
    a = _latest(_accepted(spark, sf_dir))
    none = F.lit(None).cast("double")
    m1 = a.select("table", F.col("lhs_agg").alias("agg"), F.col("lhs_col").alias("column"))
    m2 = a.where(F.col("rhs_col").isNotNull()).select(F.col("rhs_table").alias("table"),
                                                      F.col("rhs_agg").alias("agg"), F.col("rhs_col").alias("column"))
    measures = (m1.unionByName(m2).distinct()
                  .select("table", F.lit("measure").alias("kind"),
                          F.when(F.col("column") == "*", F.lit("row_count"))
                           .otherwise(F.concat(F.lower("agg"), F.lit("_"), F.col("column"))).alias("name"),
                          "agg", F.when(F.col("column") == "*", F.lit("1")).otherwise(F.col("column")).alias("expr"),
                          none.alias("trust")))
    metrics = a.select("table", F.lit("metric").alias("kind"), _slug("metric").alias("name"),
                       _metric_type().alias("agg"), F.col("key").alias("expr"), _trust("band").alias("trust"))
    bound = (_grouping(spark, sf_dir).join(a.select("report_id", "metric"), ["report_id", "metric"], "left_semi")
             .select("table", "dim", "column").distinct().join(_joined_edges(spark), ["table", "column"], "left"))
    dims = bound.where("to_table IS NULL").select("table", F.lit("dimension").alias("kind"), F.col("dim").alias("name"),
                                                  F.lit("categorical").alias("agg"), F.col("column").alias("expr"), none.alias("trust"))
    keys = bound.where("to_table IS NOT NULL").select("table", "from_column", "to_table", "to_column").distinct()
    entities = keys.select("table", F.lit("entity").alias("kind"), F.col("from_column").alias("name"), F.lit("foreign").alias("agg"),
                           F.col("from_column").alias("expr"), none.alias("trust"))
    rel = keys.select("table", F.lit("relationship").alias("kind"), F.col("to_table").alias("name"), F.lit("INNER").alias("agg"),
                      F.concat("table", F.lit("."), "from_column", F.lit(" = "), "to_table", F.lit("."), "to_column").alias("expr"), none.alias("trust"))
    return measures.unionByName(metrics).unionByName(dims).unionByName(entities).unionByName(rel)


def conflict_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per metric of every edition: confirmed / probable /
    weak with its constraint summary, or unmappable with the near miss."""
    res = _resolution(spark, sf_dir)
    best = res.scored.where(F.col("rk") == 1)
    brk = (res.constraints.join(best.select("cid", "report_id", "metric"), ["cid", "report_id", "metric"])
              .groupBy("report_id", "metric")
              .agg(F.count_if((F.col("kind") == "breakdown") & F.col("ok")).cast("bigint").alias("breakdowns_ok"),
                   F.count_if(F.col("kind") == "breakdown").cast("bigint").alias("breakdowns"),
                   F.count_if((F.col("kind") == "prior_period") & F.col("ok")).cast("bigint").alias("priors_ok")))
    # Breakdowns reproduced per dimension, prior figures
    met = (res.constraints.where("ok").join(best.select("cid", "report_id", "metric"), ["cid", "report_id", "metric"])
              .join(res.figures.select("figure_id", "dim"), "figure_id"))
    per = (met.where("kind = 'breakdown'").groupBy("report_id", "metric", "dim").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("report_id", "metric").agg(F.array_sort(F.collect_list(F.struct("dim", "n"))).alias("dims")))
    v = res.verdicts.join(brk, ["report_id", "metric"], "left").join(per, ["report_id", "metric"], "left")
    priors = F.coalesce("priors_ok", F.lit(0))
    extras = F.concat(F.transform(F.coalesce("dims", F.array().cast("array<struct<dim:string,n:bigint>>")),
                                  lambda d: F.concat(d["n"].cast("string"), F.lit(" "), d["dim"], F.lit(" breakdowns"))),
                      F.when(priors > 0, F.array(F.concat(priors.cast("string"), F.lit(" prior-period figure"),
                                                          F.when(priors > 1, F.lit("s")).otherwise(F.lit(""))))).otherwise(F.array().cast("array<string>")))
    head = F.concat(F.col("satisfied").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" figures reproduced"))
    summary = F.when(F.col("satisfied").isNotNull(), F.when(F.size(extras) > 0, F.concat(head, F.lit(", incl. "), F.array_join(extras, ", "))).otherwise(head))
    section = F.when(F.col("band") == "UNMAPPABLE", "unmappable").otherwise(F.lower("band"))
    return v.select("report_id", "metric", section.alias("section"), "key", "near_key",
                    F.coalesce("breakdowns_ok", F.lit(0)).cast("bigint").alias("breakdowns_ok"),
                    F.coalesce("breakdowns", F.lit(0)).cast("bigint").alias("breakdowns"),
                    F.coalesce("priors_ok", F.lit(0)).cast("bigint").alias("priors_ok"), summary.alias("constraints"))


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's planted truth against the verdicts and the
    drift register."""
    from .fingerprint_queries import drift_register
    res = _resolution(spark, sf_dir)
    gold = spark.createDataFrame(GOLD, "report_id string, metric string, gold_key string")
    v = res.verdicts.select("report_id", "metric", "band", "key")
    j = gold.join(v, ["report_id", "metric"], "left")
    mappable = F.col("gold_key").isNotNull()
    correct = mappable & (F.col("key") == F.col("gold_key")) & F.col("band").isin("CONFIRMED", "PROBABLE")
    conf = F.col("band") == "CONFIRMED"
    m = j.agg(
        (F.count_if(correct) / F.count_if(mappable)).alias("mapping_recall"),
        (F.count_if(conf & (F.col("key") == F.col("gold_key"))) / F.count_if(conf)).alias("precision_confirmed"),
        F.try_divide(F.count_if((F.col("band") == "PROBABLE") & (F.col("key") == F.col("gold_key"))),
                     F.count_if(F.col("band") == "PROBABLE")).alias("precision_probable"),
        (F.count_if(~mappable & (F.col("band") == "UNMAPPABLE")) / F.count_if(~mappable)).alias("unmappable_accuracy"),
        F.count_if(F.col("key").isin(*TRAP_KEYS)).alias("traps_chosen"))
    gd = spark.createDataFrame(GOLD_DRIFT, "kind string, old_name string, new_name string")
    found = drift_register(spark, sf_dir)
    hit = gd.join(found, [gd.kind == found.kind, gd.old_name.eqNullSafe(found.old_name),
                          gd.new_name.eqNullSafe(found.new_name)], "left_semi")
    d = hit.agg(F.count(F.lit(1)).alias("drift_found"))
    def chk(name, value, passed):
        return F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"),
                        passed.alias("passed"))
    checks = m.select(F.explode(F.array(
        chk("mapping_recall", F.col("mapping_recall"), F.col("mapping_recall") == 1),
        chk("precision_confirmed", F.col("precision_confirmed"), F.col("precision_confirmed") == 1),
        chk("precision_probable", F.col("precision_probable"), F.coalesce(F.col("precision_probable") == 1, F.lit(True))),
        chk("unmappable_accuracy", F.col("unmappable_accuracy"), F.col("unmappable_accuracy") == 1),
        chk("traps_rejected", F.lit(len(TRAP_KEYS)) - F.col("traps_chosen"), F.col("traps_chosen") == 0),
    )).alias("c")).select("c.*")
    checks = checks.unionByName(d.select(F.lit("drift_found").alias("check"),
                                         F.col("drift_found").cast("double").alias("value"),
                                         (F.col("drift_found") == len(GOLD_DRIFT)).alias("passed")))
    from .report_text import extraction_recall
    x = extraction_recall(spark, sf_dir).agg(F.try_divide(F.sum("found"), F.sum("published")).alias("v"))
    checks = checks.unionByName(x.select(F.lit("extraction_recall").alias("check"), F.col("v").cast("double").alias("value"), (F.col("v") >= 0.95).alias("passed")))
    return checks.select("check", F.round("value", 6).alias("value"), "passed")


def parse_keys(df: DataFrame, key_col: str) -> DataFrame:
    """candidate key text -> structured candidate columns."""
    from ..functions.sqltext import KEY_EXPR, KEY_PRED
    e = F.substring_index(F.col(key_col), " WHERE ", 1)
    p = F.when(F.instr(F.col(key_col), " WHERE ") > 0, F.substring_index(F.col(key_col), " WHERE ", -1))
    g = lambda i: F.nullif(F.regexp_extract(e, KEY_EXPR, i), F.lit(""))
    h = lambda i: F.nullif(F.regexp_extract(p, KEY_PRED, i), F.lit(""))
    return df.select("*", g(1).alias("lhs_agg"), F.lower(g(2)).alias("table"), F.lower(g(3)).alias("lhs_col"),
                     g(4).alias("op"), g(5).alias("rhs_agg"), F.lower(g(6)).alias("rhs_table"),
                     F.lower(g(7)).alias("rhs_col"), F.lower(h(1)).alias("pred_col"), h(2).alias("pred_op"),
                     h(3).alias("pred_val"))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolved expression of every mappable gold metric against
    the gold expression, at the snapshots of its table that the report binds to."""
    return _against_gold(spark, sf_dir, R.report_cube(spark, sf_dir))


def _against_gold(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    """Both expressions of every mappable gold metric, evaluated at every
    snapshot of its table in ``cells``; the result sets (values rounded to 2)
    must be equal as multisets."""
    res = _resolution(spark, sf_dir)
    gold = spark.createDataFrame([g for g in GOLD if g[2]], "report_id string, metric string, gold_key string")
    v = res.verdicts.select("report_id", "metric", "key").where(F.col("key").isNotNull())
    pairs = gold.join(v, ["report_id", "metric"])
    sides = (pairs.select("report_id", "metric", F.lit("gold").alias("side"), F.col("gold_key").alias("k"))
                  .unionByName(pairs.select("report_id", "metric", F.lit("found").alias("side"),
                                            F.col("key").alias("k"))))
    c = parse_keys(sides, "k").withColumn("cid", F.sha2(F.concat_ws("|", "report_id", "metric", "side"), 256))
    snaps = cells.select("table", F.col("as_of").alias("snap_as_of")).distinct()
    pts = (c.select("cid", "table").join(snaps, "table")
            .select("cid", F.col("snap_as_of").cast("string").alias("pid"), "snap_as_of",
                    F.lit(None).cast("string").alias("dim"), F.lit(None).cast("string").alias("dim_value")))
    from ..operators.solve import CAND_COLS, evaluate
    ev = evaluate(c.select("cid", *CAND_COLS), pts, cells)
    vals = (ev.join(c.select("cid", "report_id", "metric", "side"), "cid")
              .select("report_id", "metric", "side", "pid", F.round(F.col("computed").cast("double"), 2).alias("v")))
    g_ = vals.where("side = 'gold'").select("report_id", "metric", "pid", "v")
    f_ = vals.where("side = 'found'").select("report_id", "metric", "pid", "v")
    diff = g_.exceptAll(f_).unionByName(f_.exceptAll(g_))
    bad = diff.groupBy("report_id", "metric").agg(F.count(F.lit(1)).alias("n_diff"))
    n = g_.groupBy("report_id", "metric").agg(F.count(F.lit(1)).alias("n_points"))
    return (pairs.select("report_id", "metric").join(n, ["report_id", "metric"], "left")
                 .join(bad, ["report_id", "metric"], "left")
                 .select("report_id", "metric", F.coalesce("n_points", F.lit(0)).cast("bigint").alias("n_points"),
                         (F.coalesce("n_diff", F.lit(0)) == 0).alias("equal")))


def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics whose result sets equal the gold ones at every snapshot of
    their table, of all evaluated."""
    e = _against_gold(spark, sf_dir, R.snapshot_cube(spark, sf_dir))
    return e.agg(F.count(F.lit(1)).cast("bigint").alias("n_metrics"), F.count_if("equal").cast("bigint").alias("n_equal")).select(
        "n_metrics", "n_equal", F.round(F.try_divide("n_equal", "n_metrics"), 6).alias("accuracy"))


def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that may be proposed: trust above the threshold,
    the most trusted first (``rank``; as many rows as the catalog has columns at most)."""
    from ..operators.trust import DROP
    from .log_queries import trust_score
    t = trust_score(spark, sf_dir).where(F.col("total") > DROP)
    w = Window.orderBy(F.col("total").desc(), "table", "column", "agg")
    return t.select("table", "column", "agg", "total", F.row_number().over(w).cast("bigint").alias("rank"))


def candidate_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate that a source writes down, with the reason why the grammar refuses it: keys of the search's
    survivors, keys of BI fields, and the aggregates of the statement log."""
    from .log_queries import log_aggregates
    from .workbook_queries import bi_formula
    res = _resolution(spark, sf_dir)
    tried = res.scored.select(F.lit("search").alias("source"), "key")
    bi = bi_formula(spark, sf_dir).where("key IS NOT NULL").select(F.lit("bi").alias("source"), "key")
    log = log_aggregates(spark, sf_dir).select(F.lit("log").alias("source"), F.upper(F.concat("agg", F.lit("("), "table", F.lit("."), "column", F.lit(")"))).alias("key"))
    keys = parse_keys(tried.unionByName(bi).unionByName(log).distinct(), "key")
    return keys.select("source", "key", S.grammar_fault().alias("fault"))


def guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column a proposal names (semantic-model measures, mined
    glossary lines, mined log aggregates) must exist in a physical table;
    offenders are dropped and their table is flagged for review."""
    from ..operators import profile as P
    from ..sources.tables import read_tables
    from .log_queries import log_aggregates
    from .text_queries import glossary_mining
    cat = P.column_catalog(spark, read_tables(spark, sf_dir)).select(
        F.lower("table").alias("table"), F.lower("column").alias("column"), F.lit(True).alias("known"))
    sm = semantic_model_rows(spark, sf_dir).where("kind = 'measure' AND expr <> '1'").select(
        F.lit("semantic_model").alias("source"), "table", F.col("expr").alias("column"))
    gl = glossary_mining(spark, sf_dir).select(F.lit("glossary").alias("source"), F.lower("table").alias("table"),
                                               F.lower("column").alias("column"))
    lg = log_aggregates(spark, sf_dir).where(F.col("column") != "*").select(
        F.lit("query_log").alias("source"), "table", "column")
    refs = sm.unionByName(gl).unionByName(lg).distinct()
    j = refs.join(cat, ["table", "column"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    flag = j.groupBy("table").agg((F.count_if(~F.col("known")) > 0).alias("review_required"))
    return j.join(flag, "table").select("source", "table", "column", "known", "review_required")


def _question() -> F.Column:
    return F.concat(F.lit("What was "), F.col("metric"),
                    F.when(F.col("label").isNotNull(), F.concat(F.lit(" for "), F.col("label"))).otherwise(F.lit("")),
                    F.lit(" as of "), F.date_format("as_of", "yyyy-MM-dd"), F.lit("?"))


def question_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure of the report asked as a question, matched to the
    published glossary metric with the best token Jaccard overlap (> 0).
    Pairs are joined on shared tokens, so only overlapping pairs are formed."""
    toks = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[a-zA-Z0-9]+"), 0),
                                                  lambda t: F.lower(t)))
    q = (R.report_figures(spark, sf_dir).select(_question().alias("question")).distinct()
          .withColumn("qt", toks(F.col("question"))))
    g = glossary_terms(spark, sf_dir).select(F.col("metric").alias("name"), "definition")
    g = g.withColumn("bag", F.array_union(toks(F.col("name")), toks(F.col("definition"))))
    qw = q.select("question", "qt", F.explode("qt").alias("tok"))
    gw = g.select("name", "bag", F.explode("bag").alias("tok"))
    pairs = qw.join(gw, "tok").select("question", "qt", "name", "bag").distinct()
    scored = pairs.withColumn("jaccard", F.size(F.array_intersect("qt", "bag")) / F.size(F.array_union("qt", "bag")))
    w = Window.partitionBy("question").orderBy(F.col("jaccard").desc(), "name")
    return (scored.withColumn("r", F.row_number().over(w)).where("r = 1")
                  .select("question", F.col("name").alias("metric"), F.round("jaccard", 6).alias("jaccard")))


# The published tables with the order of their files: terms by name, metrics by trust (W10), what nobody documented first.
SINKS = {"glossary": ("glossary_payloads", ["name"]), "tags": ("column_tags", ["table", "column"]),
         "lineage": ("lineage_edges", ["report_id", "metric", "table", "column"]),
         "semantic_model": ("semantic_model_rows", ["table", "kind", "trust desc", "name", "expr"]),
         "confirmed": ("conflict_tables", ["report_id", "metric"]), "scorecard": ("scorecard", ["check"]),
         "drift": ("drift_register", ["undocumented desc", "kind", "new_name", "old_name"]),
         "contradictions": ("contradictions", ["metric", "trust_rank", "source", "definition"])}


# Columns of the published tables, for the oracle (double or other).
SINK_COLUMNS = {n: {c: "double" if c in ("trust", "value") else "other" for c in cols.split()} for n, cols in {
    "glossary": "name display_name description synonyms band key report_id n_satisfied n_total source_locators",
    "tags": "table column tags", "lineage": "report_id metric table column n_satisfied kinds",
    "semantic_model": "table kind name agg expr trust",
    "confirmed": "report_id metric section key near_key breakdowns_ok breakdowns priors_ok constraints",
    "scorecard": "check value passed", "drift": "kind old_name new_name old_key new_key doc_hits undocumented",
    "contradictions": "metric structures n_sides trust_rank trust source_type source source_date metric_name definition structure"
                      " empirical_key empirical_band"}.items()}


def sink_table(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, list[str]]:
    from . import fingerprint_queries as FQ
    from . import text_queries as TQ
    query, order = SINKS[name]
    of = next(m for m in (globals(), vars(FQ), vars(TQ)) if query in m)
    return of[query](spark, sf_dir), order


def row_digest(df: DataFrame) -> F.Column:
    """A sum over the rows that any changed value changes: the first 60 bits of the md5 of each row's text, columns by name."""
    def text(c):
        t = df.schema[c].dataType.simpleString()
        v = F.col(c).cast("decimal(18,6)") if t == "double" else F.col(c)
        return F.coalesce(v.cast("string"), F.lit("-"))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *[text(c) for c in sorted(df.columns)])), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.coalesce(F.sum(bits), F.lit(0)).cast("string")


def _published(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """K1-K4: the tables published as JSON below the shared folder and read back through the pointer: ``sink, n_rows,
    digest`` of what the files hold."""
    import os
    import uuid
    from functools import reduce
    from ..session import checkpoint_dir
    from ..sinks import json_files as J
    root = os.path.join(checkpoint_dir(spark), "figureproof", "published-" + uuid.uuid4().hex)
    tables = {n: sink_table(spark, sf_dir, n) for n in names}
    J.publish(spark, root, tables)
    parts = []
    for name, (df, _) in tables.items():
        back = J.read(spark, root, name, df)
        parts.append(back.agg(F.count(F.lit(1)).alias("n_rows"), row_digest(back).alias("digest")).select(F.lit(name).alias("sink"), "n_rows", "digest"))
    return reduce(DataFrame.unionByName, parts)


def published_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, [n for n in SINKS if n not in ("drift", "contradictions")])


def published_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, ["drift"])


def published_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir, ["contradictions"])


def published_sql(sqls: dict, columns: dict, names: list[str]) -> str:
    """The same figures from the tables' own SQL; tables of one common beginning share it, so that it is computed once."""
    def digest(cols):
        cell = ", ".join("coalesce(" + (f'CAST(CAST("{c}" AS DECIMAL(18,6)) AS VARCHAR)' if t == "double" else f'CAST("{c}" AS VARCHAR)') + ", '-')"
                         for c, t in sorted(cols.items()))
        return f"CAST(coalesce(sum(CAST('0x' || substr(md5(concat_ws('|', {cell})), 1, 15) AS BIGINT)), 0) AS VARCHAR)"
    import os
    texts = {n: sqls[SINKS[n][0]] for n in names}
    head = os.path.commonprefix(list(texts.values())) if len(texts) > 1 else ""
    # cut behind the last whole expression that they share
    head = head[:head.rfind("),\n") + 1] if head else ""
    out = []
    for n, sql in texts.items():
        rest = sql[len(head):].lstrip(",").strip() if head else sql
        body = rest if not head or rest.upper().startswith("SELECT") else "WITH " + rest
        out.append(f"SELECT '{n}' AS sink, count(*) AS n_rows, {digest(columns[n])} AS digest FROM ({body})")
    return (head + "\n" if head else "") + " UNION ALL ".join(out)
