"""Name-based shortlist (C1, J8, J9, W7, F3-F5) and prose-seeded
candidates (C3, J5, U3, W2).

Metric names come from the published report, columns from the catalog of
the driver tables, descriptions from the mined glossary. Names and columns
meet by similarity joins on words, description words and characters that lose
no pair above the floor. No list is cut; ranks are part of the result and the
constraint tally decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import naming as NM
from ..operators import profile as P
from ..operators import simjoin as SJ
from ..session import materialize, shared
from ..sources.tables import read_tables
from . import report as R
from .naming_sql import similarity_ctes
from .text_queries import corpus, formulas

# Fixed values of the search.
TIER1_MIN_COLUMN_SIMILARITY = 0.5
TERM_FLOOR = 0.15
HYPOTHESIS_NAME_FLOOR = 0.8


def numeric_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns of the driver tables and marts."""
    tabs = read_tables(spark, sf_dir)
    tabs.update(R.marts(spark, sf_dir))
    return P.column_catalog(spark, tabs).where(F.col("kind") == "number")


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined once per session and state of the data: the texts are read whole for it."""
    from .text_queries import glossary_mining
    g = shared(spark, ("glossary", sf_dir), lambda: materialize(glossary_mining(spark, sf_dir), "glossary"))
    w = Window.partitionBy("table", "column").orderBy(F.col("doc").desc())
    return (g.withColumn("r", F.row_number().over(w)).where("r = 1")
             .select(F.lower("table").alias("table"), F.lower("column").alias("column"), "description"))


def similar(names: DataFrame, idents: DataFrame, floor: float) -> DataFrame:
    """All pairs of names(name) and idents(ident, description) whose similarity
    (F4) is at least ``floor``, with it as ``sim``.

    The similarity is the greatest of three measures. Words and description
    words that reach the floor are found by their own join; the ratio counts
    ``RATIO_WEIGHT`` and is at most the Dice measure of the characters, so that one
    joined at ``floor / RATIO_WEIGHT`` meets all pairs it could lift to the floor."""
    # tokens are sorted: one order for both sides
    n = names.select("name").distinct().withColumn("bw", F.array_sort(NM.business_words("name"))).where(F.size("bw") > 0)
    i = (idents.select("ident", "description").distinct().withColumn("iw", F.array_sort(NM.identifier_words("ident")))
         .withColumn("dw", F.array_sort(NM.description_words("description"))).where(F.size("iw") > 0))
    met = [SJ.dice_pairs(n.select("name", F.col("bw").alias("toks")), i.select("ident", F.col(w).alias("toks")).distinct(), "name", "ident", floor)
           for w in ("iw", "dw")]
    if floor <= NM.RATIO_WEIGHT:
        met.append(SJ.dice_pairs(n.select("name", NM.letters(NM.joined_sorted(F.col("bw"))).alias("toks")),
                                 i.select("ident", NM.letters(NM.joined_sorted(F.col("iw"))).alias("toks")).distinct(),
                                 "name", "ident", floor / NM.RATIO_WEIGHT))
    pairs = reduce(DataFrame.unionByName, met).distinct().join(i.select("ident", "description"), "ident")
    # an array of one, or none: the ratio is not taken again for the filter
    sim = F.filter(F.array(NM.similarity(F.col("name"), F.col("ident"), F.col("description"))), lambda x: x >= floor)
    return pairs.select("name", "ident", "description", F.explode(sim).alias("sim"))


def column_similarity(spark: SparkSession, sf_dir: str, names: DataFrame) -> DataFrame:
    """``name, table, column, sim`` of every name with the numeric columns that are at least ``TERM_FLOOR`` similar."""
    cols = (numeric_catalog(spark, sf_dir).join(glossary(spark, sf_dir), ["table", "column"], "left")
            .select("table", "column", F.concat_ws(".", "table", "column").alias("ident"), "description"))
    return similar(names, cols, TERM_FLOOR).join(cols.select("ident", "table", "column"), "ident").select("name", "table", "column", "sim")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report_figures(spark, sf_dir).select(F.col("metric").alias("name")).distinct()


def metric_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, ("sims", sf_dir), lambda: materialize(
        column_similarity(spark, sf_dir, _metrics(spark, sf_dir)), "sims"))


def name_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per metric the columns with similarity >= 0.5 (SUM), ranked."""
    s = metric_similarity(spark, sf_dir).where(F.col("sim") >= TIER1_MIN_COLUMN_SIMILARITY)
    w = Window.partitionBy("name").orderBy(F.round("sim", 6).desc(), "table", "column")
    return s.select(F.col("name").alias("metric"), "table", "column", F.round("sim", 6).alias("sim"),
                    F.row_number().over(w).cast("bigint").alias("rank"))


def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token F1 of every metric name with every numeric column that
    shares an expanded word (equi-join on the word)."""
    metrics = R.report_figures(spark, sf_dir).select(F.col("metric").alias("name")).distinct()
    m = metrics.withColumn("bw", NM.business_words("name"))
    c = (numeric_catalog(spark, sf_dir).withColumn("ident", F.concat_ws(".", "table", "column"))
         .withColumn("iw", NM.identifier_words(F.col("ident"))))
    mw = m.select("name", "bw", F.explode("bw").alias("word"))
    cw = c.select("table", "column", "iw", F.explode("iw").alias("word"))
    pairs = mw.join(cw, "word").select("name", "bw", "table", "column", "iw").distinct()
    return pairs.select(F.col("name").alias("metric"), "table", "column",
                        F.size(F.array_intersect("bw", "iw")).cast("bigint").alias("shared"),
                        F.round(NM.token_f1(F.col("bw"), F.col("iw")), 6).alias("f1"))


def prose_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, ("hypotheses", sf_dir), lambda: materialize(_hypotheses(spark, sf_dir), "hypotheses"))


def _hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, doc, structure, term_a, term_b``: mined formulas whose name is a
    report metric's (ignoring case) or at least 0.8 similar to it."""
    # written once: the texts are not mined again for every reference
    hyp = materialize(formulas(corpus(spark, sf_dir)).select("doc", F.col("metric_name").alias("hname"), "structure", "term_a", "term_b"), "formulas")
    metrics = _metrics(spark, sf_dir)
    close = similar(hyp.select(F.col("hname").alias("name")), metrics.select(F.col("name").alias("ident"), F.lit(None).cast("string").alias("description")),
                    HYPOTHESIS_NAME_FLOOR).select(F.col("ident").alias("name"), F.col("name").alias("hname"))
    same = metrics.join(hyp.select("hname").distinct(), F.lower("name") == F.lower("hname")).select("name", "hname")
    return close.unionByName(same).distinct().join(hyp, "hname")


def prose_terms(spark: SparkSession, sf_dir: str, hyp: DataFrame) -> DataFrame:
    """The candidates of each hypothesis: every column of each term with
    similarity > 0.15, for two-term structures all pairs of the two terms'
    columns but equal ones. ``name, hname, t1, c1, op, t2, c2, sim, rank``
    (rank: the lower of the terms' ranks among their columns). A formula that
    many texts state is one hypothesis, spread over the columns once."""
    hyp = hyp.select("name", "hname", "structure", "term_a", "term_b").distinct()
    key = ["name", "hname", "structure", "term_a", "term_b"]
    side = lambda x: hyp.select(*key, F.lit(x).alias("side"), F.col(f"term_{x}").alias("term"))
    terms = side("a").unionByName(side("b").where("term IS NOT NULL"))
    # written once: the ratio is not taken again for every later reference
    sims = materialize(column_similarity(spark, sf_dir, terms.select(F.col("term").alias("name"))), "term-sims").where(F.col("sim") > TERM_FLOOR)
    w = Window.partitionBy("name").orderBy(F.round("sim", 6).desc(), "table", "column")
    t = terms.join(sims.withColumn("r", F.row_number().over(w)).withColumnRenamed("name", "term"), "term")
    a = t.where("side = 'a'").select(*key, F.col("table").alias("t1"), F.col("column").alias("c1"), F.col("sim").alias("s1"), F.col("r").alias("r1"))
    b = t.where("side = 'b'").select(*key, F.col("table").alias("t2"), F.col("column").alias("c2"), F.col("sim").alias("s2"), F.col("r").alias("r2"))
    op = F.element_at(F.create_map(*[F.lit(x) for x in ("A - B", "-", "A + B", "+", "A / B", "/")]), F.col("structure"))
    none = F.lit(None).cast("string")
    unary = a.where("structure = 'SUM(A)'").select("name", "hname", "t1", "c1", none.alias("op"), none.alias("t2"), none.alias("c2"),
                                                   F.col("s1").alias("sim"), F.col("r1").alias("rank"))
    binary = (a.where("structure <> 'SUM(A)'").join(b, key).where("NOT (t1 = t2 AND c1 = c2)")
               .select("name", "hname", "t1", "c1", op.alias("op"), "t2", "c2", ((F.col("s1") + F.col("s2")) / 2).alias("sim"),
                       F.greatest("r1", "r2").alias("rank")))
    return unary.unionByName(binary)


def prose_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (metric, candidate key) with the highest name similarity and the lowest rank."""
    c = prose_terms(spark, sf_dir, prose_hypotheses(spark, sf_dir))
    term = lambda t, x: F.concat(F.lit("SUM("), F.col(t), F.lit("."), F.col(x), F.lit(")"))
    key = F.upper(F.concat(term("t1", "c1"), F.coalesce(F.concat(F.lit(" "), F.col("op"), F.lit(" "), term("t2", "c2")), F.lit(""))))
    return (c.groupBy(F.col("name").alias("metric"), key.alias("key"))
             .agg(F.round(F.max("sim"), 6).alias("sim"), F.min("rank").cast("bigint").alias("rank")))


# ----------------------------------------------------------------------- oracle

def catalog_cte(schema: dict, mart_columns: dict) -> str:
    """The numeric columns by name: ``cat``."""
    cols = [(t, c) for t, cs in schema.items() if t not in mart_columns for c, k in cs if k == "number"]
    cols += [(t, c) for t, cs in mart_columns.items() for c in cs]
    return "cat AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in cols) + ') v("table", "column"))'


def columns_sql(glossary_sql: str) -> str:
    """CTEs ``gls`` (last description of a column) and ``idn`` (ident, description, table, column)."""
    return f"""gls AS (SELECT lower("table") AS "table", lower("column") AS "column", description FROM ({glossary_sql})
        QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY doc DESC) = 1),
idn AS (SELECT "table" || '.' || "column" AS ident, g.description, "table", "column" FROM cat LEFT JOIN gls g USING ("table", "column"))"""


def oracle(figures_ctes: str, schema: dict, mart_columns: dict, glossary_sql: str, formula_sql: str) -> dict[str, str]:
    head = figures_ctes.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + catalog_cte(schema, mart_columns) + ",\n" + columns_sql(glossary_sql)
    metrics = "SELECT DISTINCT metric AS name FROM figs"
    short = head + similarity_ctes("m", metrics, "SELECT ident, description FROM idn")
    return {
        "token_similarity": short + """
SELECT name AS metric, "table", "column", CAST(shared AS BIGINT) AS shared, round(f1, 6) AS f1
FROM m_f1 JOIN idn USING (ident) WHERE shared > 0""",
        "name_shortlist": short + """
SELECT name AS metric, "table", "column", round(sim, 6) AS sim,
       row_number() OVER (PARTITION BY name ORDER BY round(sim, 6) DESC, "table", "column") AS rank
FROM m_sim JOIN idn USING (ident) WHERE sim >= 0.5""",
        "prose_candidates": head + f""",
hyp AS ({formula_sql})""" + similarity_ctes("h", "SELECT DISTINCT metric_name AS name FROM hyp",
                                            "SELECT DISTINCT metric AS ident, CAST(NULL AS VARCHAR) AS description FROM figs") + """,
hm AS (SELECT DISTINCT s.ident AS name, h.doc, h.structure, h.term_a, h.term_b FROM h_sim s JOIN hyp h ON h.metric_name = s.name WHERE sim >= 0.8
       UNION SELECT DISTINCT f.metric, h.doc, h.structure, h.term_a, h.term_b FROM hyp h JOIN figs f ON lower(f.metric) = lower(h.metric_name))
""" + similarity_ctes("t", "SELECT term_a AS name FROM hm UNION SELECT term_b FROM hm WHERE term_b IS NOT NULL",
                      "SELECT ident, description FROM idn") + """,
top AS (SELECT name AS term, "table", "column", sim,
               row_number() OVER (PARTITION BY name ORDER BY round(sim, 6) DESC, "table", "column") AS r
        FROM t_sim JOIN idn USING (ident) WHERE sim > 0.15),
allc AS (
  SELECT h.name, upper('SUM(' || a."table" || '.' || a."column" || ')') AS key, a.sim, a.r AS rank
  FROM hm h JOIN top a ON a.term = h.term_a WHERE h.structure = 'SUM(A)'
  UNION ALL
  SELECT h.name, upper('SUM(' || a."table" || '.' || a."column" || ') ' || CASE h.structure WHEN 'A - B' THEN '-' WHEN 'A + B' THEN '+' ELSE '/' END
         || ' SUM(' || b."table" || '.' || b."column" || ')'), (a.sim + b.sim) / 2, greatest(a.r, b.r)
  FROM hm h JOIN top a ON a.term = h.term_a JOIN top b ON b.term = h.term_b
  WHERE h.structure <> 'SUM(A)' AND NOT (a."table" = b."table" AND a."column" = b."column"))
SELECT name AS metric, key, round(max(sim), 6) AS sim, CAST(min(rank) AS BIGINT) AS rank FROM allc GROUP BY name, key"""}
