"""Text mining over whole documents: formulas, definition statements,
glossary lines, document dates, approval markers and cross-source
contradictions (S9, F14-F18, P10, P12, C8, A18, J18, F27).

The corpus is every row of ``documents`` (whole texts) plus the report
commentary that Spark renders from the published report (one commentary
text per report and metric, a glossary appendix per report).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prose as PR
from ..operators import contradictions as CO
from ..session import materialize
from ..sources.tables import read_table
from . import report as R

# The commentary printed next to each metric, per edition.
COMMENTARY = {
    ("rpt_q1", "Order Value"): "Order Value is the sum of total order price, measured at booking.",
    ("rpt_q2", "Booked Order Value"): "Booked Order Value represents the sum of total order price across priorities.",
    ("rpt_q1", "Shipped Quantity"): "Shipped Quantity aggregates line quantity across all shipments.",
    ("rpt_q2", "Shipped Quantity"): "Shipped Quantity is defined as shipped quantity less returned quantity.",
    ("rpt_q2", "Average Unit Price"): "Average Unit Price is calculated as extended price divided by quantity.",
    ("rpt_q1", "Line Count"): "Line Count represents shipped lines measured before returns.",
    ("rpt_q2", "Order Count"): "Order Count is defined as the number of o_orderkey values per quarter.",
}
# The glossary appendix of every edition.
GLOSSARY_LINES = [
    "ORDERS.O_TOTALPRICE: total order price including tax",
    "ORDERS.O_TOTALPRICE_V1: deprecated copy of the total order price",
    "LINEITEM.L_EXTENDEDPRICE: extended price of the line",
    "LINEITEM.L_QUANTITY: shipped quantity of the line",
]
APPROVED_EDITIONS = ["rpt_q2"]


def commentary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc, text, kind`` rendered from the published report."""
    figs = R.report_figures(spark, sf_dir)
    groups = figs.select("report_id", "edition_as_of", "metric").distinct()
    cm = F.create_map(*[x for (r, m), t in COMMENTARY.items()
                        for x in (F.lit(r + "|" + m), F.lit(t))])
    body = F.element_at(cm, F.concat_ws("|", "report_id", "metric"))
    per_metric = (groups.where(body.isNotNull())
                        .select(F.concat(F.lit("cmt-"), F.col("report_id"), F.lit("-"),
                                         F.regexp_replace(F.lower("metric"), "[^a-z0-9]+", "_")).alias("doc"),
                                F.concat(F.lit("Effective "), F.date_format("edition_as_of", "MMMM d, yyyy"),
                                         F.lit(".\n"), F.col("metric"), F.lit("\n"), body).alias("text")))
    eds = figs.select("report_id", "edition_as_of").distinct()
    appendix = eds.select(
        F.concat(F.lit("cmt-"), F.col("report_id"), F.lit("-glossary")).alias("doc"),
        F.concat(F.lit("Column glossary dated "), F.date_format("edition_as_of", "MMMM d, yyyy"), F.lit("\n"),
                 F.lit("\n".join(GLOSSARY_LINES)),
                 F.when(F.col("report_id").isin(*APPROVED_EDITIONS),
                        F.lit("\nApproved by the reporting committee.")).otherwise(F.lit(""))).alias("text"))
    return per_metric.unionByName(appendix).withColumn("kind", F.lit("report"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc"), "text",
        F.lit("document").alias("kind"))
    return docs.unionByName(commentary(spark, sf_dir))


def _match(pattern: int, structure: str, two: bool):
    return lambda z, k: F.struct(
        F.lit(pattern).alias("pattern"), k.alias("k"), F.lit(structure).alias("structure"), z["g1"].alias("name"),
        z["g2"].alias("a"), (z["g3"] if two else F.lit(None).cast("string")).alias("b"), F.trim(z["g0"]).alias("said"))


def formulas(c: DataFrame) -> DataFrame:
    """every formula sentence, deduplicated per (doc, name, structure)
    keeping the first (binary patterns before unary, then text order), with
    the words of the text that state it (``said``)."""
    # all patterns' matches of a text in one array: the corpus is read once, and the patterns only see the clauses that may match
    flat = (c.where(F.col("text").rlike(PR.STATING)).select("doc", PR.flatten("text").alias("whole"))
             .select("doc", PR.stating("whole", PR.FORMULA_END).alias("flat")).where("flat <> ''"))
    found = []
    for i, (pat, structure) in enumerate(PR.FORMULA_PATTERNS):
        two = " B" in structure
        groups = [F.regexp_extract_all("flat", F.lit(pat), g).alias(f"g{g}") for g in ((0, 1, 2, 3) if two else (0, 1, 2))]
        found.append(F.transform(F.arrays_zip(*groups), _match(i, structure, two)))
    z = flat.select("doc", F.explode(F.concat(*found)).alias("z")).select("doc", "z.*")
    allf = z.select("doc", "pattern", "k", PR.clean_name("name").alias("metric_name"), "structure", PR.clean_term("a").alias("term_a"),
                    F.when(F.col("b").isNotNull(), PR.clean_term("b")).alias("term_b"), "said")
    w = Window.partitionBy("doc", "metric_name", "structure").orderBy("pattern", "k")
    return (allf.withColumn("r", F.row_number().over(w)).where("r = 1")
                .select("doc", "metric_name", "structure", "term_a", "term_b", "said"))


def statements(c: DataFrame) -> DataFrame:
    """F15 + the structure of each statement (first formula that matches)."""
    flat = (c.where(F.col("text").rlike(PR.STATING)).select("doc", "kind", PR.flatten("text").alias("whole"))
             .select("doc", "kind", PR.stating("whole", PR.STATEMENT_END).alias("flat")).where("flat <> ''"))
    z = flat.select("doc", "kind", F.posexplode(F.arrays_zip(
        F.regexp_extract_all("flat", F.lit(PR.STATEMENT), 1).alias("name"),
        F.regexp_extract_all("flat", F.lit(PR.STATEMENT), 0).alias("sentence"))).alias("k", "z"))
    return z.select("doc", "kind", "k", PR.clean_name("z.name").alias("metric_name"),
                    F.trim("z.sentence").alias("sentence"),
                    PR.sentence_structure(F.trim("z.sentence")).alias("structure"))


def formula_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas(corpus(spark, sf_dir))


def statement_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(corpus(spark, sf_dir)).select("doc", "metric_name", "sentence", "structure")


def glossary_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``TABLE.COLUMN: description`` lines; the last occurrence in a
    document wins."""
    c = corpus(spark, sf_dir).where(F.col("text").rlike(PR.GLOSSARY_MARK))
    z = c.select("doc", F.posexplode(F.arrays_zip(
        F.regexp_extract_all("text", F.lit(PR.GLOSSARY), 1).alias("t"),
        F.regexp_extract_all("text", F.lit(PR.GLOSSARY), 2).alias("c"),
        F.regexp_extract_all("text", F.lit(PR.GLOSSARY), 3).alias("d"))).alias("k", "z"))
    w = Window.partitionBy("doc", "z.t", "z.c").orderBy(F.col("k").desc())
    return (z.withColumn("r", F.row_number().over(w)).where("r = 1")
             .select("doc", F.col("z.t").alias("table"), F.col("z.c").alias("column"),
                     F.trim("z.d").alias("description")))


def approval_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10/P12/F16 over every text of the corpus."""
    return corpus(spark, sf_dir).select("doc", PR.approval("text").alias("approved"), _source_type().alias("source_type"),
                                        PR.doc_date("text").alias("doc_date"))


def _source_type() -> F.Column:
    return (F.when(F.col("kind") == "report", F.lit("pdf_report"))
             .when(PR.approval("text"), F.lit("brd_approved")).otherwise(F.lit("brd_draft")))


def evidence_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every source says about a metric: sentences of the corpus and the
    fields of the BI workbooks, as ``contradictions.STATEMENT``."""
    from .workbook_queries import bi_formula
    c = corpus(spark, sf_dir)
    # only texts that state something are classed and dated
    # written once: the texts are not mined again for every reference
    said = materialize(statements(c).select("doc", "metric_name", F.col("sentence").alias("definition"), "structure"), "said")
    told = c.join(said.select("doc").distinct(), "doc", "left_semi").select(
        "doc", _source_type().alias("source_type"), PR.doc_date("text").alias("source_date"))
    prose = said.join(told, "doc").withColumnRenamed("doc", "source")
    bi = bi_formula(spark, sf_dir).where("sql IS NOT NULL").select(
        F.col("caption").alias("metric_name"), F.col("sql").alias("definition"), F.col("file").alias("source"),
        F.lit(None).cast("string").alias("source_date"), F.lit("tableau_calc").alias("source_type"),
        CO.expression_structure(F.col("sql")).alias("structure"))
    return prose.select(*CO.STATEMENT).unionByName(bi.select(*CO.STATEMENT))


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sides of every metric that sources define differently."""
    from .publish_queries import glossary_terms
    said = materialize(evidence_statements(spark, sf_dir), "statements-of-sources")
    accepted = glossary_terms(spark, sf_dir).select("metric", F.col("definition").alias("key"), "band")
    found = CO.find(said, accepted)
    return found.select("metric", "structures", F.col("n_sides").cast("bigint").alias("n_sides"), "trust_rank", "trust", "source_type",
                        "source", "source_date", "metric_name", "definition", "structure", "empirical_key", "empirical_band")


# ----------------------------------------------------------------------- oracle

def _sq(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def oracle(figures_ctes: str) -> dict[str, str]:
    cm = " ".join(f"WHEN {_sq(r + '|' + m)} THEN {_sq(t)}" for (r, m), t in COMMENTARY.items())
    appr = ", ".join(_sq(r) for r in APPROVED_EDITIONS)
    gl = _sq("\n".join(GLOSSARY_LINES))
    base = figures_ctes + f""",
grp AS (SELECT DISTINCT report_id, edition_as_of, metric FROM figs),
cmt AS (SELECT 'cmt-' || report_id || '-' || regexp_replace(lower(metric), '[^a-z0-9]+', '_', 'g') AS doc,
               'Effective ' || strftime(edition_as_of, '%B %-d, %Y') || '.' || chr(10) || metric || chr(10) ||
               (CASE report_id || '|' || metric {cm} END) AS text, 'report' AS kind
        FROM grp WHERE (CASE report_id || '|' || metric {cm} END) IS NOT NULL
        UNION ALL
        SELECT 'cmt-' || report_id || '-glossary',
               'Column glossary dated ' || strftime(edition_as_of, '%B %-d, %Y') || chr(10) || {gl} ||
               CASE WHEN report_id IN ({appr}) THEN chr(10) || 'Approved by the reporting committee.' ELSE '' END,
               'report'
        FROM (SELECT DISTINCT report_id, edition_as_of FROM figs)),
corpus AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS doc, text, 'document' AS kind FROM documents
           UNION ALL SELECT * FROM cmt),
flat AS (SELECT doc, kind, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM corpus)"""

    def clean_name(x):
        n = f"trim(regexp_replace({x}, '^The ', ''))"
        t = f"string_split({n}, ' ')"
        h = f"(len({t}) // 2)"
        return (f"CASE WHEN len({t}) % 2 = 0 AND {h} > 0 AND {t}[1:{h}] = {t}[{h}+1:len({t})] "
                f"THEN array_to_string({t}[1:{h}], ' ') ELSE {n} END")

    def clean_term(x):
        return f"regexp_replace(trim({x}), '[,.;]+$', '')"

    parts = []
    for i, (pat, structure) in enumerate(PR.FORMULA_PATTERNS):
        binary = " B" in structure
        gs = [f"regexp_extract_all(flat, {_sq(pat)}, {g})" for g in ((1, 2, 3, 0) if binary else (1, 2, 2, 0))]
        parts.append(f"""SELECT doc, {i} AS pattern, generate_subscripts(z, 1) AS k, unnest(z) AS p, '{structure}' AS structure,
                        {'TRUE' if binary else 'FALSE'} AS is_binary FROM (SELECT doc, list_zip({', '.join(gs)}) AS z FROM flat)""")
    struct_case = "CASE " + " ".join(
        f"WHEN regexp_matches(s, {_sq(pat)}) THEN '{st}'" for pat, st in PR.FORMULA_PATTERNS) + " END"
    out = {}
    fm = base + f""",
raw AS ({' UNION ALL '.join(parts)}),
fm AS (SELECT doc, pattern, k, {clean_name('p[1]')} AS metric_name, structure, {clean_term('p[2]')} AS term_a,
              CASE WHEN is_binary THEN {clean_term('p[3]')} END AS term_b, trim(p[4]) AS said FROM raw)
SELECT doc, metric_name, structure, term_a, term_b, said FROM fm
QUALIFY row_number() OVER (PARTITION BY doc, metric_name, structure ORDER BY pattern, k) = 1"""
    out["formula_mining"] = fm
    st = base + f""",
s0 AS (SELECT doc, kind, list_zip(regexp_extract_all(flat, {_sq(PR.STATEMENT)}, 1),
                                  regexp_extract_all(flat, {_sq(PR.STATEMENT)}, 0)) AS z FROM flat),
s1 AS (SELECT doc, kind, unnest(z) AS p FROM s0),
stm AS (SELECT doc, kind, {clean_name('p[1]')} AS metric_name, trim(p[2]) AS sentence FROM s1),
stx AS (SELECT *, (SELECT {struct_case} FROM (SELECT sentence AS s)) AS structure FROM stm)"""
    out["statement_mining"] = st + "\nSELECT doc, metric_name, sentence, structure FROM stx"
    out["glossary_mining"] = base + f""",
g0 AS (SELECT doc, list_zip(regexp_extract_all(text, {_sq(PR.GLOSSARY)}, 1), regexp_extract_all(text, {_sq(PR.GLOSSARY)}, 2),
                            regexp_extract_all(text, {_sq(PR.GLOSSARY)}, 3)) AS z FROM corpus),
g1 AS (SELECT doc, generate_subscripts(z, 1) AS k, unnest(z) AS p FROM g0)
SELECT doc, p[1] AS "table", p[2] AS "column", trim(p[3]) AS description FROM g1
QUALIFY row_number() OVER (PARTITION BY doc, p[1], p[2] ORDER BY k DESC) = 1"""
    dates = ", ".join(f"nullif(regexp_extract(text, {_sq(p)}, 1), '')" for p in PR.DOC_DATES)
    out["approval_flags"] = base + f"""
SELECT doc, regexp_matches(text, {_sq(PR.APPROVAL)}) AS approved,
       CASE WHEN kind = 'report' THEN 'pdf_report' WHEN regexp_matches(text, {_sq(PR.APPROVAL)}) THEN 'brd_approved'
            ELSE 'brd_draft' END AS source_type,
       coalesce({dates}) AS doc_date
FROM corpus"""
    return out


# ----------------------------------------------------------------------- grounding

# Aggregation keywords and the confidence floor.
COUNT_WORDS = ["count", "number of", "how many"]
AVG_WORDS = ["average", "avg", "mean"]
GROUNDING_FLOOR = 0.6


def ground_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each mined definition that name a physical
    column (equi-join on the word), the confidence (matched / words), the
    most frequent table (first match on ties), the inferred aggregation."""
    from ..operators import profile as P
    from ..sources.tables import read_tables
    st = statements(corpus(spark, sf_dir))
    cat = P.column_catalog(spark, read_tables(spark, sf_dir))
    # a column name in several tables maps to the last table in name order
    colmap = (cat.select(F.lower("column").alias("word"), "table")
                 .groupBy("word").agg(F.max("table").alias("table")))
    words = st.select("doc", "k", "metric_name", "sentence",
                      F.posexplode(F.regexp_extract_all(F.lower("sentence"), F.lit(r"\b[a-z_]+\b"), 0))
                       .alias("wpos", "word"))
    nw = words.groupBy("doc", "k").agg(F.count(F.lit(1)).alias("n_words"))
    m = words.join(colmap, "word")
    per_table = (m.groupBy("doc", "k", "table").agg(F.count(F.lit(1)).alias("c"), F.min("wpos").alias("first")))
    wt = Window.partitionBy("doc", "k").orderBy(F.col("c").desc(), "first")
    top = per_table.withColumn("r", F.row_number().over(wt)).where("r = 1").select("doc", "k", "table")
    agg = m.groupBy("doc", "k", "metric_name", "sentence").agg(
        F.count(F.lit(1)).alias("n_matched"), F.min_by("word", "wpos").alias("best_col"))
    low = F.lower("sentence")
    kind = (F.when(F.exists(F.array(*[F.lit(w) for w in COUNT_WORDS]), lambda w: F.instr(low, w) > 0), "COUNT")
             .when(F.exists(F.array(*[F.lit(w) for w in AVG_WORDS]), lambda w: F.instr(low, w) > 0), "AVG")
             .otherwise("SUM"))
    out = agg.join(nw, ["doc", "k"]).join(top, ["doc", "k"])
    conf = F.least(F.col("n_matched") / F.col("n_words"), F.lit(1.0))
    expr = F.when(kind == "COUNT", F.concat(F.lit("COUNT(DISTINCT "), F.col("best_col"), F.lit(")"))) \
            .otherwise(F.concat(kind, F.lit("("), F.col("best_col"), F.lit(")")))
    return out.select("doc", "metric_name", F.col("n_words").cast("bigint").alias("n_words"),
                      F.col("n_matched").cast("bigint").alias("n_matched"), F.round(conf, 6).alias("confidence"),
                      expr.alias("expression"), "table", (conf < GROUNDING_FLOOR).alias("ambiguous"))


def oracle_grounding(figures_ctes: str, schema: dict) -> dict[str, str]:
    base = oracle(figures_ctes)["statement_mining"]
    head = base[:base.rindex("SELECT doc, metric_name, sentence, structure FROM stx")]
    cols = ", ".join(f"('{t}', '{c}')" for t, cs in schema.items() for c, _ in cs)
    cw = " OR ".join(f"strpos(lower(sentence), '{w}') > 0" for w in COUNT_WORDS)
    aw = " OR ".join(f"strpos(lower(sentence), '{w}') > 0" for w in AVG_WORDS)
    return {"ground_definitions": head.replace("stm AS (SELECT doc, kind,", "stm AS (SELECT doc, kind, k,")
            .replace("s1 AS (SELECT doc, kind, unnest(z) AS p FROM s0)",
                     "s1 AS (SELECT doc, kind, generate_subscripts(z, 1) AS k, unnest(z) AS p FROM s0)") + f""",
colmap AS (SELECT lower(c) AS word, max(t) AS "table" FROM (VALUES {cols}) v(t, c) GROUP BY lower(c)),
w0 AS (SELECT doc, k, metric_name, sentence, regexp_extract_all(lower(sentence), '\\b[a-z_]+\\b', 0) AS ws FROM stx),
w1 AS (SELECT doc, k, metric_name, sentence, generate_subscripts(ws, 1) AS wpos, unnest(ws) AS word FROM w0),
nw AS (SELECT doc, k, count(*) AS n_words FROM w1 GROUP BY ALL),
m AS (SELECT w1.*, colmap."table" FROM w1 JOIN colmap USING (word)),
top AS (SELECT doc, k, "table" FROM (SELECT doc, k, "table", count(*) AS c, min(wpos) AS f FROM m GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY doc, k ORDER BY c DESC, f) = 1),
ag AS (SELECT doc, k, metric_name, sentence, count(*) AS n_matched, arg_min(word, wpos) AS best_col FROM m GROUP BY ALL),
r AS (SELECT ag.*, nw.n_words, top."table", least(n_matched / n_words, 1.0) AS conf,
             CASE WHEN {cw} THEN 'COUNT' WHEN {aw} THEN 'AVG' ELSE 'SUM' END AS kind
      FROM ag JOIN nw USING (doc, k) JOIN top USING (doc, k))
SELECT doc, metric_name, CAST(n_words AS BIGINT) AS n_words, CAST(n_matched AS BIGINT) AS n_matched,
       round(CAST(conf AS DOUBLE), 6) AS confidence,
       CASE WHEN kind = 'COUNT' THEN 'COUNT(DISTINCT ' || best_col || ')' ELSE kind || '(' || best_col || ')' END AS expression,
       "table", conf < {GROUNDING_FLOOR} AS ambiguous
FROM r"""}


# ----------------------------------------------------------------------- contradictions

def oracle_contradictions(statement_sql: str, approval_sql: str, bi_sql: str, glossary_sql: str) -> str:
    """All pairs of names; groups by walking the links from every name."""
    from ..operators.trust import SOURCE_AUTHORITY
    from .naming_sql import similarity_ctes
    trust = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SOURCE_AUTHORITY.items())
    names = "SELECT lname AS name FROM alln"
    return f"""WITH RECURSIVE smt AS ({statement_sql}), apr AS ({approval_sql}), bif AS ({bi_sql}), gls AS ({glossary_sql}),
said AS (
  SELECT DISTINCT s.metric_name, s.sentence AS definition, s.doc AS source, a.doc_date AS source_date, a.source_type, s.structure
  FROM smt s JOIN apr a USING (doc)
  UNION
  SELECT caption, sql, file, CAST(NULL AS VARCHAR), 'tableau_calc',
         CASE WHEN sql LIKE '% - %' THEN 'A - B' WHEN sql LIKE '% + %' THEN 'A + B' WHEN sql LIKE '% / %' THEN 'A / B' ELSE 'SUM(A)' END
  FROM bif WHERE sql IS NOT NULL),
nms AS (SELECT DISTINCT lower(metric_name) AS lname FROM said),
alln AS (SELECT lname FROM nms UNION SELECT lower(metric) FROM gls)""" + similarity_ctes(
        "c", names, "SELECT lname AS ident, CAST(NULL AS VARCHAR) AS description FROM alln") + f""",
lnk AS (SELECT a.lname AS a, b.lname AS b FROM nms a, nms b WHERE ends_with(a.lname, b.lname)
        UNION SELECT name, ident FROM c_f1 WHERE f1 >= 0.85 AND name IN (FROM nms) AND ident IN (FROM nms)),
two AS (SELECT a, b FROM lnk UNION SELECT b, a FROM lnk),
walk AS (SELECT lname AS a, lname AS b FROM nms UNION SELECT w.a, t.b FROM walk w JOIN two t ON w.b = t.a),
grp AS (SELECT a AS lname, arg_min(b, (length(b), b)) AS metric FROM walk GROUP BY a),
sid AS (SELECT s.*, g.metric, CAST(CASE s.source_type {trust} ELSE 0.0 END AS DOUBLE) AS trust FROM said s JOIN grp g ON g.lname = lower(s.metric_name)),
spl AS (SELECT metric, array_to_string(list_sort(list_distinct(list(structure) FILTER (WHERE structure IS NOT NULL))), ', ') AS structures,
               CAST(count(*) AS BIGINT) AS n_sides FROM sid GROUP BY metric HAVING count(DISTINCT structure) > 1),
emp AS (SELECT m.metric, arg_min(g.definition, (lower(g.metric), g.definition)) AS empirical_key,
               arg_min(g.band, (lower(g.metric), g.definition)) AS empirical_band
        FROM spl m JOIN gls g ON lower(g.metric) = m.metric OR EXISTS (SELECT 1 FROM c_f1 f WHERE f.name = lower(g.metric) AND f.ident = m.metric AND f.f1 >= 0.85)
        GROUP BY m.metric)
SELECT metric, structures, n_sides, CAST(dense_rank() OVER (PARTITION BY metric ORDER BY trust DESC) AS INT) AS trust_rank, trust, source_type,
       source, source_date, metric_name, definition, structure, empirical_key, empirical_band
FROM sid JOIN spl USING (metric) LEFT JOIN emp USING (metric)"""
