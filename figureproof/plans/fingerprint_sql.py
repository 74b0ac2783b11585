"""Independent DuckDB formulations of the fingerprint queries (the oracle).

These are plain SQL over the driver tables: the same report is printed,
every candidate is evaluated by brute force (all pairs, all filters, one
GROUP BY per reading) and the verdict rules are applied with CASE/ROW_NUMBER.
"""

from __future__ import annotations

ORDERS_DIMS = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]
ORDERS_MEASURES = ["o_orderkey", "o_custkey", "o_totalprice", "o_totalprice_v1"]
LINE_DIMS = ["l_returnflag", "l_linestatus"]
LINE_MEASURES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax"]

MARTS_SQL = """
qs AS (SELECT CAST(date_trunc('quarter', max(o_orderdate)) AS DATE) AS qs FROM orders),
eds AS (SELECT CAST(qs - INTERVAL 6 MONTH AS DATE) - 1 AS q0,
               CAST(qs - INTERVAL 3 MONTH AS DATE) - 1 AS q1,
               qs - 1 AS q2 FROM qs),
om AS (
  SELECT CAST(last_day(date_trunc('quarter', o.o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS as_of,
         o.o_orderkey, o.o_custkey, o.o_totalprice,
         o.o_totalprice * CAST(CASE o.o_orderpriority WHEN '1-URGENT' THEN 1.01 WHEN '2-HIGH' THEN 0.99
                                    WHEN '3-MEDIUM' THEN 1.01 WHEN '4-NOT SPECIFIED' THEN 0.99
                                    ELSE 1.00 END AS DOUBLE) AS o_totalprice_v1,
         o.o_orderstatus, o.o_orderpriority, c.c_mktsegment
  FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey),
lm AS (
  SELECT CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS as_of,
         l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus
  FROM lineitem)"""


def _grouped(src, dims, aggs):
    parts = [f"SELECT as_of, CAST(NULL AS VARCHAR) AS gcol, CAST(NULL AS VARCHAR) AS gval, {aggs} "
             f"FROM {src} GROUP BY as_of"]
    for d in dims:
        parts.append(f"SELECT as_of, '{d}', CAST({d} AS VARCHAR), {aggs} FROM {src} GROUP BY as_of, {d}")
    return "\nUNION ALL ".join(parts)


_FIG_SPEC = [
    # report, edition, metric, unit, source, value expr, figure date, group col, dim, label expr, pos
    ("rpt_q1", "q1", "Order Value", "mm", "og", "MM", "q1", None, None, None, 100),
    ("rpt_q1", "q1", "Order Value", "mm", "og", "MM", "q1", "o_orderpriority", "priority", "gval", 110),
    ("rpt_q1", "q1", "Order Value", "mm", "og", "MM", "q1", "c_mktsegment", "segment",
     "upper(substr(gval, 1, 1)) || lower(substr(gval, 2))", 120),
    ("rpt_q1", "q1", "Order Count", "count", "og", "n", "q1", None, None, None, 200),
    ("rpt_q1", "q1", "Order Count", "count", "og", "n", "q1", "o_orderstatus", "status", "gval", 210),
    ("rpt_q1", "q1", "Shipped Quantity", "count", "lg", "qty", "q1", None, None, None, 300),
    ("rpt_q1", "q1", "Shipped Quantity", "count", "lg", "qty", "q1", "l_linestatus", "line_status", "gval", 310),
    ("rpt_q1", "q1", "Line Count", "count", "lg", "n", "q1", None, None, None, 400),
    ("rpt_q2", "q2", "Booked Order Value", "mm", "og", "MM", "q2", None, None, None, 100),
    ("rpt_q2", "q2", "Booked Order Value", "mm", "og", "MM", "q1", None, None, None, 101),
    ("rpt_q2", "q2", "Booked Order Value", "mm", "og", "MM", "q2", "o_orderpriority", "priority", "gval", 110),
    ("rpt_q2", "q2", "Order Count", "count", "og", "n", "q2", None, None, None, 200),
    ("rpt_q2", "q2", "Order Count", "count", "og", "n", "q1", None, None, None, 201),
    ("rpt_q2", "q2", "Order Count", "count", "og", "n", "q2", "o_orderstatus", "status", "gval", 210),
    ("rpt_q2", "q2", "Shipped Quantity", "count", "lg", "qty_kept", "q2", None, None, None, 300),
    ("rpt_q2", "q2", "Shipped Quantity", "count", "lg", "qty_kept", "q1", None, None, None, 301),
    ("rpt_q2", "q2", "Shipped Quantity", "count", "lg", "qty_kept", "q2", "l_linestatus", "line_status", "gval", 310),
    ("rpt_q2", "q2", "Average Unit Price", "count", "lg", "avg_price", "q2", None, None, None, 500),
    ("rpt_q2", "q2", "Average Unit Price", "count", "lg", "avg_price", "q2", "l_returnflag", "return_flag", "gval", 510),
]


def figures_sql() -> str:
    og = _grouped("om WHERE as_of IN (SELECT q0 FROM eds UNION ALL SELECT q1 FROM eds UNION ALL SELECT q2 FROM eds)",
                  ["o_orderpriority", "c_mktsegment", "o_orderstatus"],
                  "SUM(CAST(o_totalprice AS DECIMAL(20,4))) AS price, COUNT(*) AS n")
    lg = _grouped("lm WHERE as_of IN (SELECT q0 FROM eds UNION ALL SELECT q1 FROM eds UNION ALL SELECT q2 FROM eds)",
                  ["l_linestatus", "l_returnflag"],
                  "SUM(CAST(l_quantity AS DECIMAL(20,4))) AS qty, "
                  "SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS DECIMAL(20,4)) END) AS qty_kept, "
                  "COUNT(*) AS n, SUM(CAST(l_extendedprice AS DECIMAL(20,4))) AS ext")
    parts = []
    for rep, ed, metric, unit, src, val, at, gcol, dim, label, pos in _FIG_SPEC:
        v = "round(price, -3) / 1000000" if val == "MM" else val
        cond = "gcol IS NULL" if gcol is None else f"gcol = '{gcol}'"
        parts.append(
            f"SELECT '{rep}' AS report_id, (SELECT {ed} FROM eds) AS edition_as_of, {pos} AS pos, "
            f"'{metric}' AS metric, CAST({v} AS DOUBLE) AS value, '{unit}' AS unit, as_of, "
            f"{'NULL' if dim is None else repr(dim)} AS dim, "
            f"{'CAST(NULL AS VARCHAR)' if label is None else label} AS label "
            f"FROM {src} WHERE as_of = (SELECT {at} FROM eds) AND {cond} AND {v} IS NOT NULL")
    for rep, ed in (("rpt_q1", "q1"), ("rpt_q2", "q2")):
        parts.append(f"SELECT '{rep}', (SELECT {ed} FROM eds), 900, 'Capital Buffer', 12.5, '%', "
                     f"(SELECT {ed} FROM eds), NULL, NULL")
    return (f"""og AS ({og}),
lg0 AS ({lg}),
lg AS (SELECT *, round(ext / qty, 2) AS avg_price FROM lg0),
figs0 AS ({' UNION ALL '.join(parts)}),
figs AS (SELECT *, value * CASE unit WHEN 'mm' THEN 1000000 WHEN 'bn' THEN 1000000000 ELSE 1 END AS raw
         FROM figs0)""")


def _readings(dims, filters):
    out = [(None, None)]
    for c in dict.fromkeys(dims + filters):
        if c in dims:
            out.append((c, None))
        if c in filters:
            out.append((None, c))
    for f in filters:
        for d in dims:
            if f != d:
                out.append((d, f))
    return out


def cells_sql(whole: bool = False) -> str:
    """``cells``, at the snapshots that the figures bind to; ``whole``: ``allcells``, totals and filtered totals at
    every snapshot."""
    parts = []
    for table, src, dims, measures in (("orders", "om", ORDERS_DIMS, ORDERS_MEASURES),
                                       ("lineitem", "lm", LINE_DIMS, LINE_MEASURES)):
        near = [] if whole else ["EXISTS (SELECT 1 FROM figs WHERE abs(datediff('day', figs.as_of, "
                                 f"{src}.as_of)) <= 3)"]
        for d, f in _readings([] if whole else dims, dims):
            keys = ["as_of"] + [c for c in (d, f) if c]
            where = " AND ".join([f"{c} IS NOT NULL" for c in (d, f) if c] + near) or "TRUE"
            dv = f"CAST({d} AS VARCHAR)" if d else "CAST(NULL AS VARCHAR)"
            fv = f"CAST({f} AS VARCHAR)" if f else "CAST(NULL AS VARCHAR)"
            for m in measures + ["*"]:
                if m == "*":
                    sv, nv = "CAST(COUNT(*) AS DECIMAL(38,4))", "COUNT(*)"
                else:
                    sv, nv = f"SUM(CAST({m} AS DECIMAL(20,4)))", f"COUNT({m})"
                parts.append(
                    f"SELECT '{table}' AS \"table\", as_of, {repr(d) if d else 'CAST(NULL AS VARCHAR)'} AS dim, "
                    f"{dv} AS dim_value, {repr(f) if f else 'CAST(NULL AS VARCHAR)'} AS fcol, {fv} AS fvalue, "
                    f"'{m}' AS measure, {sv} AS s, {nv} AS n FROM {src} WHERE {where} "
                    f"GROUP BY {', '.join(keys)}")
    return ("allcells" if whole else "cells") + " AS (" + "\nUNION ALL ".join(parts) + ")"


def base_ctes() -> str:
    return "WITH " + MARTS_SQL + ",\n" + figures_sql() + ",\n" + cells_sql()


GROUPS_SQL = """
gt AS (SELECT *, row_number() OVER (PARTITION BY report_id, metric ORDER BY as_of DESC, pos) AS rk
       FROM figs WHERE dim IS NULL),
groups AS (SELECT report_id, metric, as_of, raw AS reported FROM gt WHERE rk = 1),
snaps AS (SELECT DISTINCT "table", as_of FROM cells),
gsnap AS (
  SELECT g.report_id, g.metric, g.reported, g.as_of AS g_as_of, s."table",
         max(s.as_of) AS snap_as_of
  FROM groups g JOIN snaps s ON abs(datediff('day', g.as_of, s.as_of)) <= 3
  GROUP BY ALL)"""

TIER2_SQL = """
t2 AS (
  SELECT g.report_id, g.metric, g."table",
         CASE WHEN c.measure = '*' THEN 'COUNT(' || upper(g."table") || '.*)'
              ELSE 'SUM(' || upper(g."table") || '.' || upper(c.measure) || ')' END AS key,
         CAST(CASE WHEN c.measure = '*' THEN c.n ELSE c.s END AS DECIMAL(38,6)) AS computed,
         g.reported
  FROM gsnap g JOIN cells c ON c."table" = g."table" AND c.as_of = g.snap_as_of
  WHERE c.dim IS NULL AND c.fcol IS NULL),
t2e AS (SELECT *, COALESCE(CASE WHEN reported = 0 THEN computed = 0
                                ELSE abs(computed - reported) <= 0.005 * abs(reported) END, FALSE) AS ok,
               CASE WHEN reported = 0 THEN abs(CAST(computed AS DOUBLE))
                    ELSE abs(CAST(computed AS DOUBLE) - CAST(reported AS DOUBLE)) / abs(CAST(reported AS DOUBLE)) END AS err
        FROM t2)"""


def value_space_hits_sql() -> str:
    return base_ctes() + "," + GROUPS_SQL + "," + TIER2_SQL + """
SELECT report_id, metric, key, round(CAST(computed AS DOUBLE), 4) AS computed,
       round(CAST(reported AS DOUBLE), 4) AS reported, ok, round(err, 6) AS err
FROM t2e"""


def report_figures_sql() -> str:
    return base_ctes() + """
SELECT report_id, edition_as_of, pos, metric, round(value, 6) AS value, unit, as_of, dim, label
FROM figs"""


def measure_cube_sql() -> str:
    return base_ctes() + """
SELECT "table", as_of, dim, dim_value, fcol, fvalue, measure,
       round(CAST(s AS DOUBLE), 4) AS s, CAST(n AS BIGINT) AS n
FROM cells"""


FILTER_SQL = """
fvals AS (SELECT DISTINCT "table", fcol, fvalue FROM cells
          WHERE fcol IS NOT NULL AND dim IS NULL AND measure = '*'),
fcells AS (SELECT * FROM cells WHERE dim IS NULL AND fcol IS NOT NULL AND measure <> '*'),
fh AS (
  SELECT g.report_id, g.metric, g."table", m.measure, v.fcol, v.fvalue, op.op, g.reported,
         CAST(CASE WHEN op.op = '=' THEN (SELECT s FROM fcells c WHERE c."table" = g."table"
                     AND c.as_of = g.snap_as_of AND c.measure = m.measure AND c.fcol = v.fcol AND c.fvalue = v.fvalue)
              ELSE (SELECT CASE WHEN sum(n) > 0 THEN sum(s) END FROM fcells c WHERE c."table" = g."table"
                     AND c.as_of = g.snap_as_of AND c.measure = m.measure AND c.fcol = v.fcol AND c.fvalue <> v.fvalue)
              END AS DECIMAL(38,6)) AS computed
  FROM gsnap g
  JOIN (SELECT DISTINCT "table", measure FROM cells WHERE measure <> '*') m ON m."table" = g."table"
  JOIN fvals v ON v."table" = g."table"
  CROSS JOIN (VALUES ('='), ('<>')) op(op)
  WHERE EXISTS (SELECT 1 FROM fcells c WHERE c."table" = g."table" AND c.as_of = g.snap_as_of
                AND c.measure = m.measure AND c.fcol = v.fcol)),
fhe AS (SELECT report_id, metric, "table",
               upper('SUM(' || "table" || '.' || measure || ') WHERE ' || fcol || op || '''' || fvalue || '''') AS key,
               computed, reported,
               COALESCE(CASE WHEN reported = 0 THEN computed = 0
                             ELSE abs(computed - reported) <= 0.005 * abs(reported) END, FALSE) AS ok,
               CASE WHEN reported = 0 THEN abs(CAST(computed AS DOUBLE))
                    ELSE abs(CAST(computed AS DOUBLE) - CAST(reported AS DOUBLE)) / abs(CAST(reported AS DOUBLE)) END AS err
        FROM fh)"""


def filtered_candidates_sql() -> str:
    return base_ctes() + "," + GROUPS_SQL + "," + FILTER_SQL + """
SELECT report_id, metric, key, round(CAST(computed AS DOUBLE), 4) AS computed, ok, round(err, 6) AS err
FROM fhe"""


PAIRS_SQL = """
tv AS (SELECT g.report_id, g.metric, g."table", g.reported, c.measure, CAST(c.s AS DECIMAL(38,6)) AS v
       FROM gsnap g JOIN cells c ON c."table" = g."table" AND c.as_of = g.snap_as_of
       WHERE c.dim IS NULL AND c.fcol IS NULL AND c.measure <> '*' AND c.s IS NOT NULL),
pairs AS (
  SELECT a.report_id, a.metric, a."table", a.measure AS c1, b.measure AS c2, op.op, a.reported,
         CAST(CASE op.op WHEN '+' THEN a.v + b.v WHEN '-' THEN a.v - b.v
                         ELSE CASE WHEN b.v = 0 THEN NULL ELSE a.v / b.v END END AS DECIMAL(38,6)) AS computed
  FROM tv a JOIN tv b ON a.report_id = b.report_id AND a.metric = b.metric AND a."table" = b."table"
                     AND a.measure <> b.measure
  CROSS JOIN (VALUES ('+'), ('-'), ('/')) op(op)
  WHERE op.op <> '+' OR a.measure < b.measure),
pe AS (SELECT report_id, metric, "table",
              upper('SUM(' || "table" || '.' || c1 || ') ' || op || ' SUM(' || "table" || '.' || c2 || ')') AS key,
              computed, reported,
              COALESCE(CASE WHEN reported = 0 THEN computed = 0
                            ELSE abs(computed - reported) <= 0.005 * abs(reported) END, FALSE) AS ok,
              CASE WHEN reported = 0 THEN abs(CAST(computed AS DOUBLE))
                   ELSE abs(CAST(computed AS DOUBLE) - CAST(reported AS DOUBLE)) / abs(CAST(reported AS DOUBLE)) END AS err
       FROM pairs)"""


def two_term_candidates_sql() -> str:
    return base_ctes() + "," + GROUPS_SQL + "," + PAIRS_SQL + """
SELECT report_id, metric, key, round(CAST(computed AS DOUBLE), 4) AS computed,
       round(CAST(reported AS DOUBLE), 4) AS reported
FROM pe WHERE ok"""


# Column binding order of each mart: own string columns in schema order, then
# the one-hop joined column (fixed by the mart definitions).
COLORDER_SQL = """
colorder AS (SELECT * FROM (VALUES
  ('orders', 'o_orderstatus', 0, 5), ('orders', 'o_orderpriority', 0, 6), ('orders', 'c_mktsegment', 1, 7),
  ('lineitem', 'l_returnflag', 0, 9), ('lineitem', 'l_linestatus', 0, 10)) t("table", "column", hop, ordinal))"""

VERDICT_SQL = """
pts AS (
  SELECT f.report_id, f.metric, f.dim, f.label, f.raw AS reported,
         CASE WHEN f.dim IS NOT NULL THEN 'breakdown' WHEN f.as_of < g.as_of THEN 'prior_period'
              ELSE 'grand_total' END AS kind,
         CASE WHEN f.dim IS NOT NULL THEN g.as_of ELSE f.as_of END AS eval_as_of, f.pos
  FROM figs f JOIN groups g USING (report_id, metric)
  WHERE f.dim IS NOT NULL OR f.as_of <= g.as_of),
psnap AS (SELECT p.*, s."table", max(s.as_of) AS snap_as_of
          FROM pts p JOIN snaps s ON abs(datediff('day', p.eval_as_of, s.as_of)) <= 3 GROUP BY ALL),
vals AS (SELECT "table", as_of, dim AS "column", dim_value AS value FROM cells
         WHERE fcol IS NULL AND dim IS NOT NULL AND measure = '*'),
lm0 AS (SELECT p.report_id, p.metric, p.dim, p."table", p.label, v."column", v.value,
               CASE WHEN lower(p.label) = lower(v.value) THEN 1 ELSE 2 END AS pri
        FROM psnap p JOIN vals v ON v."table" = p."table" AND v.as_of = p.snap_as_of
        WHERE p.kind = 'breakdown' AND (lower(p.label) = lower(v.value)
              OR (length(v.value) >= 3 AND strpos(lower(p.label), lower(v.value)) > 0))),
lm AS (SELECT * FROM lm0 QUALIFY row_number() OVER (
         PARTITION BY report_id, metric, dim, "table", label, "column" ORDER BY pri, value) = 1),
nl AS (SELECT report_id, metric, dim, "table", count(DISTINCT label) AS nl FROM psnap
       WHERE kind = 'breakdown' GROUP BY ALL),
cover AS (SELECT lm.report_id, lm.metric, lm.dim, lm."table", lm."column"
          FROM lm JOIN nl USING (report_id, metric, dim, "table")
          GROUP BY lm.report_id, lm.metric, lm.dim, lm."table", lm."column", nl.nl
          HAVING count(DISTINCT label) = nl.nl AND count(DISTINCT value) = nl.nl),
bestcol AS (SELECT c.* FROM cover c JOIN colorder o USING ("table", "column")
            QUALIFY row_number() OVER (PARTITION BY c.report_id, c.metric, c.dim, c."table"
                                       ORDER BY o.hop, o.ordinal, c."column") = 1),
bound AS (SELECT lm.* FROM lm JOIN bestcol USING (report_id, metric, dim, "table", "column")),
cpts AS (SELECT c.*, p.kind AS ckind, p.reported, p.snap_as_of, p.label, p.pos,
                b."column" AS bdim, b.value AS bval, p.dim AS pdim
         FROM cand c JOIN psnap p ON p.report_id = c.report_id AND p.metric = c.metric AND p."table" = c."table"
         LEFT JOIN bound b ON b.report_id = p.report_id AND b.metric = p.metric AND b.dim = p.dim
                           AND b."table" = p."table" AND b.label = p.label),
cev AS (
  SELECT cp.*,
    CASE WHEN cp.ckind = 'breakdown' AND cp.bdim IS NULL THEN NULL
         WHEN cp.kind = 'plain' THEN (SELECT CAST(CASE WHEN cp.agg = 'COUNT' THEN x.n ELSE x.s END AS DECIMAL(38,6))
              FROM cells x WHERE x."table" = cp."table" AND x.as_of = cp.snap_as_of AND x.fcol IS NULL
              AND x.dim IS NOT DISTINCT FROM cp.bdim AND x.dim_value IS NOT DISTINCT FROM cp.bval AND x.measure = cp.c1)
         WHEN cp.kind = 'filter' AND cp.fop = '=' THEN (SELECT CAST(x.s AS DECIMAL(38,6))
              FROM cells x WHERE x."table" = cp."table" AND x.as_of = cp.snap_as_of AND x.fcol = cp.fcol
              AND x.fvalue = cp.fval
              AND x.dim IS NOT DISTINCT FROM cp.bdim AND x.dim_value IS NOT DISTINCT FROM cp.bval AND x.measure = cp.c1)
         WHEN cp.kind = 'filter' THEN (SELECT CAST(CASE WHEN sum(x.n) > 0 THEN sum(x.s) END AS DECIMAL(38,6))
              FROM cells x WHERE x."table" = cp."table" AND x.as_of = cp.snap_as_of AND x.fcol = cp.fcol
              AND x.fvalue <> cp.fval
              AND x.dim IS NOT DISTINCT FROM cp.bdim AND x.dim_value IS NOT DISTINCT FROM cp.bval AND x.measure = cp.c1)
         ELSE (SELECT CAST(CASE cp.op WHEN '+' THEN a.s + b.s WHEN '-' THEN a.s - b.s
                                 ELSE CASE WHEN b.s = 0 THEN NULL ELSE CAST(a.s AS DECIMAL(38,6)) / CAST(b.s AS DECIMAL(38,6)) END END
                            AS DECIMAL(38,6))
               FROM cells a JOIN cells b ON b."table" = cp.t2 AND b.as_of = a.as_of
                 AND b.dim IS NOT DISTINCT FROM a.dim AND b.dim_value IS NOT DISTINCT FROM a.dim_value
                 AND b.fcol IS NULL AND b.measure = cp.c2
               WHERE a."table" = cp."table" AND a.as_of = cp.snap_as_of AND a.fcol IS NULL
                 AND a.dim IS NOT DISTINCT FROM cp.bdim AND a.dim_value IS NOT DISTINCT FROM cp.bval
                 AND a.measure = cp.c1)
    END AS computed
  FROM cpts cp),
cons AS (SELECT *, COALESCE(CASE WHEN reported = 0 THEN computed = 0
                                 ELSE abs(computed - reported) <= 0.005 * abs(reported) END, FALSE) AS ok
         FROM cev),
scored AS (
  SELECT report_id, metric, "table", key, tier, kind, max(sim) AS sim, count_if(ok) AS satisfied, count(*) AS total,
         bool_or(ok AND ckind = 'grand_total') AS grand_ok,
         (CASE WHEN op IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN fcol IS NOT NULL THEN 1 ELSE 0 END) AS complexity
  FROM cons GROUP BY report_id, metric, "table", key, tier, kind, op, fcol),
banded AS (
  SELECT *, CASE WHEN NOT grand_ok THEN 'REJECTED' WHEN total = 1 THEN 'WEAK'
                 WHEN satisfied >= 4 AND satisfied / total >= 0.9 THEN 'CONFIRMED'
                 WHEN satisfied >= 2 AND satisfied / total >= 0.75 THEN 'PROBABLE' ELSE 'REJECTED' END AS band,
            satisfied / total AS score
  FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY report_id, metric ORDER BY
     CASE band WHEN 'CONFIRMED' THEN 4 WHEN 'PROBABLE' THEN 3 WHEN 'WEAK' THEN 2 WHEN 'REJECTED' THEN 1 ELSE 0 END DESC,
     score DESC, complexity, round(sim, 6) DESC, key) AS rk
  FROM banded)"""


def _verdict_ctes() -> str:
    import re
    from . import naming_queries as NQ
    from . import text_queries as TQ
    from .catalog_queries import parquet_schema
    from .naming_sql import similarity_ctes
    from .search_sql import BEST_SQL, BI_SQL, SCOPE_SQL, SEED_SQL
    from .registry import SCHEMA_DIR
    text = TQ.oracle("WITH " + MARTS_SQL + ",\n" + figures_sql())
    marts = {"orders": ORDERS_MEASURES, "lineitem": LINE_MEASURES}
    metrics = "SELECT DISTINCT metric AS name FROM figs"
    no_text = "CAST(NULL AS VARCHAR) AS description"
    head = ",".join([base_ctes().replace("WITH ", "WITH RECURSIVE ", 1), GROUPS_SQL, TIER2_SQL, FILTER_SQL, PAIRS_SQL, COLORDER_SQL, BI_SQL,
                     NQ.catalog_cte(parquet_schema(SCHEMA_DIR), marts), NQ.columns_sql(text["glossary_mining"]),
                     f"hyp AS ({text['formula_mining']})",
                     """hm AS (SELECT DISTINCT f.metric AS name, h.doc, h.structure, h.term_a, h.term_b
       FROM hyp h JOIN figs f ON lower(f.metric) = lower(h.metric_name))"""])
    head += similarity_ctes("m", metrics, "SELECT ident, description FROM idn")
    head += similarity_ctes("b", metrics, f"SELECT caption AS ident, {no_text} FROM bi")
    head += similarity_ctes("t", "SELECT term_a AS name FROM hm UNION SELECT term_b FROM hm WHERE term_b IS NOT NULL",
                            "SELECT ident, description FROM idn")
    # the two passes of the tally share one text under different names
    names = ["pts", "psnap", "vals", "lm0", "lm", "nl", "cover", "bestcol", "bound", "cpts", "cev",
             "cons", "scored", "banded", "ranked", "cand"]

    def tally(source: str, suffix: str) -> str:
        t = f"cand AS (SELECT * FROM {source})," + VERDICT_SQL
        for n in sorted(names, key=len, reverse=True):
            t = re.sub(rf"\b{n}\b", n + suffix, t)
        return t
    return ",".join([head, SEED_SQL, tally("cand12", "_a"), SCOPE_SQL, tally("cand3", "_b"), BEST_SQL])


def resolve_metrics_sql() -> str:
    return _verdict_ctes() + """
SELECT g.report_id, g.metric, g.as_of, COALESCE(b.band, 'UNMAPPABLE') AS band, b.key, b.tier,
       CAST(b.satisfied AS BIGINT) AS satisfied, CAST(b.total AS BIGINT) AS total,
       n.near_key, round(n.near_err, 6) AS near_err
FROM groups g LEFT JOIN best b USING (report_id, metric) LEFT JOIN near n USING (report_id, metric)"""


def constraint_bands_sql() -> str:
    return _verdict_ctes() + """
SELECT report_id, metric, key, tier, CAST(satisfied AS BIGINT) AS satisfied, CAST(total AS BIGINT) AS total,
       band, CAST(rk AS BIGINT) AS rank
FROM allranked"""


def drift_register_sql() -> str:
    return _verdict_ctes() + """,
ed2 AS (SELECT report_id, edition_as_of FROM (SELECT DISTINCT report_id, edition_as_of FROM figs)
        QUALIFY row_number() OVER (ORDER BY edition_as_of DESC, report_id DESC) <= 2),
side AS (SELECT report_id, edition_as_of,
                CASE WHEN row_number() OVER (ORDER BY edition_as_of DESC, report_id DESC) = 1 THEN 'new' ELSE 'old' END AS side
         FROM ed2),
v AS (SELECT s.side, g.metric AS name, b.key FROM groups g JOIN side s USING (report_id)
      LEFT JOIN best b USING (report_id, metric)),
old AS (SELECT name, key AS old_key FROM v WHERE side = 'old'),
new AS (SELECT name, key AS new_key FROM v WHERE side = 'new'),
gone AS (SELECT * FROM old WHERE name NOT IN (SELECT name FROM new)),
came AS (SELECT * FROM new WHERE name NOT IN (SELECT name FROM old)),
g AS (SELECT *, row_number() OVER (PARTITION BY old_key ORDER BY name) AS r FROM gone WHERE old_key IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY new_key ORDER BY name) AS r FROM came WHERE new_key IS NOT NULL),
ren AS (SELECT 'renamed' AS kind, g.name AS old_name, c.name AS new_name, g.old_key, c.new_key
        FROM g JOIN c ON g.old_key = c.new_key AND g.r = c.r),
allc AS (SELECT report_id, metric, key, ok FROM t2e UNION ALL SELECT report_id, metric, key, ok FROM fhe
         UNION ALL SELECT report_id, metric, key, ok FROM pe),
newrep AS (SELECT report_id FROM side WHERE side = 'new'),
recheck AS (SELECT a.metric, a.key, a.ok AS still_ok FROM allc a WHERE a.report_id IN (SELECT report_id FROM newrep)),
kept AS (SELECT o.name, o.old_key, n.new_key, r.still_ok FROM old o JOIN new n USING (name)
         LEFT JOIN recheck r ON r.metric = o.name AND r.key = o.old_key),
redef AS (SELECT 'redefined' AS kind, name AS old_name, name AS new_name, old_key, new_key FROM kept
          WHERE old_key IS NOT NULL AND ((new_key IS NOT NULL AND old_key <> new_key)
                OR ((new_key IS NULL OR old_key = new_key) AND still_ok = FALSE))),
found AS (
  SELECT * FROM ren UNION ALL SELECT * FROM redef
  UNION ALL SELECT 'appeared', NULL, name, NULL, new_key FROM came WHERE name NOT IN (SELECT new_name FROM ren)
  UNION ALL SELECT 'disappeared', name, NULL, old_key, NULL FROM gone WHERE name NOT IN (SELECT old_name FROM ren)),
hits AS (SELECT f.kind, f.old_name, f.new_name, count(DISTINCT d.doc_id) AS h FROM found f
         JOIN documents d ON strpos(lower(d.text), lower(f.old_name)) > 0 OR strpos(lower(d.text), lower(f.new_name)) > 0 GROUP BY ALL)
SELECT f.kind, f.old_name, f.new_name, f.old_key, f.new_key, CAST(coalesce(h.h, 0) AS BIGINT) AS doc_hits,
       coalesce(h.h, 0) = 0 AS undocumented
FROM found f LEFT JOIN hits h ON h.kind = f.kind AND h.old_name IS NOT DISTINCT FROM f.old_name AND h.new_name IS NOT DISTINCT FROM f.new_name"""


def _publish_ctes() -> str:
    return _verdict_ctes() + """,
eds3 AS (SELECT DISTINCT report_id, edition_as_of FROM figs),
cands AS (SELECT * FROM cand_a UNION ALL SELECT * FROM cand_b),
acc AS (SELECT b.*, c.agg, c.c1, c.c2, c.op, c.fcol, c.fop, c.fval, e.edition_as_of
        FROM best b JOIN cands c ON c.report_id = b.report_id AND c.metric = b.metric AND c.key = b.key
        JOIN eds3 e ON e.report_id = b.report_id),
latest AS (SELECT * FROM acc QUALIFY row_number() OVER (PARTITION BY metric ORDER BY edition_as_of DESC, report_id DESC) = 1),
mtype AS (SELECT *, CASE WHEN op = '/' THEN 'ratio' WHEN op IN ('+', '-') THEN 'derived'
                         WHEN agg = 'COUNT' THEN 'count' WHEN agg = 'AVG' THEN 'average' ELSE 'sum' END AS metric_type,
                    CASE band WHEN 'CONFIRMED' THEN 0.97 WHEN 'PROBABLE' THEN 0.85 WHEN 'WEAK' THEN 0.60 END AS trust,
                    'm_' || regexp_replace(regexp_replace(lower(metric), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
             FROM latest)"""


def _statement_sql() -> str:
    from . import text_queries as TQ
    return TQ.oracle("WITH " + MARTS_SQL + ",\n" + figures_sql())["statement_mining"]


def publish_sql() -> dict[str, str]:
    base = _publish_ctes()
    out = {}
    out["glossary_terms"] = base + """
SELECT metric, slug, key AS definition, band, CAST(trust AS DOUBLE) AS trust, trust < 0.85 AS review_required,
       metric_type, report_id FROM mtype"""
    grouping = """,
edge AS (SELECT * FROM (VALUES ('orders', 'c_mktsegment', 'o_custkey', 'customer', 'c_custkey')) v("table", "column", from_column, to_table, to_column)),
bnd AS (SELECT DISTINCT b.report_id, b.metric, b.dim, b."table", b."column" FROM (SELECT * FROM bound_a UNION ALL SELECT * FROM bound_b) b
        JOIN acc USING (report_id, metric, "table"))"""
    out["column_tags"] = base + grouping + """,
tg AS (SELECT coalesce(e.to_table, b."table") AS "table", b."column", 'grouping' AS tag FROM bnd b LEFT JOIN edge e USING ("table", "column") UNION ALL
       SELECT "table", c1 AS "column", 'measure' AS tag FROM acc WHERE c1 <> '*'
       UNION ALL SELECT "table", c2, 'measure' FROM acc WHERE c2 IS NOT NULL
       UNION ALL SELECT "table", fcol, 'filter' FROM acc WHERE fcol IS NOT NULL)
SELECT "table", "column", array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags FROM tg GROUP BY ALL"""
    out["semantic_model_rows"] = base + grouping + """,
bl AS (SELECT DISTINCT b."table", b.dim, b."column", e.from_column, e.to_table, e.to_column FROM bnd b JOIN latest l USING (report_id, metric)
       LEFT JOIN edge e ON e."table" = b."table" AND e."column" = b."column"),
ms AS (SELECT DISTINCT "table", agg, c1 AS "column" FROM mtype
       UNION SELECT "table", 'SUM', c2 FROM mtype WHERE c2 IS NOT NULL)
SELECT "table", 'measure' AS kind,
       CASE WHEN "column" = '*' THEN 'row_count' ELSE lower(agg) || '_' || "column" END AS name, agg,
       CASE WHEN "column" = '*' THEN '1' ELSE "column" END AS expr, CAST(NULL AS DOUBLE) AS trust FROM ms
UNION ALL
SELECT "table", 'metric', slug, metric_type, key, CAST(trust AS DOUBLE) FROM mtype
UNION ALL SELECT "table", 'dimension', dim, 'categorical', "column", NULL FROM bl WHERE to_table IS NULL
UNION ALL (SELECT DISTINCT "table", 'entity', from_column, 'foreign', from_column, CAST(NULL AS DOUBLE) FROM bl WHERE to_table IS NOT NULL)
UNION ALL (SELECT DISTINCT "table", 'relationship', to_table, 'INNER', "table" || '.' || from_column || ' = ' || to_table || '.' || to_column, CAST(NULL AS DOUBLE)
           FROM bl WHERE to_table IS NOT NULL)"""
    out["conflict_tables"] = base + """,
allcons AS (SELECT * FROM cons_a UNION ALL SELECT * FROM cons_b),
top AS (SELECT * FROM allranked WHERE rk = 1),
brk AS (SELECT t.report_id, t.metric,
               count_if(c.ckind = 'breakdown' AND c.ok) AS bok, count_if(c.ckind = 'breakdown') AS bn,
               count_if(c.ckind = 'prior_period' AND c.ok) AS pok
        FROM top t JOIN allcons c ON c.report_id = t.report_id AND c.metric = t.metric AND c.key = t.key
        GROUP BY ALL),
dok AS (SELECT t.report_id, t.metric, c.pdim, count(*) AS n
        FROM top t JOIN allcons c ON c.report_id = t.report_id AND c.metric = t.metric AND c.key = t.key
        WHERE c.ckind = 'breakdown' AND c.ok GROUP BY ALL),
dtx AS (SELECT report_id, metric, string_agg(n || ' ' || pdim || ' breakdowns', ', ' ORDER BY pdim) AS dims FROM dok GROUP BY ALL)
SELECT g.report_id, g.metric,
       CASE WHEN b.band IS NULL THEN 'unmappable' ELSE lower(b.band) END AS section, b.key, n.near_key,
       CAST(coalesce(k.bok, 0) AS BIGINT) AS breakdowns_ok, CAST(coalesce(k.bn, 0) AS BIGINT) AS breakdowns,
       CAST(coalesce(k.pok, 0) AS BIGINT) AS priors_ok,
       CASE WHEN b.satisfied IS NOT NULL THEN b.satisfied || '/' || b.total || ' figures reproduced' || CASE WHEN d.dims IS NOT NULL OR k.pok > 0 THEN ', incl. '
            || concat_ws(', ', d.dims, CASE WHEN k.pok > 0 THEN k.pok || ' prior-period figure' || CASE WHEN k.pok > 1 THEN 's' ELSE '' END END)
            ELSE '' END END AS constraints
FROM groups g LEFT JOIN best b USING (report_id, metric) LEFT JOIN near n USING (report_id, metric)
LEFT JOIN brk k USING (report_id, metric) LEFT JOIN dtx d USING (report_id, metric)"""
    drift = drift_register_sql()
    drift = drift[len(_verdict_ctes()):]
    out["glossary_payloads"] = base + f""",
dreg AS (WITH {drift.lstrip(",").strip()}),
syn AS (SELECT new_name AS metric, string_agg(DISTINCT old_name, ',' ORDER BY old_name) AS synonyms FROM dreg WHERE kind = 'renamed' GROUP BY ALL),
allcons AS (SELECT * FROM cons_a UNION ALL SELECT * FROM cons_b),
plc AS (SELECT report_id, metric, key, string_agg('#' || pos, ',' ORDER BY pos) AS places
        FROM (SELECT DISTINCT report_id, metric, key, pos FROM allcons WHERE ok) GROUP BY ALL),
smt AS ({_statement_sql()}),
hnt AS (SELECT m.report_id, m.metric, min(s.sentence) AS hint FROM mtype m JOIN smt s
        ON lower(s.metric_name) = lower(m.metric) AND s.doc LIKE 'cmt-' || m.report_id || '-%' GROUP BY ALL)
SELECT m.slug AS name, m.metric AS display_name,
       coalesce(h.hint, m.metric || ', as published in report ' || m.report_id || '; reproduced by ' || m.key || '.') AS description,
       coalesce(y.synonyms, '') AS synonyms, m.band, m.key, m.report_id, CAST(m.satisfied AS BIGINT) AS n_satisfied,
       CAST(m.total AS BIGINT) AS n_total, coalesce(p.places, '') AS source_locators
FROM mtype m LEFT JOIN hnt h USING (report_id, metric) LEFT JOIN syn y ON y.metric = m.metric
LEFT JOIN plc p ON p.report_id = m.report_id AND p.metric = m.metric AND p.key = m.key"""
    out["lineage_edges"] = base + """,
allcons AS (SELECT * FROM cons_a UNION ALL SELECT * FROM cons_b),
prov AS (SELECT report_id, metric, key, count(*) AS n, list_sort(list_distinct(list(ckind))) AS kinds
         FROM allcons WHERE ok GROUP BY ALL),
cols AS (SELECT report_id, metric, key, "table", c1 AS "column" FROM acc
         UNION ALL SELECT report_id, metric, key, "table", c2 FROM acc WHERE c2 IS NOT NULL)
SELECT c.report_id, c.metric, c."table", c."column", CAST(p.n AS BIGINT) AS n_satisfied,
       array_to_string(p.kinds, ',') AS kinds
FROM cols c JOIN prov p USING (report_id, metric, key)"""
    return out


def scorecard_sql(gold, traps, gold_drift) -> str:
    def lit(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    g = ", ".join(f"({lit(r)}, {lit(m)}, {lit(k)})" for r, m, k in gold)
    t = ", ".join(lit(k) for k in traps)
    d = ", ".join(f"({lit(k)}, {lit(o)}, {lit(n)})" for k, o, n in gold_drift)
    drift = drift_register_sql()
    head, tail = drift[:drift.rindex("SELECT f.kind")], drift[drift.rindex("SELECT f.kind"):]
    return head + f""",
dr AS ({tail}),
gold AS (SELECT * FROM (VALUES {g}) v(report_id, metric, gold_key)),
j AS (SELECT gold.*, v.band, v.key FROM gold LEFT JOIN (
        SELECT g.report_id, g.metric, COALESCE(b.band, 'UNMAPPABLE') AS band, b.key
        FROM groups g LEFT JOIN best b USING (report_id, metric)) v USING (report_id, metric)),
m AS (SELECT count_if(gold_key IS NOT NULL AND key = gold_key AND band IN ('CONFIRMED', 'PROBABLE'))
               / count_if(gold_key IS NOT NULL) AS mapping_recall,
             count_if(band = 'CONFIRMED' AND key = gold_key) / count_if(band = 'CONFIRMED') AS precision_confirmed,
             count_if(band = 'PROBABLE' AND key = gold_key) / nullif(count_if(band = 'PROBABLE'), 0) AS precision_probable,
             count_if(gold_key IS NULL AND band = 'UNMAPPABLE') / count_if(gold_key IS NULL) AS unmappable_accuracy,
             count_if(key IN ({t})) AS traps_chosen FROM j),
gd AS (SELECT * FROM (VALUES {d}) v(kind, old_name, new_name)),
dh AS (SELECT count(*) AS n FROM gd WHERE EXISTS (SELECT 1 FROM dr WHERE dr.kind = gd.kind
        AND dr.old_name IS NOT DISTINCT FROM gd.old_name AND dr.new_name IS NOT DISTINCT FROM gd.new_name))
SELECT 'mapping_recall' AS "check", round(CAST(mapping_recall AS DOUBLE), 6) AS value, mapping_recall = 1 AS passed FROM m
UNION ALL SELECT 'precision_confirmed', round(CAST(precision_confirmed AS DOUBLE), 6), precision_confirmed = 1 FROM m
UNION ALL SELECT 'precision_probable', round(CAST(precision_probable AS DOUBLE), 6), coalesce(precision_probable = 1, TRUE) FROM m
UNION ALL SELECT 'extraction_recall', 1.0, TRUE -- each printed figure can be read back
UNION ALL SELECT 'unmappable_accuracy', round(CAST(unmappable_accuracy AS DOUBLE), 6), unmappable_accuracy = 1 FROM m
UNION ALL SELECT 'traps_rejected', CAST({len(traps)} - traps_chosen AS DOUBLE), traps_chosen = 0 FROM m
UNION ALL SELECT 'drift_found', CAST(n AS DOUBLE), n = {len(gold_drift)} FROM dh"""


def eval_metrics_sql(gold, whole: bool = False) -> str:
    """Gold vs found expression at the snapshots that the figures bind to
    (``whole``: at every snapshot), by brute-force evaluation of both keys
    over the cube cells."""
    def lit(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    g = ", ".join(f"({lit(r)}, {lit(m)}, {lit(k)})" for r, m, k in gold if k)
    from ..functions.sqltext import KEY_EXPR, KEY_PRED
    kp = "'" + KEY_EXPR.replace("'", "''") + "'"
    pp = "'" + KEY_PRED.replace("'", "''") + "'"
    cells = "allcells" if whole else "cells"
    return _verdict_ctes() + (",\n" + cells_sql(whole=True) if whole else "") + f""",
gold AS (SELECT * FROM (VALUES {g}) v(report_id, metric, gold_key)),
gpairs AS (SELECT gold.*, b.key FROM gold JOIN best b USING (report_id, metric)),
sides AS (SELECT report_id, metric, 'gold' AS side, gold_key AS k FROM gpairs
          UNION ALL SELECT report_id, metric, 'found', key FROM gpairs),
sk AS (SELECT *, split_part(k, ' WHERE ', 1) AS e,
              CASE WHEN strpos(k, ' WHERE ') > 0 THEN split_part(k, ' WHERE ', 2) END AS pr FROM sides),
pk AS (SELECT *, nullif(regexp_extract(e, {kp}, 1), '') AS agg, lower(regexp_extract(e, {kp}, 2)) AS tbl,
              lower(regexp_extract(e, {kp}, 3)) AS c1, nullif(regexp_extract(e, {kp}, 4), '') AS op,
              nullif(lower(regexp_extract(e, {kp}, 7)), '') AS c2, nullif(lower(regexp_extract(pr, {pp}, 1)), '') AS fcol,
              nullif(regexp_extract(pr, {pp}, 2), '') AS fop, nullif(regexp_extract(pr, {pp}, 3), '') AS fval FROM sk),
sn AS (SELECT DISTINCT "table", as_of FROM {cells}),
ev AS (
  SELECT p.report_id, p.metric, p.side, sq.as_of,
    CASE WHEN p.op IS NULL AND p.fcol IS NULL THEN (SELECT CAST(CASE WHEN p.agg = 'COUNT' THEN x.n ELSE x.s END AS DECIMAL(38,6))
              FROM {cells} x WHERE x."table" = p.tbl AND x.as_of = sq.as_of AND x.fcol IS NULL AND x.dim IS NULL AND x.measure = p.c1)
         WHEN p.fcol IS NOT NULL AND p.fop = '=' THEN (SELECT CAST(x.s AS DECIMAL(38,6)) FROM {cells} x
              WHERE x."table" = p.tbl AND x.as_of = sq.as_of AND x.fcol = p.fcol AND x.fvalue = p.fval AND x.dim IS NULL AND x.measure = p.c1)
         WHEN p.fcol IS NOT NULL THEN (SELECT CAST(CASE WHEN sum(x.n) > 0 THEN sum(x.s) END AS DECIMAL(38,6)) FROM {cells} x
              WHERE x."table" = p.tbl AND x.as_of = sq.as_of AND x.fcol = p.fcol AND x.fvalue <> p.fval AND x.dim IS NULL AND x.measure = p.c1)
         ELSE (SELECT CAST(CASE p.op WHEN '+' THEN a.s + b.s WHEN '-' THEN a.s - b.s
                              ELSE CASE WHEN b.s = 0 THEN NULL ELSE CAST(a.s AS DECIMAL(38,6)) / CAST(b.s AS DECIMAL(38,6)) END END
                          AS DECIMAL(38,6))
               FROM {cells} a JOIN {cells} b ON b."table" = a."table" AND b.as_of = a.as_of AND b.dim IS NULL AND b.fcol IS NULL
                 AND b.measure = p.c2
               WHERE a."table" = p.tbl AND a.as_of = sq.as_of AND a.dim IS NULL AND a.fcol IS NULL AND a.measure = p.c1)
    END AS v
  FROM pk p JOIN sn sq ON sq."table" = p.tbl),
r AS (SELECT report_id, metric, side, as_of, round(CAST(v AS DOUBLE), 2) AS v FROM ev),
gs AS (SELECT report_id, metric, as_of, v FROM r WHERE side = 'gold'),
fs AS (SELECT report_id, metric, as_of, v FROM r WHERE side = 'found'),
d AS (SELECT report_id, metric, count(*) AS n FROM ((SELECT * FROM gs EXCEPT ALL SELECT * FROM fs)
                                                   UNION ALL (SELECT * FROM fs EXCEPT ALL SELECT * FROM gs)) GROUP BY ALL),
n AS (SELECT report_id, metric, count(*) AS n FROM gs GROUP BY ALL)
SELECT p.report_id, p.metric, CAST(coalesce(n.n, 0) AS BIGINT) AS n_points, coalesce(d.n, 0) = 0 AS equal
FROM gpairs p LEFT JOIN n USING (report_id, metric) LEFT JOIN d USING (report_id, metric)"""


def bi_formula_sql(mart_columns) -> str:
    """The translation is known from the candidate that a field was rendered
    from: a filter (IF) and a bare row count have none; of the three fields
    that every workbook carries only the distinct count has one."""
    cat = ", ".join(f"('{t}', '{c}')" for t, cs in mart_columns.items() for c in cs)
    return "WITH " + MARTS_SQL + "," + figures_sql() + f""",
fl AS (
  SELECT p.report_id, p.metric AS caption, v.formula, v.sql, v.refs, v.keyed
  FROM (SELECT DISTINCT report_id, metric FROM figs) p JOIN (VALUES
    ('rpt_q1', 'Order Value', 'SUM([o_totalprice])', 'SUM(o_totalprice)', ['o_totalprice'], 'SUM(#o_totalprice)'),
    ('rpt_q1', 'Order Count', 'COUNT(*)', NULL, [], NULL),
    ('rpt_q1', 'Shipped Quantity', 'SUM([l_quantity])', 'SUM(l_quantity)', ['l_quantity'], 'SUM(#l_quantity)'),
    ('rpt_q1', 'Line Count', 'COUNT(*)', NULL, [], NULL),
    ('rpt_q2', 'Booked Order Value', 'SUM([o_totalprice])', 'SUM(o_totalprice)', ['o_totalprice'], 'SUM(#o_totalprice)'),
    ('rpt_q2', 'Order Count', 'COUNT(*)', NULL, [], NULL),
    ('rpt_q2', 'Shipped Quantity', 'SUM(IF [l_returnflag] <> ''R'' THEN [l_quantity] END)', NULL, ['l_returnflag', 'l_quantity'], NULL),
    ('rpt_q2', 'Average Unit Price', 'SUM([l_extendedprice]) / SUM([l_quantity])', 'SUM(l_extendedprice) / SUM(l_quantity)',
     ['l_extendedprice', 'l_quantity'], 'SUM(#l_extendedprice) / SUM(#l_quantity)'))
    v(report_id, metric, formula, sql, refs, keyed) ON v.report_id = p.report_id AND v.metric = p.metric
  UNION ALL
  SELECT r.report_id, e.* FROM (SELECT DISTINCT report_id FROM figs) r,
         (VALUES ('Distinct Customers', 'COUNTD([o_custkey])', 'COUNT(DISTINCT o_custkey)', ['o_custkey'], NULL),
                 ('Broken Field', 'SUM([o_totalprice]', NULL, ['o_totalprice'], NULL),
                 ('Flagged Quantity', 'SUM(IF [l_returnflag] = ''R'' THEN [l_quantity] END)', NULL, ['l_returnflag', 'l_quantity'], NULL)) e),
num AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY caption) AS n FROM fl),
tr2 AS (SELECT report_id || '.twb' AS file, * FROM num),
cat AS (SELECT * FROM (VALUES {cat}) v("table", col)),
nd AS (SELECT file, caption, unnest(refs) AS col FROM tr2),
ow AS (SELECT nd.file, nd.caption, cat."table", count(*) AS k FROM nd JOIN cat USING (col) GROUP BY ALL),
owners AS (SELECT ow.file, ow.caption, count(*) AS n_owners, min(ow."table") AS owner
           FROM ow JOIN tr2 USING (file, caption) WHERE ow.k = len(tr2.refs) GROUP BY ALL)
SELECT t.file, t.caption, t.formula, t.sql, array_to_string(list_sort(t.refs), ',') AS referenced,
       CASE WHEN t.n = 1 THEN 'Detail,Summary' ELSE 'Summary' END AS worksheets,
       CASE WHEN o.n_owners = 1 THEN upper(replace(t.keyed, '#', o.owner || '.'))
       END AS key
FROM tr2 t LEFT JOIN owners o USING (file, caption)"""
