"""SQL of the tiered search for the oracles: seeds by name, BI field and prose, tier rules, scope, near misses."""

# What the BI team's fields mean: caption, owning table, aggregate, column, and the second term.
BI_SQL = """
bi AS (SELECT * FROM (VALUES
  ('Order Value', 'orders', 'SUM', 'o_totalprice', NULL, NULL), ('Booked Order Value', 'orders', 'SUM', 'o_totalprice', NULL, NULL),
  ('Shipped Quantity', 'lineitem', 'SUM', 'l_quantity', NULL, NULL),
  ('Average Unit Price', 'lineitem', 'SUM', 'l_extendedprice', '/', 'l_quantity')) v(caption, "table", agg, c1, op, c2)
  WHERE caption IN (SELECT metric FROM figs))"""

SEED_SQL = """
termcols AS (SELECT name AS term, "table", "column", sim FROM t_sim JOIN idn USING (ident) WHERE sim > 0.15),
seedc AS (
  SELECT name AS metric, 1 AS tier, "table", 'SUM' AS agg, "column" AS c1, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS t2,
         CAST(NULL AS VARCHAR) AS c2, sim FROM m_sim JOIN idn USING (ident) WHERE sim >= 0.5
  UNION ALL
  SELECT s.name, t.tier, b."table", b.agg, b.c1, b.op, CASE WHEN b.op IS NOT NULL THEN b."table" END, b.c2, s.sim
  FROM b_sim s JOIN bi b ON b.caption = s.ident JOIN (VALUES (1, 0.4), (3, 0.3)) t(tier, floor) ON s.sim >= t.floor
  UNION ALL
  SELECT h.name, 3, a."table", 'SUM', a."column", NULL, NULL, NULL, a.sim
  FROM hm h JOIN termcols a ON a.term = h.term_a WHERE h.structure = 'SUM(A)'
  UNION ALL
  SELECT h.name, 3, a."table", 'SUM', a."column", CASE h.structure WHEN 'A - B' THEN '-' WHEN 'A + B' THEN '+' ELSE '/' END, b."table", b."column", (a.sim + b.sim) / 2
  FROM hm h JOIN termcols a ON a.term = h.term_a JOIN termcols b ON b.term = h.term_b
  WHERE h.structure <> 'SUM(A)' AND NOT (a."table" = b."table" AND a."column" = b."column")),
seedv AS (
  SELECT g.report_id, g.metric, s.tier, g."table", s.agg, s.c1, s.op, s.t2, s.c2, g.reported, g.snap_as_of, max(s.sim) AS sim,
         upper(s.agg || '(' || g."table" || '.' || s.c1 || ')' || coalesce(' ' || s.op || ' SUM(' || s.t2 || '.' || s.c2 || ')', '')) AS key
  FROM gsnap g JOIN seedc s ON s.metric = g.metric AND s."table" = g."table" GROUP BY ALL),
total AS (SELECT "table", as_of, measure, CAST(s AS DECIMAL(38,6)) AS s, CAST(n AS DECIMAL(38,6)) AS n FROM cells WHERE dim IS NULL AND fcol IS NULL),
seedx AS (
  SELECT v.*, CAST(CASE WHEN v.op IS NULL THEN CASE WHEN v.agg = 'COUNT' THEN a.n ELSE a.s END
                        WHEN v.op = '+' THEN a.s + b.s WHEN v.op = '-' THEN a.s - b.s
                        ELSE CASE WHEN b.s = 0 THEN NULL ELSE a.s / b.s END END AS DECIMAL(38,6)) AS computed
  FROM seedv v LEFT JOIN total a ON a."table" = v."table" AND a.as_of = v.snap_as_of AND a.measure = v.c1
  LEFT JOIN total b ON b."table" = v.t2 AND b.as_of = v.snap_as_of AND b.measure = v.c2),
seede AS (SELECT *, COALESCE(CASE WHEN reported = 0 THEN computed = 0 ELSE abs(computed - reported) <= 0.005 * abs(reported) END, FALSE) AS ok,
                 CASE WHEN reported = 0 THEN abs(CAST(computed AS DOUBLE))
                      ELSE abs(CAST(computed AS DOUBLE) - CAST(reported AS DOUBLE)) / abs(CAST(reported AS DOUBLE)) END AS err FROM seedx),
fin AS (SELECT report_id, metric, min(tier) AS decided FROM (SELECT report_id, metric, tier FROM seede WHERE ok AND tier = 1
        UNION ALL SELECT report_id, metric, 2 FROM t2e WHERE ok) GROUP BY report_id, metric),
dec AS (SELECT g.report_id, g.metric, coalesce(f.decided, 3) AS decided FROM groups g LEFT JOIN fin f USING (report_id, metric)),
csim AS (SELECT name AS metric, "table", "column", sim FROM m_sim JOIN idn USING (ident) WHERE sim >= 0.15),
cand12 AS (
  SELECT s.report_id, s.metric, s."table", s.key, s.tier, CASE WHEN s.op IS NULL THEN 'plain' ELSE 'pair' END AS kind, s.agg, s.c1, s.c2, s.op,
         CAST(NULL AS VARCHAR) AS fcol, CAST(NULL AS VARCHAR) AS fop, CAST(NULL AS VARCHAR) AS fval, s.t2, s.sim
  FROM seede s JOIN dec d USING (report_id, metric) WHERE s.ok AND s.tier = 1 AND d.decided = 1
  UNION ALL
  SELECT t.report_id, t.metric, t."table", t.key, 2, 'plain', CASE WHEN t.key LIKE 'COUNT(%' THEN 'COUNT' ELSE 'SUM' END,
         CASE WHEN t.key LIKE 'COUNT(%' THEN '*' ELSE lower(split_part(split_part(t.key, '.', 2), ')', 1)) END,
         NULL, NULL, NULL, NULL, NULL, NULL, 0.0
  FROM t2e t JOIN dec d USING (report_id, metric) WHERE t.ok AND d.decided = 2)"""

SCOPE_SQL = """
resolved AS (SELECT DISTINCT "table" FROM ranked_a WHERE rk = 1 AND band IN ('CONFIRMED', 'PROBABLE', 'WEAK')),
opened AS (SELECT report_id, metric FROM dec WHERE decided = 3),
scope0 AS (SELECT o.report_id, o.metric, r."table" FROM opened o, resolved r
           UNION SELECT t.report_id, t.metric, t."table" FROM t2e t JOIN opened o USING (report_id, metric)
                 WHERE NOT t.ok AND t.err <= 0.6),
scope AS (FROM scope0 UNION SELECT s.report_id, s.metric, h.other FROM scope0 s
          JOIN (VALUES ('lineitem', 'orders'), ('orders', 'lineitem')) h("table", other) USING ("table")),
cand3a AS (
  SELECT f.report_id, f.metric, f."table", f.key, 3 AS tier, 'filter' AS kind, 'SUM' AS agg, f.measure AS c1,
         CAST(NULL AS VARCHAR) AS c2, CAST(NULL AS VARCHAR) AS op, f.fcol, f.op AS fop, f.fvalue AS fval,
         CAST(NULL AS VARCHAR) AS t2, coalesce(c.sim, 0.0) AS sim
  FROM (SELECT fh.*, fhe.key, fhe.ok FROM fh JOIN fhe ON fhe.report_id = fh.report_id AND fhe.metric = fh.metric
          AND fhe.key = upper('SUM(' || fh."table" || '.' || fh.measure || ') WHERE ' || fh.fcol || fh.op || '''' || fh.fvalue || '''')) f
  JOIN scope s USING (report_id, metric, "table")
  LEFT JOIN csim c ON c.metric = f.metric AND c."table" = f."table" AND c."column" = f.measure WHERE f.ok
  UNION ALL
  SELECT p.report_id, p.metric, p."table", pe.key, 3, 'pair', 'SUM', p.c1, p.c2, p.op, NULL, NULL, NULL, p."table",
         greatest(coalesce(x.sim, 0.0), coalesce(y.sim, 0.0))
  FROM pairs p JOIN pe ON pe.report_id = p.report_id AND pe.metric = p.metric
    AND pe.key = upper('SUM(' || p."table" || '.' || p.c1 || ') ' || p.op || ' SUM(' || p."table" || '.' || p.c2 || ')')
  JOIN scope s ON s.report_id = p.report_id AND s.metric = p.metric AND s."table" = p."table"
  LEFT JOIN csim x ON x.metric = p.metric AND x."table" = p."table" AND x."column" = p.c1
  LEFT JOIN csim y ON y.metric = p.metric AND y."table" = p."table" AND y."column" = p.c2
  WHERE pe.ok
  UNION ALL
  SELECT s.report_id, s.metric, s."table", s.key, 3, CASE WHEN s.op IS NULL THEN 'plain' ELSE 'pair' END, s.agg, s.c1, s.c2, s.op,
         NULL, NULL, NULL, s.t2, s.sim
  FROM seede s JOIN opened o USING (report_id, metric) WHERE s.ok AND s.tier = 3),
cand3 AS (SELECT * FROM cand3a QUALIFY row_number() OVER (PARTITION BY report_id, metric, key ORDER BY sim DESC) = 1)"""

BEST_SQL = """
allranked AS (SELECT * FROM ranked_a UNION ALL SELECT * FROM ranked_b),
best AS (SELECT * FROM allranked WHERE rk = 1 AND band IN ('CONFIRMED', 'PROBABLE', 'WEAK')),
misses AS (
  SELECT report_id, metric, key, err FROM seede WHERE tier = 1 AND NOT ok AND err IS NOT NULL
  UNION ALL SELECT t.report_id, t.metric, t.key, t.err FROM t2e t JOIN dec d USING (report_id, metric)
            WHERE d.decided >= 2 AND NOT t.ok AND t.err IS NOT NULL
  UNION ALL SELECT s.report_id, s.metric, s.key, s.err FROM seede s JOIN opened o USING (report_id, metric)
            WHERE s.tier = 3 AND NOT s.ok AND s.err IS NOT NULL
  UNION ALL SELECT f.report_id, f.metric, f.key, f.err FROM fhe f JOIN scope s USING (report_id, metric, "table")
            JOIN opened o USING (report_id, metric) WHERE NOT f.ok AND f.err IS NOT NULL
  UNION ALL SELECT p.report_id, p.metric, p.key, p.err FROM pe p JOIN scope s USING (report_id, metric, "table")
            JOIN opened o USING (report_id, metric) WHERE NOT p.ok AND p.err IS NOT NULL),
near AS (SELECT report_id, metric, key AS near_key, err AS near_err FROM misses
         QUALIFY row_number() OVER (PARTITION BY report_id, metric ORDER BY err, key) = 1)"""
