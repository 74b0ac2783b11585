"""DuckDB oracles of the log queries.

They know what the log of each event type means and use none of the mining
patterns: which statements it holds, their literal-free form, and what each
aggregates, filters, groups and joins.
"""

from __future__ import annotations

LOG_CTES = """
WITH f AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u, max(ts) AS t, min(event_id) AS first_id
           FROM events GROUP BY event_type),
e1 AS (SELECT f.*, CAST(e.user_id AS VARCHAR) AS fu, CAST(e.value AS VARCHAR) AS fv, CAST(e.event_id AS VARCHAR) AS fi,
              CAST(CAST(e.ts AS DATE) AS VARCHAR) AS fd
       FROM f JOIN events e ON e.event_id = f.first_id),
stmt AS (
  SELECT event_type, 0 AS pos, 'analytical' AS class, n, u, t, first_id,
         'SELECT E.EVENT_TYPE, SUM(E.VALUE) AS TOTAL FROM EVENTS E WHERE E.USER_ID = ? GROUP BY E.EVENT_TYPE' AS shape,
         'SELECT e.event_type, SUM(e.value) AS total FROM events e WHERE e.user_id = ' || fu || ' GROUP BY e.event_type' AS first_sql,
         'e.user_id = ' || fu AS filt FROM e1 WHERE event_type = 'click'
  UNION ALL SELECT event_type, 0, 'analytical', n, u, t, first_id,
         'SELECT USER_ID, COUNT(*) FROM EVENTS WHERE VALUE > ? GROUP BY USER_ID',
         'SELECT user_id, COUNT(*) FROM events WHERE value > ' || fv || ' GROUP BY user_id', 'value > ' || fv
         FROM e1 WHERE event_type = 'view'
  UNION ALL SELECT event_type, 1, 'analytical', n, u, t, first_id,
         'SELECT Q.USER_ID, SUM(COALESCE(ROUND(Q.VALUE), ?)) FILTER (WHERE Q.EVENT_TYPE <> ?) AS KEPT FROM'
         || ' (SELECT USER_ID, VALUE, EVENT_TYPE FROM "EVENTS" WHERE EVENT_ID > ?) Q GROUP BY Q.USER_ID',
         'SELECT q.user_id, SUM(COALESCE(ROUND(q.value), 0)) FILTER (WHERE q.event_type <> ''limit 3'') AS kept' || chr(10)
         || 'FROM (SELECT user_id, value, event_type FROM "events" WHERE event_id > ' || fi || ') q GROUP BY q.user_id', NULL
         FROM e1 WHERE event_type = 'view'
  UNION ALL SELECT event_type, 0, 'analytical', n, u, t, first_id,
         'SELECT C.C_MKTSEGMENT, AVG(O.O_TOTALPRICE), COUNT(DISTINCT O.O_CUSTKEY) FROM ORDERS O JOIN CUSTOMER C'
         || ' ON O.O_CUSTKEY = C.C_CUSTKEY WHERE O.O_ORDERSTATUS = ? AND O.O_TOTALPRICE > ? GROUP BY C.C_MKTSEGMENT',
         'SELECT c.c_mktsegment, AVG(o.o_totalprice), COUNT(DISTINCT o.o_custkey) FROM orders o JOIN customer c'
         || ' ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = ''F'' AND o.o_totalprice > ' || fv || ' GROUP BY c.c_mktsegment',
         'o.o_orderstatus = ''F'' AND o.o_totalprice > ' || fv FROM e1 WHERE event_type = 'purchase'
  UNION ALL SELECT event_type, 0, 'structural', n, u, t, first_id, 'INSERT INTO EVENTS VALUES (?, ?, ?, ?, ?)',
         'INSERT INTO events VALUES (' || fi || ', ''' || fd || ''', ' || fu || ', ''signup'', ' || fv || ')', NULL
         FROM e1 WHERE event_type = 'signup'
  UNION ALL SELECT event_type, 1, 'analytical', n, u, t, first_id,
         'SELECT COUNT(*) FROM EVENTS WHERE EVENT_TYPE = ? AND USER_ID = ?',
         'SELECT COUNT(*) FROM events WHERE event_type = ''signup'' AND user_id = ' || fu,
         'event_type = ''signup'' AND user_id = ' || fu FROM e1 WHERE event_type = 'signup'
  UNION ALL SELECT event_type, 0, 'noise', n, u, t, first_id, 'SELECT * FROM EVENTS WHERE EVENT_ID = ?',
         'SELECT * FROM events WHERE event_id = ' || fi, NULL FROM e1 WHERE event_type = 'error'),
call AS (SELECT * FROM (VALUES
  ('click', 0, 'events', 'value', 'SUM', FALSE, FALSE), ('view', 0, 'events', '*', 'COUNT', FALSE, FALSE),
  ('view', 1, 'events', 'value', 'SUM', FALSE, FALSE),
  ('purchase', 0, 'orders', 'o_totalprice', 'AVG', FALSE, TRUE), ('purchase', 0, 'orders', 'o_custkey', 'COUNT_DISTINCT', TRUE, TRUE),
  ('signup', 1, 'events', '*', 'COUNT', FALSE, FALSE)) v(event_type, pos, "table", "column", agg, is_distinct, is_complex)),
used AS (SELECT c.*, s.n, s.u, s.t, s.first_id, s.filt FROM call c JOIN stmt s USING (event_type, pos)),
dim AS (SELECT * FROM (VALUES
  ('click', 'events', 'event_type'), ('click', 'events', 'user_id'), ('view', 'events', 'user_id'), ('view', 'events', 'value'),
  ('view', 'events', 'user_id'), ('view', 'events', 'event_type'), ('view', 'events', 'event_id'),
  ('purchase', 'customer', 'c_mktsegment'), ('purchase', 'orders', 'o_orderstatus'), ('purchase', 'orders', 'o_totalprice'),
  ('signup', 'events', 'event_type'), ('signup', 'events', 'user_id')) v(event_type, "table", "column"))"""


def log_queries() -> dict[str, str]:
    return {
        "query_shapes": LOG_CTES + """
SELECT sha256(shape) AS shape_hash, CAST(n AS BIGINT) AS execution_count, CAST(u AS BIGINT) AS distinct_users,
       t AS last_executed_at, first_sql, class FROM stmt""",
        "log_aggregates": LOG_CTES + """
SELECT "table", "column", agg, is_distinct, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(n) AS BIGINT) AS statements,
       CAST(sum(u) AS BIGINT) AS users FROM used GROUP BY ALL""",
        "log_dimensions": LOG_CTES + """
SELECT "table", "column", FALSE AS is_time, CAST(count(*) AS BIGINT) AS shapes, CAST(sum(n) AS BIGINT) AS statements,
       CAST(sum(u) AS BIGINT) AS users FROM dim JOIN f USING (event_type) GROUP BY ALL""",
        "log_joins": LOG_CTES + """
SELECT 'orders' AS from_table, 'o_custkey' AS from_column, 'customer' AS to_table, 'c_custkey' AS to_column,
       'INNER' AS join_type, CAST(n AS BIGINT) AS statements, CAST(1 AS BIGINT) AS shapes FROM f WHERE event_type = 'purchase'""",
        "signal_dedup_stream": LOG_CTES + "\nSELECT sha256(shape) AS shape_hash, class FROM stmt",
        "usage_window_stream": LOG_CTES + """
SELECT date_trunc('hour', e.ts) AS window_start, sha256(s.shape) AS shape_hash, CAST(count(*) AS BIGINT) AS executions
FROM events e JOIN stmt s USING (event_type) GROUP BY ALL"""}


def evidence_ctes(schema, roles_sql: str, cell_sql: str, bi_sql: str) -> str:
    cols = ", ".join(f"('{t.lower()}', '{c.lower()}')" for t, cs in schema.items() for c, _ in cs)
    return LOG_CTES + f""",
rl AS ({roles_sql}),
cells_ev AS ({cell_sql}),
bi_ev AS ({bi_sql}),
catalog AS (SELECT * FROM (VALUES {cols}) v("table", "column")),
doc0 AS (SELECT resolved_expression AS x, source_type AS source FROM cells_ev WHERE resolved_expression IS NOT NULL AND NOT ambiguous
         UNION SELECT sql, 'tableau_calc' FROM bi_ev WHERE sql IS NOT NULL),
doc1 AS (SELECT source, upper(trim(split_part(x, '(', 1))) AS fn, lower(trim(split_part(split_part(x, '(', 2), ')', 1))) AS arg
         FROM doc0 WHERE length(x) - length(replace(x, '(', '')) = 1 AND x LIKE '%)'),
doc2 AS (SELECT source, CASE WHEN fn = 'COUNT' AND arg LIKE 'distinct %' THEN 'COUNT_DISTINCT' ELSE fn END AS agg,
                CASE WHEN arg LIKE 'distinct %' THEN trim(substr(arg, 10)) ELSE arg END AS "column" FROM doc1),
ev AS (
  SELECT "table", "column", agg, CASE WHEN is_complex THEN 'query_log_complex' ELSE 'query_log_simple' END AS source,
         n, u, t, first_id, pos, filt FROM used
  UNION ALL
  SELECT lower("table"), lower("column"), 'SUM', 'ddl_naming_convention', 0, 0, NULL, NULL, NULL, NULL
  FROM rl WHERE role = 'measure_input'
  UNION ALL
  SELECT DISTINCT c."table", c."column", d.agg, d.source, 0, 0, CAST(NULL AS TIMESTAMP), NULL, NULL, NULL
  FROM doc2 d JOIN catalog c USING ("column")),
b AS (SELECT "table", "column", agg, CAST(sum(n) AS BIGINT) AS executions, CAST(sum(u) AS BIGINT) AS users,
             max(t) AS last_seen, list_sort(list_distinct(list(source))) AS sources,
             coalesce(string_agg(coalesce(filt, '-'), '; ' ORDER BY first_id, pos) FILTER (WHERE n > 0), '') AS filters
      FROM ev GROUP BY ALL)"""


# the fixed authority of the sources in this fixture
AUTHORITY = """WHEN 'query_log_complex' THEN 0.60 WHEN 'query_log_simple' THEN 0.40 WHEN 'ddl_naming_convention' THEN 0.45
              WHEN 'excel_formula' THEN 0.50 WHEN 'tableau_calc' THEN 0.85"""
