"""DuckDB form of the name similarity, for the oracles.

All pairs are compared. Words come from unnested rows, the sequence ratio from a
recursive CTE that splits a pair of strings at its longest common block; nothing
is shared with the Spark expressions but the fixed word lists.
"""

from __future__ import annotations

from ..functions import naming as NM


def similarity_ctes(p: str, names: str, idents: str) -> str:
    """CTEs ``{p}_f1`` (name, ident, shared, f1) and ``{p}_sim`` (name, ident, sim)
    for the queries ``names(name)`` and ``idents(ident, description)``."""
    ab = ", ".join(f"('{k}', '{v}')" for k, v in NM.ABBREVIATIONS.items())
    stop = ", ".join(f"'{w}'" for w in NM.STOPWORDS)
    noise = ", ".join(f"'{w}'" for w in NM.NOISE_TOKENS)
    toks = "unnest(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda x: x <> ''))"
    return f""",
{p}_ab AS (SELECT * FROM (VALUES {ab}) v(tok, expansion)),
{p}_n AS (SELECT DISTINCT name FROM ({names})),
{p}_i AS (SELECT DISTINCT ident, description FROM ({idents})),
{p}_nt AS (SELECT DISTINCT name, {toks.format(x='name')} AS tok FROM {p}_n),
{p}_nw AS (SELECT DISTINCT name, w FROM (SELECT name, tok AS w FROM {p}_nt
           UNION SELECT name, unnest(string_split(a.expansion, ' ')) FROM {p}_nt JOIN {p}_ab a USING (tok)) WHERE w NOT IN ({stop})),
{p}_it AS (SELECT * FROM (SELECT DISTINCT ident, {toks.format(x='ident')} AS tok FROM {p}_i) WHERE tok NOT IN ({noise})),
{p}_iw AS (SELECT DISTINCT ident, w FROM (SELECT ident, tok AS w FROM {p}_it
           UNION SELECT ident, unnest(string_split(a.expansion, ' ')) FROM {p}_it JOIN {p}_ab a USING (tok)) WHERE w NOT IN ({stop})),
{p}_dw AS (SELECT * FROM (SELECT DISTINCT ident, {toks.format(x="coalesce(description, '')")} AS w FROM {p}_i) WHERE w NOT IN ({stop})),
{p}_nj AS (SELECT name, string_agg(w, ' ' ORDER BY w) AS a, count(*) AS n FROM {p}_nw GROUP BY name),
{p}_ij AS (SELECT ident, string_agg(w, ' ' ORDER BY w) AS b, count(*) AS n FROM {p}_iw GROUP BY ident),
{p}_met AS (SELECT name, ident FROM {p}_nj, {p}_ij),
{p}_prs AS (SELECT DISTINCT a, b FROM {p}_met JOIN {p}_nj USING (name) JOIN {p}_ij USING (ident)),
{p}_seg(a, b, alo, ahi, blo, bhi, k) AS (
  SELECT a, b, 0, length(a), 0, length(b), 0 FROM {p}_prs
  UNION ALL
  SELECT a, b, x.alo, x.ahi, x.blo, x.bhi, x.k FROM (
    SELECT a, b, unnest([{{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j, 'k': 0}}, {{'alo': i + k2, 'ahi': ahi, 'blo': j + k2, 'bhi': bhi, 'k': 0}},
                         {{'alo': 0, 'ahi': 0, 'blo': 0, 'bhi': 0, 'k': k2}}]) AS x FROM (
      SELECT *, CAST(coalesce(list_position(list_transform(range(least(ahi - i, bhi - j)),
                 lambda x: substr(a, CAST(i + x + 1 AS INT), 1) = substr(b, CAST(j + x + 1 AS INT), 1)), FALSE) - 1, least(ahi - i, bhi - j)) AS INT) AS k2
      FROM (SELECT s.*, CAST(j AS INT) AS j FROM (SELECT s.*, CAST(unnest(range(alo, ahi)) AS INT) AS i FROM {p}_seg s) s,
            LATERAL (SELECT unnest(range(s.blo, s.bhi)) AS j))
      QUALIFY row_number() OVER (PARTITION BY a, b, alo, ahi, blo, bhi ORDER BY k2 DESC, i, j) = 1)
    WHERE k2 > 0)
  WHERE x.k > 0 OR (x.alo < x.ahi AND x.blo < x.bhi)),
{p}_ratio AS (SELECT a, b, 2.0 * sum(k) / (length(a) + length(b)) AS ratio FROM {p}_seg GROUP BY a, b),
{p}_dn AS (SELECT ident, count(*) AS n FROM {p}_dw GROUP BY ident),
{p}_sh AS (SELECT name, ident, count(*) AS shared FROM {p}_nw JOIN {p}_iw USING (w) GROUP BY ALL),
{p}_ds AS (SELECT name, ident, count(*) AS shared FROM {p}_nw JOIN {p}_dw USING (w) GROUP BY ALL),
{p}_f1 AS (SELECT m.name, m.ident, coalesce(s.shared, 0) AS shared, 2.0 * coalesce(s.shared, 0) / (nj.n + ij.n) AS f1,
                  2.0 * coalesce(d.shared, 0) / (nj.n + coalesce(dn.n, 0)) AS df1, nj.a, ij.b
           FROM {p}_met m JOIN {p}_nj nj USING (name) JOIN {p}_ij ij USING (ident) LEFT JOIN {p}_sh s USING (name, ident)
           LEFT JOIN {p}_ds d USING (name, ident) LEFT JOIN {p}_dn dn USING (ident)),
{p}_sim AS (SELECT f.name, f.ident, greatest(f.f1, 0.8 * coalesce(r.ratio, 0.0), f.df1) AS sim FROM {p}_f1 f LEFT JOIN {p}_ratio r USING (a, b))"""
