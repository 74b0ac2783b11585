"""DuckDB SQL of the queries of operators 11 to 13, over whole tables."""

# ---- fixed values: the reversed polynomial of crc32
CRC_POLYNOMIAL = 3988292384
# ---- end of fixed values

#: One row, one list: the checksum of each byte by the rule.
_CRC = f"""crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {CRC_POLYNOMIAL}) ELSE c >> 1 END, i)
                    ORDER BY i) AS step FROM (SELECT unnest(range(256)) AS i))"""


def _crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes of a string, with the list ``step`` in scope."""
    return (f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT)),"
            f" lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH RECURSIVE {_CRC},
run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS w
        FROM documents),
cnt AS (SELECT doc, w, count(*) AS c FROM run GROUP BY doc, w),
sum AS (SELECT w, c, {_crc32("doc || ':' || w")} AS h FROM cnt, crc),
txt AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM sum),
voc AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM txt WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
del AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM voc)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM del a JOIN voc b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM del a JOIN voc b ON a.rest = b.word),
top AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
frm AS (SELECT voc.word, voc.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * voc.n THEN other END AS form, CASE WHEN m >= 2 * voc.n THEN m END AS form_n
        FROM voc LEFT JOIN top ON voc.word = top.word AND k = 1),
up AS (SELECT word, word AS at FROM frm UNION ALL SELECT up.word, frm.form FROM up JOIN frm ON up.at = frm.word WHERE frm.form IS NOT NULL)
SELECT frm.word, frm.form, up.at AS root, frm.n, CAST(frm.n_near AS BIGINT) AS n_near, frm.form_n
FROM frm JOIN up ON up.word = frm.word JOIN frm fin ON fin.word = up.at AND fin.form IS NULL"""

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, coalesce(CAST(doc_id AS VARCHAR), 'text ' || text) AS doc, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc) >= 10),
o AS (SELECT rid, count(*) AS n_lines, count(c.key) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '') AS kept
      FROM k LEFT JOIN c ON k.key = c.key GROUP BY rid)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN o USING (rid)"""

OP13_SQL = rf"""
WITH {_CRC},
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT d.*, coalesce({_crc32("CAST(doc_id AS VARCHAR)")}, 1) AS h, len(w) AS n FROM d, crc),
p AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
t AS (SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
             CASE WHEN i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] ELSE w[i + 1] END) ELSE w END AS w FROM p),
x AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
e AS (SELECT x.rid, y.i - x.i AS q, x.i FROM x JOIN x y ON x.rid = y.rid AND x.word = y.word AND x.i < y.i),
g AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS stretch FROM e),
s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY rid, q, stretch HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.rid = s.rid AND z.q < s.q AND z.start <= s.start
                                        AND z.start + z.length >= s.start + s.length)),
b AS (SELECT rid, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q)) AS runs_sha256 FROM r GROUP BY rid),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, q) AS k FROM r) WHERE k = 1),
gone AS (SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM r),
kept AS (SELECT x.rid, string_agg(word, ' ' ORDER BY x.i) AS collapsed FROM x ANTI JOIN gone ON x.rid = gone.rid AND x.i = gone.i GROUP BY x.rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
       CAST(q AS BIGINT) AS period, CAST(1000 * length // q AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256,
       sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (rid) LEFT JOIN m USING (rid) LEFT JOIN kept USING (rid)"""
