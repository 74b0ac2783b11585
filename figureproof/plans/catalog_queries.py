"""Registered catalog queries: profile, keys, roles, join edges, snapshots
(S1-S4, A11, A12, F1, F2, J2, J10) and their DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources import snapshots as SN
from ..sources.tables import DRIVER_TABLES, read_table, read_tables


def _profiles(spark, sf_dir, names, exact=True):
    tabs = read_tables(spark, sf_dir, names)
    return reduce(DataFrame.unionByName, [P.profile(df, t, exact=exact) for t, df in tabs.items()])


def _with_roles(spark, sf_dir, prof, names):
    cat = P.column_catalog(spark, read_tables(spark, sf_dir, names))
    return (prof.join(cat.select("table", "column", "kind"), ["table", "column"])
                .withColumn("role", P.role(F.col("column"), F.col("kind"))))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    # exact distinct counts: one pass per table plus a distinct shuffle of hashes
    prof = _with_roles(spark, sf_dir, _profiles(spark, sf_dir, DRIVER_TABLES), DRIVER_TABLES)
    return prof.select("table", "column", F.col("ordinal").cast("bigint").alias("ordinal"),
                       F.col("n_rows").cast("bigint").alias("n_rows"),
                       F.col("non_null").cast("bigint").alias("non_null"),
                       F.col("ndv").cast("bigint").alias("ndv"),
                       F.round("min_num", 4).alias("min_num"), F.round("max_num", 4).alias("max_num"),
                       "min_str", "max_str", "kind", "role")


def approx_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 with sketches: one plain aggregate per table. Set against the exact
    counts, every distinct count must be within 5 %."""
    tabs = read_tables(spark, sf_dir)
    approx = _profiles(spark, sf_dir, DRIVER_TABLES, exact=False)
    exact = reduce(DataFrame.unionByName, [P.exact_ndv(df, t) for t, df in tabs.items()]).withColumnRenamed("ndv", "exact")
    near = F.abs(F.col("ndv") - F.col("exact")) <= 0.05 * F.col("exact")
    return (approx.join(exact, ["table", "column"], "left")
            .select("table", "column", F.col("n_rows").cast("bigint").alias("n_rows"), F.col("non_null").cast("bigint").alias("non_null"),
                    F.col("exact").cast("bigint").alias("exact_ndv"),
                    F.when(F.col("exact").isNull(), F.coalesce("ndv", F.lit(0)) == 0).otherwise(near).alias("within_5_percent")))


def key_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only ``*_id`` columns can qualify, so only they are profiled
    (the exact distinct count is the expensive part at scale)."""
    tabs = read_tables(spark, sf_dir)
    parts = []
    for t, df in tabs.items():
        ids = [f.name for f in df.schema.fields if f.name.lower().endswith("_id")]
        if ids:
            parts.append(P.profile(df.select(*ids), t, exact=True))
    prof = reduce(DataFrame.unionByName, parts)
    return P.key_candidates(prof).select(
        "table", "column", F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("ndv").cast("bigint").alias("ndv"))


def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 over every column of every driver table, with its non-null count
    (one profiling pass per table)."""
    tabs = read_tables(spark, sf_dir)
    counts = reduce(DataFrame.unionByName, [
        df.agg(*[F.count(F.col(f.name)).alias(f.name) for f in df.schema.fields])
          .select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"),
                                               F.col(f.name).cast("bigint").alias("non_null"))
                                      for f in df.schema.fields])).alias("s"))
          .select(F.lit(t).alias("table"), "s.*")
        for t, df in tabs.items()])
    cat = P.column_catalog(spark, tabs)
    return (cat.join(counts, ["table", "column"])
               .select("table", "column", "kind", P.role(F.col("column"), F.col("kind")).alias("role"),
                       "non_null"))


def join_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 with the prefix-stripping option, and the J1 guard computed from
    the data: is the target column unique (a safe one-hop join)?"""
    tabs = read_tables(spark, sf_dir)
    cat = P.column_catalog(spark, tabs)
    edges = P.join_edges(cat, strip_prefix=True)
    # uniqueness is checked only for edge targets (catalog-sized list): an
    # exact distinct count of every column would shuffle every value at scale
    targets: dict[str, list[str]] = {}
    for r in edges.select("t2", "c2").distinct().collect():
        targets.setdefault(r["t2"], []).append(r["c2"])
    uniq = reduce(DataFrame.unionByName, [
        tabs[t].agg(*[F.when(F.count(F.lit(1)) == F.countDistinct(F.col(c)), True).otherwise(False).alias(c)
                      for c in sorted(cs)])
               .select(F.explode(F.array(*[F.struct(F.lit(c).alias("c2"), F.col(c).alias("unique_target"))
                                           for c in sorted(cs)])).alias("s"))
               .select(F.lit(t).alias("t2"), "s.*")
        for t, cs in sorted(targets.items())])
    return edges.join(uniq, ["t2", "c2"]).select("t1", "c1", "t2", "c2", "name", "unique_target")


def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter snapshot registry of orders and lineitem, and
    the binding of requested dates (every order date of the history, shifted
    by 0, 2 and 5 days) to the last snapshot within 3 days."""
    o = read_table(spark, sf_dir, "orders")
    li = read_table(spark, sf_dir, "lineitem")
    reg = SN.registry(o, "orders", "o_orderdate").unionByName(SN.registry(li, "lineitem", "l_shipdate"))
    req = (o.select(F.to_date("o_orderdate").alias("d")).distinct()
             .select(F.explode(F.array(F.date_add("d", 0), F.date_add("d", 2), F.date_add("d", 5))).alias("as_of"))
             .distinct())
    req = req.select(F.explode(F.array(F.lit("orders"), F.lit("lineitem"))).alias("table"), "as_of")
    return SN.resolve(req, reg).select(
        "table", "requested", "snap_as_of", F.col("seq").cast("bigint").alias("seq"), "error")


# Fixed values of the written snapshots: every so many quarters one is restated, committed last, dated a day earlier.
RESTATED_EVERY = 4


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2/S3 on a table written by ``as_of`` with a commit log whose order differs from the dates: the quarter
    snapshots of ``orders`` in date order, then restated ones (without cancelled rows) for every fourth quarter, dated
    the day before. A request for each quarter end and each date two days later reads the last commit within
    three days; what it reads is counted and summed."""
    import os
    import uuid
    from ..session import checkpoint_dir
    o = read_table(spark, sf_dir, "orders").withColumn("as_of", SN.quarter_end("o_orderdate"))
    first = SN.registry(read_table(spark, sf_dir, "orders"), "orders", "o_orderdate")
    late = first.where(F.col("seq") % RESTATED_EVERY == 0).select(F.col("as_of").alias("quarter"))
    folder = os.path.join(checkpoint_dir(spark), "figureproof", "orders-by-date-" + uuid.uuid4().hex)
    SN.commit(o, folder)
    SN.commit(o.join(late, F.col("as_of") == F.col("quarter")).where("o_orderstatus <> 'P'").drop("quarter").withColumn("as_of", F.date_sub("as_of", 1)), folder)
    n = first.agg(F.max("seq")).first()[0] or 0
    log = first.select("table", "snapshot_id", "as_of", "seq").unionByName(
        first.where(F.col("seq") % RESTATED_EVERY == 0).select(
            "table", F.xxhash64("snapshot_id").alias("snapshot_id"), F.date_sub("as_of", 1).alias("as_of"), (F.col("seq") + n).alias("seq")))
    asked = first.select("table", F.explode(F.array("as_of", F.date_add("as_of", 2))).alias("as_of"))
    rows = SN.read_as_of(spark.read.parquet(folder), asked, log, "orders")
    return rows.groupBy("requested", "as_of").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.round(F.sum(F.col("o_totalprice").cast("decimal(20,4)")).cast("double"), 2).alias("total"))


def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five different values of every column, in the order of their places; long texts are shown by their first 80 characters."""
    parts = [P.samples(df, t) for t, df in read_tables(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts).select(
        "table", "column", F.array_join(F.transform("samples", lambda v: F.left(v, F.lit(80))), " | ").alias("samples"))


# ----------------------------------------------------------------------- oracle

def oracle_samples(sf_dir: str) -> str:
    import pyarrow as pa
    import pyarrow.parquet as pq
    parts = []
    for t in DRIVER_TABLES:
        for f in pq.read_schema(f"{sf_dir}/{t}.parquet"):
            if pa.types.is_nested(f.type):
                continue
            c = f'"{f.name}"'
            text = (f"CAST(CAST({c} AS DECIMAL(24,4)) AS VARCHAR)" if pa.types.is_floating(f.type) else
                    f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if pa.types.is_timestamp(f.type) else f"CAST({c} AS VARCHAR)")
            parts.append(f"""SELECT '{t}' AS "table", '{f.name}' AS "column", string_agg(left(v, 80), ' | ' ORDER BY h, v) AS samples FROM (
  SELECT v, CAST('0x' || substr(md5(v), 1, 15) AS BIGINT) AS h FROM (SELECT DISTINCT {text} AS v FROM {t} WHERE {c} IS NOT NULL) ORDER BY h, v LIMIT 5)
HAVING count(*) > 0""")
    return " UNION ALL ".join(parts)


SNAPSHOT_ROWS_SQL = f"""
WITH q AS (SELECT CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS d, o_orderstatus, o_totalprice FROM orders),
n AS (SELECT d, row_number() OVER (ORDER BY d) AS seq FROM (SELECT DISTINCT d FROM q)),
lg AS (SELECT d AS as_of, d, seq, FALSE AS late FROM n UNION ALL SELECT d - 1, d, seq + (SELECT max(seq) FROM n), TRUE FROM n WHERE seq % {RESTATED_EVERY} = 0),
rq AS (SELECT d AS requested FROM n UNION SELECT d + 2 FROM n),
bd AS (SELECT requested, as_of, d, late FROM rq JOIN lg ON abs(datediff('day', requested, as_of)) <= 3
       QUALIFY row_number() OVER (PARTITION BY requested ORDER BY seq DESC) = 1)
SELECT CAST(requested AS DATE) AS requested, CAST(as_of AS DATE) AS as_of, CAST(count(*) AS BIGINT) AS n_rows,
       round(CAST(sum(CAST(o_totalprice AS DECIMAL(20,4))) AS DOUBLE), 2) AS total
FROM bd JOIN q USING (d) WHERE NOT late OR o_orderstatus <> 'P' GROUP BY ALL"""


def parquet_schema(sf_dir: str) -> dict[str, list[tuple[str, str]]]:
    """table -> [(column, kind)] read from the Parquet footers (no data)."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    def kind(t):
        if pa.types.is_boolean(t):
            return "boolean"
        if pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_decimal(t):
            return "number"
        if pa.types.is_timestamp(t) or pa.types.is_date(t) or pa.types.is_duration(t):
            return "time"
        return "string"
    out = {}
    for t in DRIVER_TABLES:
        sch = pq.read_schema(f"{sf_dir}/{t}.parquet")
        out[t] = [(f.name, kind(f.type)) for f in sch]
    return out


def oracle(tables_schema: dict[str, list[tuple[str, str]]]) -> dict[str, str]:
    """DuckDB SQL. ``tables_schema``: table -> [(column, kind)] in schema order."""
    def role_sql(col, kind):
        c = f"lower('{col}')"

        def ends(sufs):
            return "(" + " OR ".join(f"ends_with({c}, '{x}')" for x in sufs) + ")"

        def starts(ps):
            return "(" + " OR ".join(f"starts_with({c}, '{x}')" for x in ps) + ")"
        k = f"'{kind}'"
        return (f"CASE WHEN {k} = 'boolean' THEN 'flag' WHEN {ends(P.ID_SUFFIXES)} THEN 'identifier' "
                f"WHEN {ends(P.FLAG_SUFFIXES)} THEN 'flag' WHEN {starts(P.FLAG_PREFIXES)} THEN 'flag' "
                f"WHEN {ends(P.MEASURE_SUFFIXES)} AND {k} = 'number' THEN 'measure_input' "
                f"WHEN {ends(P.TIME_SUFFIXES)} OR {k} = 'time' THEN 'dimension' "
                f"WHEN {k} = 'number' THEN 'measure_input' WHEN {k} = 'string' THEN 'dimension' "
                f"ELSE 'unknown' END")

    def prof_sql(tables):
        parts = []
        for t in tables:
            for i, (c, kind) in enumerate(tables_schema[t]):
                num = kind == "number"
                txt = kind == "string" and c != "embedding"
                parts.append(
                    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CAST({i} AS BIGINT) AS ordinal, "
                    f"CAST(count(*) AS BIGINT) AS n_rows, CAST(count({c}) AS BIGINT) AS non_null, "
                    f"{'CAST(NULL AS BIGINT)' if c == 'embedding' else f'CAST(count(DISTINCT {c}) AS BIGINT)'} AS ndv, "
                    f"{f'round(CAST(min({c}) AS DOUBLE), 4)' if num else 'CAST(NULL AS DOUBLE)'} AS min_num, "
                    f"{f'round(CAST(max({c}) AS DOUBLE), 4)' if num else 'CAST(NULL AS DOUBLE)'} AS max_num, "
                    f"{f'min({c})' if txt else 'CAST(NULL AS VARCHAR)'} AS min_str, "
                    f"{f'max({c})' if txt else 'CAST(NULL AS VARCHAR)'} AS max_str, "
                    f"'{kind}' AS kind, {role_sql(c, kind)} AS role FROM {t}")
        return " UNION ALL ".join(parts)

    out = {}
    out["column_profile"] = prof_sql(DRIVER_TABLES)
    out["approx_profile"] = " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS n_rows, CAST(count({c}) AS BIGINT) AS non_null, "
        + ("CAST(NULL AS BIGINT)" if c == "embedding" else f"CAST(nullif(count(DISTINCT {c}), 0) AS BIGINT)")
        + f" AS exact_ndv, TRUE AS within_5_percent FROM {t}" for t in DRIVER_TABLES for c, _ in tables_schema[t])
    out["key_heuristic"] = (f"SELECT \"table\", \"column\", n_rows, ndv FROM ({prof_sql(DRIVER_TABLES)}) p "
                            f"WHERE ends_with(lower(\"column\"), '_id') AND ndv >= n_rows AND non_null = n_rows")
    roles = []
    for t, cols in tables_schema.items():
        for c, kind in cols:
            roles.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{kind}' AS kind, "
                         f"{role_sql(c, kind)} AS role, CAST(count({c}) AS BIGINT) AS non_null FROM {t}")
    out["column_roles"] = " UNION ALL ".join(roles)
    cols = []
    uniq = []
    for t, cs in tables_schema.items():
        for c, kind in cs:
            cols.append(f"('{t}', '{c}')")
            if c != "embedding":
                uniq.append(f"SELECT '{t}' AS t2, '{c}' AS c2, count(*) = count(DISTINCT {c}) AS unique_target FROM {t}")
    out["join_edges"] = (
        f"WITH cat AS (SELECT * FROM (VALUES {', '.join(cols)}) v(\"table\", \"column\")), "
        f"nm AS (SELECT \"table\", \"column\", regexp_replace(\"column\", '^[a-z]+_', '') AS name FROM cat), "
        f"u AS ({' UNION ALL '.join(uniq)}) "
        f"SELECT a.\"table\" AS t1, a.\"column\" AS c1, b.\"table\" AS t2, b.\"column\" AS c2, a.name, u.unique_target "
        f"FROM nm a JOIN nm b ON a.name = b.name AND a.\"table\" <> b.\"table\" "
        f"JOIN u ON u.t2 = b.\"table\" AND u.c2 = b.\"column\"")
    qe = "CAST(last_day(date_trunc('quarter', {d}) + INTERVAL 2 MONTH) AS DATE)"
    out["snapshot_as_of"] = f"""
WITH reg AS (
  SELECT 'orders' AS "table", as_of, row_number() OVER (ORDER BY as_of) AS seq
  FROM (SELECT DISTINCT {qe.format(d='o_orderdate')} AS as_of FROM orders)
  UNION ALL
  SELECT 'lineitem', as_of, row_number() OVER (ORDER BY as_of)
  FROM (SELECT DISTINCT {qe.format(d='l_shipdate')} AS as_of FROM lineitem)),
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
req0 AS (SELECT DISTINCT CAST(d + INTERVAL (k) DAY AS DATE) AS as_of FROM d, (VALUES (0), (2), (5)) v(k)),
req AS (SELECT t."table", r.as_of FROM req0 r, (VALUES ('orders'), ('lineitem')) t("table")),
m AS (SELECT r."table", r.as_of AS requested, g.as_of AS snap_as_of, g.seq
      FROM req r JOIN reg g ON g."table" = r."table" AND abs(datediff('day', r.as_of, g.as_of)) <= 3
      QUALIFY row_number() OVER (PARTITION BY r."table", r.as_of ORDER BY g.seq DESC) = 1)
SELECT r."table", r.as_of AS requested, m.snap_as_of, CAST(m.seq AS BIGINT) AS seq,
       CASE WHEN m.seq IS NULL THEN 'no snapshot within window' END AS error
FROM req r LEFT JOIN m ON m."table" = r."table" AND m.requested = r.as_of"""
    return out


# The legacy names the older lineitem snapshot is stored under.
LEGACY_NAMES = {"l_extprice": "l_extendedprice", "l_qty": "l_quantity"}


def schema_rename_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two report quarters of ``lineitem``; the older snapshot is
    stored under legacy column names and without ``l_tax`` (added later). It
    is read under current names and stacked with the newer one
    (``unionByName(allowMissingColumns)``); the sums are then per snapshot."""
    from . import report as R
    _, q1, q2 = R.edition_dates(spark, sf_dir)
    li = R.lineitem_mart(spark, sf_dir, [q1, q2])
    legacy = {v: k for k, v in LEGACY_NAMES.items()}
    old = li.where(F.col("as_of") == F.lit(q1)).drop("l_tax").withColumnsRenamed(legacy)
    new = li.where(F.col("as_of") == F.lit(q2))
    u = SN.rename_union([(old, LEGACY_NAMES), (new, {})])
    return (u.groupBy("as_of").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.round(F.sum(F.col("l_extendedprice").cast("decimal(20,4)")).cast("double"), 2).alias("sum_extendedprice"),
        F.round(F.sum(F.col("l_quantity").cast("decimal(20,4)")).cast("double"), 2).alias("sum_quantity"),
        F.count("l_tax").cast("bigint").alias("tax_non_null")))


def oracle_rename() -> dict[str, str]:
    from . import fingerprint_sql as FS
    return {"schema_rename_union": "WITH " + FS.MARTS_SQL + """
SELECT lm.as_of, CAST(count(*) AS BIGINT) AS n_rows,
       round(CAST(sum(CAST(l_extendedprice AS DECIMAL(20,4))) AS DOUBLE), 2) AS sum_extendedprice,
       round(CAST(sum(CAST(l_quantity AS DECIMAL(20,4))) AS DOUBLE), 2) AS sum_quantity,
       CAST(count(CASE WHEN lm.as_of = eds.q2 THEN l_tax END) AS BIGINT) AS tax_non_null
FROM lm, eds WHERE lm.as_of IN (eds.q1, eds.q2) GROUP BY lm.as_of"""}
