"""Dated snapshots of warehouse tables.

A snapshot is the slice of a table that a report dated ``as_of`` was built
from. On a lakehouse the slice is a partition (``as_of`` partition column)
or a table version; on the driver tables it is derived from a business date
(quarter end of the row's date). Either way the read is a partition filter
that Parquet / the catalog prunes, never a full scan plus Python filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a figure binds to a snapshot whose date is within this many
# days of the figure's as-of date.
SNAPSHOT_WINDOW_DAYS = 3


def quarter_end(col: Column | str) -> Column:
    """Quarter-end date of a date/timestamp column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.last_day(F.add_months(F.trunc(c, "quarter"), 2))


def with_snapshot(df: DataFrame, date_col: str, name: str = "as_of") -> DataFrame:
    return df.withColumn(name, quarter_end(date_col))


def commit(rows: DataFrame, folder: str, col: str = "as_of") -> None:
    """Add snapshots to a table laid out by ``as_of``: each date of ``rows`` is a partition folder, replaced as a whole
    if it is there already (dynamic overwrite); the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(col).parquet(folder)


def read_as_of(df: DataFrame, requests: DataFrame, snaps: DataFrame, table: str, col: str = "as_of",
               window_days: int = SNAPSHOT_WINDOW_DAYS) -> DataFrame:
    """The rows that each requested date of ``requests(table, as_of)`` means, with ``requested``.

    The dates are bound to snapshots first; the join with their few dates prunes the partitions of the table
    when it is read (dynamic partition pruning), so only the bound snapshots are scanned.
    """
    bound = resolve(requests.where(F.col("table") == table), snaps, window_days).where("error IS NULL")
    return df.join(bound.select(F.col("snap_as_of").alias(col), "requested"), col)


def registry(df: DataFrame, table: str, date_col: str) -> DataFrame:
    """Snapshot registry ``(table, snapshot_id, as_of, seq, n_rows)``.

    ``seq`` is the commit order. Snapshots of a periodic fact table are
    committed in business-date order, so ``seq`` ranks ``as_of``.
    """
    snaps = (df.select(quarter_end(date_col).alias("as_of"))
               .groupBy("as_of").agg(F.count(F.lit(1)).alias("n_rows")))
    # one row per snapshot (catalog-sized): a global order is cheap
    w = Window.orderBy("as_of")
    return (snaps.withColumn("seq", F.row_number().over(w))
                 .withColumn("table", F.lit(table))
                 .withColumn("snapshot_id", F.xxhash64(F.lit(table), F.col("as_of")))
                 .select("table", "snapshot_id", "as_of", "seq", "n_rows"))


def resolve(requests: DataFrame, snaps: DataFrame,
            window_days: int = SNAPSHOT_WINDOW_DAYS) -> DataFrame:
    """Bind each requested ``(table, as_of)`` to a snapshot.

    A snapshot qualifies when ``|snapshot.as_of - requested| <= window``;
    among qualifying snapshots the last one in commit order wins (not the
    nearest). Requests with no snapshot keep NULL ids and
    ``error = 'no snapshot within window'``.

    Each request probes the dates of its window: an equi-join on (table, date), so no
    request meets the snapshots of other dates.
    """
    r = requests.select("table", F.col("as_of").alias("requested")).distinct()
    s = snaps.select("table", "snapshot_id", F.col("as_of").alias("snap_as_of"), "seq")
    probe = r.withColumn("snap_as_of", F.explode(F.sequence(F.date_sub("requested", window_days), F.date_add("requested", window_days))))
    cand = probe.join(s, ["table", "snap_as_of"])
    w = Window.partitionBy("table", "requested").orderBy(F.col("seq").desc())
    best = (cand.withColumn("rk", F.row_number().over(w)).where("rk = 1")
                .drop("rk"))
    return (r.join(best, on=["table", "requested"], how="left")
              .withColumn("error", F.when(F.col("snapshot_id").isNull(),
                                          F.lit("no snapshot within window")))
              .select("table", "requested", "snapshot_id", "snap_as_of", "seq", "error"))


def rename_union(frames: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Read every snapshot under current column names and stack them.

    ``frames`` holds ``(snapshot_df, {historic_name: current_name})``.
    """
    out = None
    for df, renames in frames:
        cur = df.withColumnsRenamed(renames) if renames else df
        out = cur if out is None else out.unionByName(cur, allowMissingColumns=True)
    return out
