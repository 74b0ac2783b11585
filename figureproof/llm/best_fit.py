"""Conflict-constrained best-fit packing (operator 6).

Documents go into sequences (bins) of ``CAPACITY`` units, largest first. Bins
are kept in order of what is left in them, and each carries a bitmap of the
sources and one of the duplicate clusters inside. A document looks for the
first bin in which it fits, and goes on to its successors until one has neither
its source nor its cluster: the tightest compatible bin. If there is none it
opens a bin. A document longer than a bin is cut; full pieces fill a bin each
and the rest is packed.

Documents are dealt by hash to groups of about ``GROUP_ROWS``, packed each by
itself in bounded memory, so a hot source or cluster is spread over all groups;
a group loses at most its last open bins.

Defined results: a null or empty text has size 0 and one piece; a null source
or cluster conflicts with none; equal sizes go by doc_id (null first), then by
text; rows equal in id, source and text are copies numbered through, packed like
others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a training sequence.
CAPACITY = 2048
GROUP_ROWS = 8192

_OUT = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("size", pa.int64()),
                  ("bin", pa.int64()), ("at", pa.int64()), ("free", pa.int64()), ("source", pa.string()), ("cluster", pa.int64())])
_DDL = ("doc_id bigint, copy bigint, piece bigint, start bigint, size bigint, bin bigint, at bigint, free bigint, source string, cluster bigint")


class Bins:
    """Open bins in order of their residual, with bitmaps of what conflicts."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.free: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, place in it) of an item; ``source`` and ``cluster`` are single bits, or 0 for none."""
        order, sources, clusters = self.order, self.sources, self.clusters
        k = bisect_left(order, (size, -1))
        while k < len(order) and (sources[order[k][1]] & source or clusters[order[k][1]] & cluster):
            k += 1
        if k < len(order):
            residual, b = order.pop(k)
        else:
            residual, b = self.capacity, len(self.free)
            self.free.append(residual)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        self.free[b] = residual - size
        insort(order, (residual - size, b))
        return b, self.capacity - residual


def _bit(known: dict, key) -> int:
    return 0 if key is None else known.setdefault(key, 1 << len(known))


def pack(items: list[dict], capacity: int, group: int) -> list[dict]:
    """Pieces of one group's items, each with its bin."""
    bins, sources, clusters, out = Bins(capacity), {}, {}, []
    rest = []
    for r in items:
        full = (r["size"] - 1) // capacity if r["size"] > capacity else 0
        for p in range(full):
            b, _ = bins.put(capacity, _bit(sources, r["source"]), _bit(clusters, r["cluster"]))
            out.append((r, p, p * capacity, capacity, b, 0))
        rest.append((r["size"] - full * capacity, full, r))
    rest.sort(key=lambda x: (-x[0], x[2]["doc_id"] is not None, x[2]["doc_id"] or 0, x[2]["cluster"] or 0,
                             x[2]["source"] or "", x[2]["copy"]))
    for size, p, r in rest:
        b, at = bins.put(size, _bit(sources, r["source"]), _bit(clusters, r["cluster"]))
        out.append((r, p, p * capacity, size, b, at))
    return [{"doc_id": r["doc_id"], "copy": r["copy"], "piece": p, "start": s, "size": n, "bin": group << 32 | b, "at": at,
             "free": bins.free[b], "source": r["source"], "cluster": r["cluster"]} for r, p, s, n, b, at in out]


def _pack_groups(batches, capacity: int):
    now, items = None, []

    def packed():
        got = pack(items, capacity, now)
        for k in range(0, len(got), 1 << 15):
            yield pa.RecordBatch.from_pylist(got[k:k + (1 << 15)], schema=_OUT)

    for b in batches:
        for r in b.to_pylist():
            if r["grp"] != now:
                if items:
                    yield from packed()
                now, items = r["grp"], []
            items.append(r)
    if items:
        yield from packed()


def words(text_col: str):
    """Words by white space: the size that stands for tokens where none are counted."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\S+")), F.lit(0)).cast("long")


def best_fit(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, *, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source", size=None, cluster=None) -> DataFrame:
    """One row per piece: doc_id, copy, piece, start and size (units of the text), bin, at (place in it), free, source, cluster.

    ``size`` and ``cluster`` are columns; by default words and the hash of the text (equal texts are a cluster).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       (words(text_col) if size is None else size).cast("long").alias("size"),
                       (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if cluster is None else cluster).cast("long").alias("cluster"))
    rows = rows.groupBy("doc_id", "source", "size", "cluster").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("doc_id", "source", "size", "cluster", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    groups = -(-docs.count() // group_rows) or 1
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(groups)))
    return (dealt.repartition("grp").sortWithinPartitions("grp")
            .mapInArrow(lambda it: _pack_groups(it, capacity), _DDL))
