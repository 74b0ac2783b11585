"""Balanced label propagation of documents to shards (operator 7), in DataFrame functions only.

Law ``rows``: the shards' row counts differ by at most one. Documents with equal
texts are linked. Every linked document starts in a shard by hash; in each round
it wants to go where most of the documents linked with it are. Documents of one
group and shard are alike, so the state is one row per (group, shard) with a
count, however many copies a group has, and no link is ever written out.

A round joins each group's rows with its home (the largest one that the group
alone does not fill, in every other round the largest one where there is room), sums the wishes by pair of shards, and grants what capacity
allows: as many from a to b as from b to a, plus the room that documents without
links leave, as those go wherever room is left in the end. Wishes are granted in
order of gain by a running sum over buckets. Groups larger than a shard fill
several. The driver sees sums per shard and pair of shards only.

Defined results: null is the empty text for links and crc32, its size is 1; null
and repeated doc_ids are kept, rows equal in id and text are counted once and
given different slots; ties go to the lower shard; an empty table gives no rows;
a table of fewer rows than shards leaves shards empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, spread_rank

SHARDS = 8
LAW = "rows"
MAX_ROUNDS = 16
#: Rows that one task of a running sum orders.
PER_TASK = 200_000


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _at(values: list[int], index):
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)


def _running(df: DataFrame, keys: list[str], amount: str, first: str, by: str, buckets: int) -> DataFrame:
    """``before``: the sum of ``amount`` ahead of each row of its key, ordered by ``first``, then by buckets of the hash of ``by``."""
    df = df.withColumn("__b", F.pmod(F.xxhash64(by), F.lit(buckets)))
    upto = Window.partitionBy(*keys).orderBy(first, "__b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*keys, first, "__b").agg(F.sum(amount).alias("__s"))
    base = base.withColumn("__base", F.coalesce(F.sum("__s").over(upto), F.lit(0))).drop("__s")
    inside = Window.partitionBy(*keys, first, "__b").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("before", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
            .join(base, [*keys, first, "__b"]).withColumn("before", F.col("before") + F.col("__base")).drop("__b", "__base"))


def _grants(wishes: dict, loads: list[int], room_of: list[int]) -> dict:
    """How many documents may go from a to b: exchanges, and what room is left, in proportion."""
    out = {(a, b): min(n, wishes.get((b, a), 0)) for (a, b), n in wishes.items()}
    for b, cap in enumerate(room_of):
        room = max(0, cap - loads[b])
        open_ = {a: n - out[a, t] for (a, t), n in wishes.items() if t == b and n > out[a, t]}
        total = sum(open_.values())
        for a, n in sorted(open_.items()):
            give = min(n, room, n if total <= room else -(-room * n // total))
            total, room = total - n, room - give
            out[a, b] += give
    return out


def propagate(cells: DataFrame, shards: int, room: list[int], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(g, shard, c) -> the same after label propagation under the capacities ``room``."""
    cells, idle = keep(cells, "cells"), 0
    for turn in range(max_rounds):
        loads = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("c").alias("n")).collect()}
        loads = [loads.get(s, 0) for s in range(shards)]
        # in turn: the largest row of the group, where exchanges may open a place; the largest where there is room
        open_ = [cap if turn % 2 == 0 or n < cap else 0 for cap, n in zip(room, loads)]
        by_size = Window.partitionBy("g").orderBy(F.desc("c"), "shard")
        ranked = cells.withColumn("r", F.row_number().over(by_size))
        homes = (ranked.filter(F.col("c") < _at(open_, F.col("shard"))).groupBy(F.col("g").alias("hg"))
                 .agg(F.min(F.struct("r", "shard", "c")).alias("home")))
        wishes = keep(ranked.join(homes, F.col("g") == F.col("hg")).filter(F.col("r") > F.col("home.r"))
                      .select("g", F.col("shard").alias("a"), F.col("home.shard").alias("b"), "c",
                              # a document gains the home's neighbours and loses those it leaves
                              (-F.least(F.lit(15), F.floor(F.log2(F.col("home.c") - F.col("c") + 1)))).cast("int").alias("rank")), "wishes")
        flows = {(r.a, r.b): (r.n, r.k) for r in wishes.groupBy("a", "b").agg(F.sum("c").alias("n"), F.count("*").alias("k")).collect()}
        grants = _grants({p: n for p, (n, _) in flows.items()}, loads, room)
        idle = 0 if any(grants.values()) else idle + 1
        if idle == 2:
            break
        if idle:
            continue
        buckets = 1 + max(k for _, k in flows.values()) // PER_TASK
        limit = F.element_at(F.array(*[F.lit(grants.get((a, b), 0)).cast("long") for a in range(shards) for b in range(shards)]),
                             F.col("a") * shards + F.col("b") + 1)
        moved = (_running(wishes, ["a", "b"], "c", "rank", "g", buckets)
                 .withColumn("n", F.greatest(F.lit(0), F.least("c", limit - F.col("before")))).filter("n > 0"))
        change = moved.select("g", F.explode(F.array(
            F.struct(F.col("a").alias("shard"), (-F.col("n")).alias("c")), F.struct(F.col("b").alias("shard"), F.col("n").alias("c")))).alias("d"))
        cells = keep(cells.unionByName(change.select("g", "d.shard", "d.c")).groupBy("g", "shard")
                     .agg(F.sum("c").alias("c")).filter("c > 0"), "cells")
    return cells


def assign(docs: DataFrame, shards: int = SHARDS, max_rounds: int = MAX_ROUNDS, *, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot (gapless in its shard), grown_shard (null)."""
    raw = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(raw, F.lit(b""))).alias("g"),
                       (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(raw, F.lit(b""))).alias("crc"))
    rows = keep(rows.groupBy("doc_id", "g", "size").agg(F.max("crc").alias("crc"), F.count(F.lit(1)).alias("copies")), "shard-rows")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    room = capacities(total, shards)

    groups = rows.groupBy(F.col("g").alias("lg")).agg(F.sum("copies").alias("members")).filter("members > 1")
    linked = rows.join(groups, F.col("g") == F.col("lg")).drop("lg")
    start = F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int")
    cells = propagate(linked.groupBy("g", start.alias("shard")).agg(F.sum("copies").alias("c")), shards, room, max_rounds)

    # what a shard cannot hold is placed with the documents without links
    most = cells.groupBy("shard").agg(F.count("*").alias("k"), F.sum("c").alias("n")).collect()
    buckets = 1 + max([r.k for r in most], default=0) // PER_TASK
    held = (_running(cells.withColumn("one", F.lit(0)), ["shard"], "c", "one", "g", buckets)
            .withColumn("n", F.greatest(F.lit(0), F.least("c", _at(room, F.col("shard")) - F.col("before")))).filter("n > 0"))
    left = [cap - min(cap, {r.shard: r.n for r in most}.get(s, 0)) for s, cap in enumerate(room)]
    by_shard = Window.partitionBy("g").orderBy("shard")
    marks = (held.select("g", "shard", "n", F.sum("n").over(by_shard).alias("stop"))
             .groupBy(F.col("g").alias("mg")).agg(F.collect_list(F.struct((F.col("stop") - F.col("n")).alias("from"), "stop", "shard")).alias("marks")))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    members = spread_rank(linked.select("doc_id", "g", "size", "crc", each), ["g"], ["doc_id", "copy"], "r")
    members = (members.join(marks, F.col("g") == F.col("mg"), "left")
               .withColumn("shard", F.try_element_at(F.filter("marks", lambda m: (F.col("r") >= m["from"]) & (F.col("r") < m["stop"])), F.lit(1))["shard"])
               .select("doc_id", "g", "size", "crc", "copy", "shard"))
    members = keep(members, "shard-members")
    alone = (rows.join(groups, F.col("g") == F.col("lg"), "left_anti").select("doc_id", "g", "size", "crc", each))
    free = alone.unionByName(members.filter("shard is null").drop("shard")).withColumn("one", F.lit(0))
    placed = spread_rank(free, ["one"], ["doc_id", "g", "copy"], "r")
    shard, upto = F.lit(0), 0
    for n in left[:-1]:
        upto += n
        shard = shard + F.when(F.col("r") >= upto, 1).otherwise(0)
    everything = members.filter("shard is not null").unionByName(placed.withColumn("shard", shard.cast("int")).drop("r", "one"))
    return spread_rank(everything, ["shard"], ["doc_id", "g", "copy"], "slot").select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
