"""Token counts from flat token files without an index (operator 4).

A flat file is a run of ids in which a separator ends each document; it is
stored as blocks of a fixed number of ids, cut anywhere. Each block is searched
for separators by itself with one vector comparison and gives a summary: ids,
separators, ids before its first and after its last separator, and the lengths
between. A prefix scan over the summaries (ids so far, separators so far,
place of the last separator so far) stitches documents that cross blocks, and
numbers them. The scan has two levels, so that a file of any size is never one
task's work: blocks within a group of ``SCAN_GROUP``, then one row per group.

Defined results: n_tokens leaves the separator out; a null or empty text has 0
ids; ids behind the last separator of a file are a document with terminated
false; the separator must be an id that no text yields (the encoder treats
its string in a text as ordinary text); an empty table gives no rows; null and
repeated doc_ids are kept, one row per input row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep
from .encoder import encoder

BLOCK_TOKENS = 1 << 18
#: Blocks that one task of the prefix scan sums up.
SCAN_GROUP = 4096

_FLAT = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()),
                   ("names", pa.list_(pa.int64()))])
_FLAT_DDL = "file int, block int, width int, ids binary, names array<bigint>"


def _flat(batches, path: str, separator: int, block_tokens: int):
    enc = encoder(path, specials_as_text=True)
    width = enc.dtype.itemsize
    end, full = np.array([separator], enc.dtype).tobytes(), block_tokens * width
    file, block, waiting, names = TaskContext.get().partitionId(), 0, bytearray(), []

    def out(data: bytes):
        return pa.RecordBatch.from_pylist(
            [{"file": file, "block": block, "width": width, "ids": data, "names": names}], schema=_FLAT)

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            waiting += enc.encode_bytes(text.as_py()) + end
            names.append(name)
            if len(waiting) >= full:
                for at in range(0, len(waiting) - full + 1, full):
                    yield out(bytes(waiting[at:at + full]))
                    block, names = block + 1, []
                del waiting[:len(waiting) // full * full]
    if waiting or names:
        yield out(bytes(waiting))


def write_flat_files(docs: DataFrame, folder: str, tokenizer: str, separator: int, *, id_col: str = "doc_id",
                     text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> str:
    """One flat file per input partition, in input order: nothing is shuffled. ``names`` lists the doc_ids alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    (rows.mapInArrow(lambda it: _flat(it, tokenizer, separator, block_tokens), _FLAT_DDL)
     .write.option("compression", "zstd").parquet(folder))
    return folder


_SUMMARY_DDL = "file int, block int, n_ids bigint, n_seps bigint, last_end bigint, lengths array<bigint>"


def _scan(batches, separator: int):
    for batch in batches:
        rows = []
        for file, block, width, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            got = np.frombuffer(ids, "<u2" if width == 2 else "<u4")
            at = np.flatnonzero(got == separator)
            lengths = np.diff(at, prepend=-1) - 1  # the first one is the head of the block
            rows.append({"file": file, "block": block, "n_ids": len(got), "n_seps": len(at),
                         "last_end": int(at[-1]) + 1 if len(at) else None, "lengths": lengths.tolist()})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("file", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("n_seps", pa.int64()),
            ("last_end", pa.int64()), ("lengths", pa.list_(pa.int64()))]))


def count_tokens(blocks: DataFrame, separator: int) -> DataFrame:
    """Lengths of the documents of flat ``blocks`` (file, block, width, ids): file, ordinal, start, n_tokens, terminated."""
    found = blocks.select("file", "block", "width", "ids").mapInArrow(lambda it: _scan(it, separator), _SUMMARY_DDL)
    found = keep(found, "separator-scan")  # a few numbers per block and one per document
    found = found.withColumn("g", F.floor(F.col("block") / SCAN_GROUP).cast("int"))
    inner = Window.partitionBy("file", "g").orderBy("block")
    so_far = inner.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # places are relative to the group's first id
    local = (found.withColumn("ids0", F.coalesce(F.sum("n_ids").over(so_far), zero))
             .withColumn("seps0", F.coalesce(F.sum("n_seps").over(so_far), zero))
             .withColumn("end_rel", F.col("ids0") + F.col("last_end"))
             .withColumn("end0", F.max("end_rel").over(so_far)))
    outer = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = (local.groupBy("file", "g").agg(F.sum("n_ids").alias("gi"), F.sum("n_seps").alias("gs"), F.max("end_rel").alias("ge"))
              .withColumn("gids", F.coalesce(F.sum("gi").over(outer), zero))
              .withColumn("gseps", F.coalesce(F.sum("gs").over(outer), zero))
              .withColumn("gend", F.coalesce(F.max(F.col("gids") + F.col("ge")).over(outer), zero)))
    last = Window.partitionBy("file").orderBy(F.col("g").desc())
    tails = (groups.withColumn("r", F.row_number().over(last)).filter("r = 1")
             .select("file", (F.col("gseps") + F.col("gs")).alias("ordinal"),
                     F.coalesce(F.col("gids") + F.col("ge"), F.col("gend")).alias("start"),
                     (F.col("gids") + F.col("gi")).alias("stop"))
             .select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"),
                     F.lit(False).alias("terminated")).filter("n_tokens > 0"))
    # the start of a block's first document: behind the last separator so far
    stitched = (local.join(groups.select("file", "g", "gids", "gseps", "gend"), ["file", "g"]).filter("n_seps > 0")
                .withColumn("from", F.coalesce(F.col("gids") + F.col("end0"), F.col("gend")))
                .withColumn("at", F.col("gids") + F.col("ids0"))
                .select("file", (F.col("gseps") + F.col("seps0")).alias("base"), "from", "at", F.posexplode("lengths").alias("k", "n")))
    # within a block, a later document starts behind the earlier ones and their separators
    run = Window.partitionBy("file", "base").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    whole = (stitched.withColumn("s", F.coalesce(F.sum(F.col("n") + 1).over(run), zero))
             .select("file", (F.col("base") + F.col("k")).alias("ordinal"),
                     F.when(F.col("k") == 0, F.col("from")).otherwise(F.col("at") + F.col("s")).alias("start"),
                     F.when(F.col("k") == 0, F.col("at") - F.col("from") + F.col("n")).otherwise(F.col("n")).alias("n_tokens"),
                     F.lit(True).alias("terminated")))
    return whole.unionByName(tails)


def named_counts(blocks: DataFrame, separator: int) -> DataFrame:
    """``count_tokens`` with the doc_id of each document, from the list of names alone."""
    before = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    names = (blocks.select("file", "block", "names", F.floor(F.col("block") / SCAN_GROUP).cast("int").alias("g"))
             .withColumn("n0", F.coalesce(F.sum(F.size("names")).over(before), zero)))
    groups = (names.groupBy("file", "g").agg(F.sum(F.size("names")).alias("gn"))
              .select("file", "g", F.coalesce(F.sum("gn").over(outer), zero).alias("g0")))
    listed = (names.join(groups, ["file", "g"])
              .select("file", (F.col("g0") + F.col("n0")).alias("n0"), F.posexplode("names").alias("k", "doc_id"))
              .select("file", (F.col("n0") + F.col("k")).alias("ordinal"), "doc_id"))
    return listed.join(count_tokens(blocks, separator), ["file", "ordinal"])
