"""Token files with Elias-Fano document boundaries (operator 1).

Format: a folder with two Parquet tables. ``blocks`` holds runs of whole
documents in ascending document order: the concatenated ids (2 bytes each if
the vocabulary allows, else 4) and the ends of the documents in it as an
Elias-Fano sequence with a sampled select directory. ``index`` has one row per
block: how many documents and ids lie before it. Offsets in a block are 32-bit,
no 64-bit table of document offsets exists anywhere.

Documents are dealt by ranges of (doc_id, text hash), so ids are written in
ascending doc_id order and no task gets more than its range.

Defined results: a null or empty text is a document without ids but for the end
id; a null doc_id sorts first; rows with the same doc_id are ordered by the hash
of the text, rows equal in both are adjacent; an empty table gives empty files
and no rows; a very long text makes a block of its own; further columns of the
input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .encoder import encoder

#: Ids per block; a block ends with the document that reaches them.
BLOCK_TOKENS = 1 << 20
#: One select sample for this many documents.
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of ``n`` integers up to ``universe`` in about n * (2 + log2(universe / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values, universe: int) -> "EliasFano":
        v = np.asarray(values, np.int64)
        n = len(v)
        bits = max(0, int(universe // n).bit_length() - 1) if n else 0
        ones = (v >> bits) + np.arange(n)
        high = np.zeros((int(universe) >> bits) + n + 1, np.uint8)
        high[ones] = 1
        low = ((v[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
        return cls(n, bits, np.packbits(low, bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Value ``i``: the position of the i-th one of the upper bits, from the nearest sample on."""
        at, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, first = at >> 3, True
        while True:
            bits = int(self.high[byte])
            if first:
                bits, first = bits & (0xFF << (at & 7)), False
            ones = bits.bit_count()
            if need < ones:
                for _ in range(need):
                    bits &= bits - 1
                place = byte * 8 + (bits & -bits).bit_length() - 1
                return ((place - i) << self.low_bits) | self._low(i)
            need, byte = need - ones, byte + 1

    def _low(self, i: int) -> int:
        b = self.low_bits
        if not b:
            return 0
        first = i * b
        last = first + b
        word = int.from_bytes(self.low[first >> 3:(last + 7) >> 3].tobytes(), "little")
        return (word >> (first & 7)) & ((1 << b) - 1)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        upper = (ones - np.arange(self.n)) << self.low_bits
        if not self.low_bits:
            return upper
        low = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
        return upper + (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


class TokenBlock:
    """One block read back: ``document(k)`` slices document k by two selects."""

    def __init__(self, ids: bytes, width: int, ends: EliasFano):
        self.ids = np.frombuffer(ids, "<u2" if width == 2 else "<u4")
        self.ends = ends

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.ends.select(k - 1) if k else 0:self.ends.select(k)]

    def documents(self):
        start = 0
        for end in self.ends.values().tolist():
            yield start, self.ids[start:end]
            start = end


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_docs", pa.int32()),
                    ("n_tokens", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()),
                    ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
_BLOCK_DDL = ("part int, block int, doc_ids array<bigint>, n_docs int, n_tokens bigint, width int, ids binary,"
              " low_bits int, low binary, high binary, samples binary")


def _blocks(batches, path: str, end_id: int, block_tokens: int):
    enc = encoder(path)
    width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
    part, block, names, pieces, ends, size = TaskContext.get().partitionId(), 0, [], [], [], 0

    def written():
        ef = EliasFano.encode(ends, size)
        return pa.RecordBatch.from_pylist([{
            "part": part, "block": block, "doc_ids": names, "n_docs": len(names), "n_tokens": size, "width": width,
            "ids": b"".join(pieces), "low_bits": ef.low_bits, "low": ef.low.tobytes(), "high": ef.high.tobytes(),
            "samples": ef.samples.tobytes()}], schema=_BLOCK)

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            got = enc.encode_bytes(text.as_py()) + end
            pieces.append(got)
            names.append(name)
            size += len(got) // width
            ends.append(size)
            if size >= block_tokens:
                yield written()
                block, names, pieces, ends, size = block + 1, [], [], [], 0
    if names:
        yield written()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id",
                      text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> str:
    """Encode ``docs`` with the tokenizer file and write the token files to ``folder`` (shared storage)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(lambda it: _blocks(it, tokenizer, end_id, block_tokens), _BLOCK_DDL)
     .write.option("compression", "zstd").parquet(f"{folder}/blocks"))
    sizes = spark.read.parquet(f"{folder}/blocks").select("part", "block", "n_docs", "n_tokens")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per written part: its number is that of the write tasks, so one small task sums them
    ahead = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy(F.col("part").alias("p")).agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    parts = parts.select("p", F.coalesce(F.sum("d").over(ahead), F.lit(0)).alias("d"),
                         F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("t"))
    (sizes.withColumn("bd", F.coalesce(F.sum("n_docs").over(before), F.lit(0)))
     .withColumn("bt", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
     .join(parts, F.col("part") == F.col("p"))
     .select("part", "block", (F.col("d") + F.col("bd")).alias("base_doc"), (F.col("t") + F.col("bt")).alias("base_token"))
     .write.parquet(f"{folder}/index"))
    return folder


def _documents(batches, with_ids: bool):
    for batch in batches:
        for row in batch.to_pylist():
            ends = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
            out = {k: [] for k in ("part", "block", "doc_id", "at", "start", "n_tokens", "ids_crc32")}
            ids = []
            for k, (name, (start, got)) in enumerate(
                    zip(row["doc_ids"], TokenBlock(row["ids"], row["width"], ends).documents())):
                wide = got.astype("<u4")
                for c, v in zip(out, (row["part"], row["block"], name, k, start, len(got), zlib.crc32(wide.tobytes()))):
                    out[c].append(v)
                if with_ids:
                    ids.append(wide.astype(np.int64))
            cols = [pa.array(v, t) for v, t in zip(out.values(), (
                pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
            names = list(out)
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, its ordinal, start and n_tokens, the crc32 of its ids, on demand the ids."""
    ddl = "part int, block int, doc_id bigint, at bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    docs = spark.read.parquet(f"{folder}/blocks").mapInArrow(
        lambda it: _documents(it, with_ids), ddl + (", ids array<bigint>" if with_ids else ""))
    index = spark.read.parquet(f"{folder}/index")
    return (docs.join(index, ["part", "block"])
            .select("doc_id", (F.col("base_doc") + F.col("at")).alias("ordinal"),
                    (F.col("base_token") + F.col("start")).alias("start"), "n_tokens", "ids_crc32",
                    *(["ids"] if with_ids else [])))
