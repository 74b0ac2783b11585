"""SimHash near-duplicates found by a pigeonring filter (operator 5).

A fingerprint has 64 bits in a ring of five segments. If two fingerprints
differ in at most four bits, some segment starts a chain in which the first
l + 1 segments together differ in at most floor((l + 1) * 4 / 5) bits, for
every l: none in the first, one in the first two, and so on. So the first
segment is equal, and the second differs in one bit at most, hence one of its
halves is equal too: fingerprints meet under (segment, half) and its 19 bits.
Within such a bucket every pair passes the chain's budgets one segment after
the other, and the full length of the chain is the Hamming check.

Copies share one fingerprint and are one row from the start. A bucket gives a
spanning forest of its links, never all pairs: small buckets are compared by
shifts, larger ones by visiting, and those beyond ``BUCKET`` fingerprints are
cut into blocks whose pairs are compared in separate tasks.

Defined results: a null or empty text, or one of white space, has no shingles
and the fingerprint zero, linked like any other; fewer words than the shingle
length make one shingle of all words; null doc_ids are never a component's
least id unless nothing else is in it; repeated rows stay rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import hash128, keep
from .components import components

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: Fingerprints of a bucket that are compared in one go; larger buckets go by pairs of such blocks.
BUCKET = 4096
#: Up to this size a bucket is compared by shifts, together with all others of the batch.
SHIFTED = 48

_WIDTHS = (13, 13, 13, 13, 12)
_SLICE = 1 << 15


def _segments() -> list[int]:
    at, out = 64, []
    for w in _WIDTHS:
        at -= w
        out.append(((1 << w) - 1) << at)
    return out


SEGMENTS = _segments()


def _halves(i: int) -> tuple[int, int]:
    seg = SEGMENTS[(i + 1) % len(SEGMENTS)]
    w = _WIDTHS[(i + 1) % len(SEGMENTS)]
    low = ((1 << (w // 2)) - 1) << ((seg & -seg).bit_length() - 1)
    return seg & ~low, low


#: The bits that make a key, by code 2 * segment + half.
KEYS = [SEGMENTS[i] | h for i in range(len(SEGMENTS)) for h in _halves(i)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][:n]
    ends = (ends - 1)[min(shingle, len(words)) - 1:].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, _SLICE):
        got = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + _SLICE], ends[at:at + _SLICE])])
        counts += np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the 64-bit fingerprint as a signed long."""
    return _prints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), shingle)


def _prints(rows: DataFrame, shingle: int) -> DataFrame:
    """Columns of longs and, last, a text -> the longs and the text's fingerprint as ``fp``."""
    kept = rows.columns[:-1]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([fingerprint(t.as_py(), shingle) for t in b.columns[-1]], pa.int64())], names=[*kept, "fp"])
    return rows.mapInArrow(run, ", ".join([*(f"{c} bigint" for c in kept), "fp bigint"]))


def _budget(length: int, max_bits: int) -> int:
    return length * max_bits // len(SEGMENTS)


_SEG = np.array(SEGMENTS, np.uint64)


def _chain(x: np.ndarray, start: np.ndarray, max_bits: int) -> np.ndarray:
    """Where the differences ``x`` keep all budgets of the chain from segment ``start`` on."""
    at, so_far = np.arange(len(x)), np.zeros(len(x), np.int64)
    for l in range(len(SEGMENTS)):
        so_far = so_far + np.bitwise_count(x[at] & _SEG[(start[at] + l) % len(SEGMENTS)])
        ok = so_far <= _budget(l + 1, max_bits)
        at, so_far = at[ok], so_far[ok]
    return at


def _visit(fp: np.ndarray, start: int, max_bits: int):
    """A spanning forest of one bucket: each visit compares one fingerprint with all that no visit has met."""
    left, todo, out = np.arange(len(fp)), [], []
    while len(left) or todo:
        if not todo:
            todo, left = [left[0]], left[1:]
        u = todo.pop()
        if not len(left):
            break
        hit = _chain(fp[left] ^ fp[u], np.full(len(left), start), max_bits)
        if len(hit):
            v = left[hit]
            out += [(u, w) for w in v.tolist()]
            todo += v.tolist()
            left = np.delete(left, hit)
    return out


class _Forest:
    """Union by least node, over the fingerprints that one task has linked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        while (b := up.setdefault(a, a)) != a:
            up[a] = up[b]
            a = b
        return a

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _links(batches, max_bits: int):
    """Sorted (code, key, pa, pb, fp) -> a star of links for each component that the task has seen."""
    forest, rest = _Forest(), None

    def compare(t: np.ndarray):
        # t: rows of whole buckets; columns code, key, pa, pb, fp
        new = np.concatenate([[True], (t[1:, :4] != t[:-1, :4]).any(axis=1)])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(t)))
        fp, code = t[:, 4].view(np.uint64), t[:, 0]
        for s, n in zip(first[sizes > SHIFTED].tolist(), sizes[sizes > SHIFTED].tolist()):
            part = fp[s:s + n]
            signed = part.view(np.int64).tolist()
            for u, v in _visit(part, int(code[s]) // 2, max_bits):
                forest.link(signed[u], signed[v])
        group = np.repeat(np.arange(len(first)), sizes)
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHIFTED), sizes))
        for d in range(1, SHIFTED):
            at = at[at + d < len(t)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            hit = at[_chain(fp[at] ^ fp[at + d], code[at] // 2, max_bits)]
            for a, b in zip(t[hit, 4].tolist(), t[hit + d, 4].tolist()):
                forest.link(a, b)

    for b in batches:
        t = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
        if not len(t):
            continue
        t = np.concatenate([rest, t]) if rest is not None else t
        last = np.flatnonzero((t[:, :4] != t[-1, :4]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            compare(t[:cut])
        rest = t[cut:]
    if rest is not None and len(rest):
        compare(rest)
    pairs = [(a, r) for a in list(forest.up) if (r := forest.root(a)) != a]
    for at in range(0, len(pairs), 1 << 16):
        part = np.array(pairs[at:at + (1 << 16)], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect exactly what pairs of distinct ``fp`` within ``max_bits`` connect."""
    if not 0 <= max_bits < len(SEGMENTS):
        raise ValueError(f"the ring of {len(SEGMENTS)} segments serves 0 to {len(SEGMENTS) - 1} bits")
    signed = [k - (1 << 64) if k >> 63 else k for k in KEYS]
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(c).alias("code"), F.col("fp").bitwiseAND(F.lit(k).cast("long")).alias("key"))
        for c, k in enumerate(signed)])).alias("k")).select("k.code", "k.key", "fp")
    # buckets beyond the size that one task takes at once; each has more than `bucket` fingerprints
    large = (keyed.groupBy("code", "key").count().filter(F.col("count") > bucket)
             .select("code", "key", F.ceil(F.col("count") / (bucket // 2)).cast("int").alias("blocks")))
    dealt = (keyed.join(large, ["code", "key"], "left")
             .withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
             .select("code", "key", F.least("mine", "other").alias("pa"), F.greatest("mine", "other").alias("pb"), "fp"))
    return (dealt.repartition("code", "key", "pa", "pb").sortWithinPartitions("code", "key", "pa", "pb", "fp")
            .mapInArrow(lambda it: _links(it, max_bits), "u bigint, v bigint"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: the least doc_id that its fingerprint reaches by links."""
    prints = keep(fingerprints(docs, shingle, id_col=id_col, text_col=text_col), "simhash")
    rooted = _rooted(prints, max_bits)
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, first, root): every fingerprint with its least doc_id and the least fingerprint of its component."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes, max_bits))
    return keep(nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")),
                "simhash-roots")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, *, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of fingerprints; all columns stay.

    It is the row with the least doc_id (rows without one come last), the least hash of the text and the least hash
    of all columns; of rows that are equal in all of this, one. Rows of one doc_id, and rows without, are told apart by
    their texts: those in different components all stay.
    """
    hashed = [docs[c] for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)]
    t1, t2 = hash128(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.xxhash64(*hashed).alias("r"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    prints = keep(_prints(rows.select("doc_id", "t1", "t2", "r", "text"), shingle), "simhash")
    rooted = _rooted(prints, max_bits).select(F.col("fp").alias("f"), "root")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t1", "t2", "r")
    # minima with partial aggregation: no component's rows meet in one task
    first = (prints.groupBy("fp").agg(F.min(own).alias("own")).join(rooted, F.col("fp") == F.col("f"))
             .groupBy("root").agg(F.min("own").alias("own")))
    kept = first.select(F.col("own.doc_id").alias("i"), F.col("own.t1").alias("h1"), F.col("own.t2").alias("h2"), F.col("own.r").alias("hr"))
    held = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2"))
                     & (F.col("r") == F.col("hr")), "left_semi")
    one = held.dropDuplicates(["doc_id", "t1", "t2", "r"])
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def hex16(col):
    return F.lpad(F.lower(F.hex(col)), 16, "0")
