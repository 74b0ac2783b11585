"""Order MinHash fingerprints (operator 10), in DataFrame functions only.

A text's k-mers are runs of ``K`` tokens (stretches of up to 24 characters
without white space). Each k-mer carries its occurrence number, so repeats
count. The pairs are ranked by one hash; its upper bits deal them to ``BINS``
bins, and the ``L`` least of each bin are put back into text order and hashed
together. A bin is equal in two fingerprints if the same k-mers stand there in
the same order, so moves lower the likeness as edits do. One permutation cut
into bins stands for many independent ones; that leaves one hash per k-mer.

The work on one text is a chain of array functions of its row. Occurrence
numbers come from the sorted k-mers by a search in powers of two, so a text of
one word repeated is no worse than any other.

The next document of the ring needs an order of all ids: the ids alone are
dealt by ranges, looked up within each range, and the ranges' first ids are
joined on (one row per range). Texts meet by a join on the id.

Defined results: null is the empty text, whose fingerprint is empty; two empty
fingerprints have likeness 1; a text of fewer than ``K`` tokens is one k-mer; a
null doc_id is the least; rows with one doc_id go by the hash of the text; rows
equal in both are one document, returned as often as it is given; a single
document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep

K, L = 3, 2
#: A power of two, at most 64.
BINS = 64
_POS = 26  # bits of a place in a text
_RANK = 37  # bits of a rank: 6 for the bin, 31 within it
_NO_ID = -(1 << 63)


def _low(c: Column, bits: int) -> Column:
    return c.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _shl(c: Column, bits: int) -> Column:
    return F.shiftleft(c, bits)


def _shr(c: Column, bits: int) -> Column:
    return F.shiftright(c, bits)


def signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: array<bigint> of (bin << 32 | hash) of the bins in use, ascending."""
    w, s, r, q = (f"{out}__{x}" for x in ("w", "s", "r", "q"))
    # each array is read more than once by the next step, so it is computed once, in a projection of its own
    df = df.withColumn(w, F.regexp_extract_all(F.col(text), F.lit(r"\S{1,24}"), F.lit(0)))
    grams = F.when(F.size(w) >= K, F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (K - 1), F.lit(0))),
        lambda x, i: _shl(_low(F.xxhash64(x, *[F.col(w)[i + j] for j in range(1, K)]), _RANK), _POS).bitwiseOR(i.cast("long"))))
    short = F.when(F.size(w) > 0, F.array(_shl(_low(F.xxhash64(w), _RANK), _POS))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(s, F.sort_array(F.coalesce(grams, short))).drop(w)

    def occurrence(x: Column, i: Column) -> Column:
        same = lambda d: _shr(F.col(s)[(i - d).cast("int")], _POS) == _shr(x, _POS)
        steps = F.array(*[F.lit(1 << b) for b in range(_POS - 1, -1, -1)])
        return F.when((i > 0) & same(F.lit(1)), F.aggregate(
            steps, F.lit(0), lambda d, p: F.when((i >= d + p) & same(d + p), d + p).otherwise(d))).otherwise(F.lit(0))

    ranked = F.transform(s, lambda x, i: _shl(_low(F.xxhash64(_shr(x, _POS), occurrence(x, i)), _RANK), _POS).bitwiseOR(_low(x, _POS)))
    df = df.withColumn(r, F.sort_array(ranked)).drop(s)
    in_bin = 31 + (6 - (BINS.bit_length() - 1))
    of = lambda e: _shr(e, _POS + in_bin)
    least = F.filter(r, lambda e, i: (i < L) | (of(F.col(r)[(F.greatest(i - L, F.lit(0))).cast("int")]) != of(e)))
    # bin | place | low bits of the rank: text order within the bin
    placed = F.transform(least, lambda e: _shl(of(e), _POS + 31).bitwiseOR(_shl(_low(e, _POS), 31)).bitwiseOR(_low(_shr(e, _POS), 31)))
    df = df.withColumn(q, F.sort_array(placed)).drop(r)
    at = lambda i: F.col(q)[i.cast("int")]
    bin_of = lambda e: _shr(e, _POS + 31)

    def tuple_hash(e: Column, i: Column) -> Column:
        parts = [_low(e, 31)]
        for j in range(1, L):
            parts.append(F.when(i + j < F.size(q), F.when(bin_of(at(i + j)) == bin_of(e), _low(at(i + j), 31))))
        first = (i == 0) | (bin_of(at(F.greatest(i - 1, F.lit(0)))) != bin_of(e))
        return F.when(first, _shl(bin_of(e), 32).bitwiseOR(_low(F.xxhash64(*parts), 32)))

    return df.withColumn(out, F.filter(F.transform(q, tuple_hash), lambda c: c.isNotNull())).drop(q)


def as_text(signature) -> Column:
    """Two hex digits of the bin and eight of its hash, for each bin in use."""
    return F.array_join(F.transform(signature, lambda c: F.lpad(F.lower(F.hex(c)), 10, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal bins among those in use in either."""
    bins = lambda c: F.transform(c, lambda x: _shr(x, 32))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def _ring(docs: DataFrame) -> DataFrame:
    """(id, h, n_chars, next_id, next_h) of each document: the next one by descending (id, h), the first after the last."""
    order = [F.col("id").desc(), F.col("h").desc()]
    ids = docs.groupBy("id", "h").agg(F.max(F.char_length("text")).cast("long").alias("n_chars"))
    ranged = keep(ids.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ring")
    inside = Window.partitionBy("range").orderBy(*order)
    follows = ranged.withColumn("after", F.lead(F.struct("id", "h")).over(inside))
    # one row per range
    across = Window.orderBy("range")
    heads = ranged.groupBy("range").agg(F.max(F.struct("id", "h")).alias("head"))
    heads = heads.select(F.col("range").alias("r"), F.coalesce(
        F.lead("head").over(across), F.first("head").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    return (follows.join(heads, F.col("range") == F.col("r")).withColumn("to", F.coalesce("after", "head"))
            .select("id", "h", "n_chars", F.col("to.id").alias("next_id"), F.col("to.h").alias("next_h")))


def with_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sig, edited_sig, next_sig): signatures of each text, its edited text and the next text.

    Edited: the last third (floor of n_chars / 3) is replaced by the first as many characters of the next document.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.select("id", "h", "text")
    ring = keep(_ring(rows), "ring-next")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    to = ring.select(F.col("id").alias("to_id"), F.col("h").alias("to_h"), "n_chars", "next_id", "next_h")
    given = (rows.join(to, (F.col("id") == F.col("next_id")) & (F.col("h") == F.col("next_h")))
             .select("to_id", "to_h", "n_chars", F.substring("text", F.lit(1), third).alias("head"))
             .dropDuplicates(["to_id", "to_h"]))
    edited = (rows.join(given, (F.col("id") == F.col("to_id")) & (F.col("h") == F.col("to_h")))
              .select("id", "h", "n_chars", "text", F.concat(
                  F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.col("head")).alias("edited")))
    signed = signatures(signatures(edited, "text", "sig"), "edited", "edited_sig")
    signed = keep(signed.select("id", "h", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                                "sig", "edited_sig"), "order-min-hash")
    own = ring.select(F.col("id").alias("to_id"), F.col("h").alias("to_h"), "next_id", "next_h")
    next_sig = (signed.dropDuplicates(["id", "h"]).select("id", "h", F.col("sig").alias("next_sig"))
                .join(own, (F.col("id") == F.col("next_id")) & (F.col("h") == F.col("next_h"))).select("to_id", "to_h", "next_sig"))
    return (signed.join(next_sig, (F.col("id") == F.col("to_id")) & (F.col("h") == F.col("to_h")))
            .select(F.nullif(F.col("id"), F.lit(_NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", "sig", "edited_sig", "next_sig"))
