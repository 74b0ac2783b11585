"""Substring deduplication by content-defined chunks (operator 2).

A gear rolling hash over the last 16 bytes is taken at every byte of a text.
A word start is a cut where its hash is less than those of the two word starts
before and the two behind it, any character start where ten upper bits are zero
(for texts without white space). So a cut depends on the words nearby alone,
chunks are three words at least between such cuts (and ``MAX_WORDS`` at most), and
an insertion moves no cut further on. Chunks of at least ``MIN_BYTES`` are keyed by 96 bits of their digest;
smaller ones have no key and belong to a repeat only between two chunks that do.

A key that two doc_ids share is a repeat. Keys are counted with partial
aggregation first, and only then joined with the chunks (a join whose hot keys
adaptive execution splits), so no key's rows meet in one task. Consecutive
repeated chunks of at least ``MIN_WORDS`` words in all are a repeated passage.
The least doc_id keeps it, all others lose it. A passage loses to both sides what
lies outside of its whole chunks: of those of 30 words nine in ten are found,
of 40 words and more practically all (measured in tests/llm/test_gear.py).

A text is told apart from others of its doc_id by 64 bits of hash.

Defined results: a null or empty text has no chunks; a null doc_id counts as
less than all others; repeats within one doc_id, in one text or in several rows,
are left alone (such rows are one document); rows equal in id and text are looked
at once and all get the result; a long text is processed whole; an empty table gives
no rows; other columns are ignored, and kept by ``remove``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import text_bytes, text_slices

MIN_BYTES = 12
MIN_WORDS = 16
#: Word starts to both sides that have a greater hash than a cut, and upper bits that are zero at a cut elsewhere.
NEAR_WORDS, ANY_BITS = 2, 10
#: Words from a cut to the next one at most, so that words repeated over and over are cut as well.
MAX_WORDS = 12
#: Text bytes that are looked at in one go.
SLICE_BYTES = 4 << 20
_WINDOW = 16
_NO_ID = -(1 << 63)

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h(i) = sum of GEAR[data[i - j]] << 2j over the last 16 bytes, modulo 2 ** 32, by doubling the window."""
    h = _GEAR[data]
    span = 1
    while span < _WINDOW:
        older = h[:-span] << np.uint32(2 * span)
        h[span:] += older
        span *= 2
    return h


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where chunks start, and the places of word starts; a row's own start is always a cut."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~white
    word[1:] &= white[:-1]
    word[starts[starts < ends]] = ~white[starts[starts < ends]]
    h = gear(data)
    at = np.zeros(len(data), bool)
    at[1:] = ((h[:-1] >> np.uint32(32 - ANY_BITS)) == 0) & ((data[1:] & 0xC0) != 0x80)
    for k in range(_WINDOW):  # a cut's 16 bytes are the row's own
        near = starts + k
        at[near[near < ends]] = False
    own = starts[starts < ends]
    words = np.flatnonzero(word)
    row = np.searchsorted(own, words, side="right") - 1
    least = words - own[row] >= _WINDOW
    value = np.where(least, h[np.maximum(words, 1) - 1], np.uint32(0xFFFFFFFF))
    for k in range(1, NEAR_WORDS + 1):
        apart = row[k:] != row[:-k]
        least[k:] &= apart | (value[k:] < value[:-k])
        least[:-k] &= apart | (value[:-k] <= value[k:])
    at[words[least]] = True
    # words since the last such cut, or the row's start
    number = np.arange(len(words))
    first = np.append(True, row[1:] != row[:-1]) if len(row) else least
    since = number - np.maximum.accumulate(np.where(least | first, number, 0))
    at[words[(since > 0) & (since % MAX_WORDS == 0)]] = True
    at[own] = True
    return np.flatnonzero(at), words


def chunks(column: pa.Array):
    """Keyed chunks of the rows of a string column: row, seq, pos, len, words, first word's number, digest as bytes."""
    data, starts, ends = text_bytes(column)
    at, words = cuts(data, starts, ends)
    full = starts < ends
    if not full.any():
        return None
    rows = np.flatnonzero(full)
    row = rows[np.searchsorted(starts[rows], at, side="right") - 1]
    inside = at < ends[row]
    at, row = at[inside], row[inside]
    stop = np.minimum(np.append(at[1:], ends[row[-1]] if len(row) else 0), ends[row])
    long = stop - at >= MIN_BYTES
    at, stop, row = at[long], stop[long], row[long]
    w = np.searchsorted(words, stop) - np.searchsorted(words, at)
    first = np.searchsorted(row, row, side="left")
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    got = b"".join([digest(view[s:e]) for s, e in zip(at.tolist(), stop.tolist())])
    return row, np.arange(len(row)) - first, at - starts[row], stop - at, w, got


# place: seq << 32 | pos, extent: len << 32 | words (few wide columns keep the shuffled rows short)
_CHUNK_DDL = "hi bigint, lo int, doc_id bigint, tid bigint, place bigint, extent bigint"


def _chunk_rows(batches):
    for b in text_slices(batches, 1, SLICE_BYTES):
        got = chunks(b.column(1))
        if got is None:
            continue
        row, seq, pos, length, words, digest = got
        key = np.frombuffer(digest, ">i8").reshape(-1, 2)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[:, 0].astype(np.int64)), pa.array((key[:, 1] >> 32).astype(np.int32)),
             b.column(0).take(take), b.column(2).take(take), pa.array(seq.astype(np.int64) << 32 | pos),
             pa.array(length.astype(np.int64) << 32 | words)], names=["hi", "lo", "doc_id", "tid", "place", "extent"])


def _tid(text_col: str):
    """A text's identity within its doc_id."""
    return F.xxhash64(F.col(text_col).cast("string"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       _tid(text_col).alias("tid"))


def _runs(found: list, min_words: int) -> dict:
    """Repeated passages of one text from its repeated chunks [(seq, pos, len, words, first, mine)]."""
    spans, shared, removed, firsts, run = [], 0, [], set(), []

    def close():
        nonlocal shared
        if sum(c[3] for c in run) < min_words:
            return
        shared += sum(c[3] for c in run)
        begin = None
        for k, c in enumerate(run):
            if not c[5]:
                firsts.add(c[4])
                begin = c[1] if begin is None else begin
            if begin is not None and (c[5] or k == len(run) - 1):
                end = run[k - 1][1] + run[k - 1][2] if c[5] else c[1] + c[2]
                removed.append((begin, end))
                begin = None
        spans.append((run[0][1], run[-1][1] + run[-1][2]))

    for c in sorted(found):
        if run and c[0] != run[-1][0] + 1:
            close()
            run = []
        run.append(c)
    if run:
        close()
    return {"shared_words": shared, "spans": [{"start": a, "stop": b} for a, b in spans],
            "removed": [{"start": a, "stop": b} for a, b in removed], "first_docs": sorted(firsts)}


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_PASSAGES = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("shared_words", pa.int64()), ("spans", _SPAN),
                       ("removed", _SPAN), ("first_docs", pa.list_(pa.int64()))])
_PASSAGES_DDL = ("doc_id bigint, tid bigint, shared_words bigint, spans array<struct<start:int,stop:int>>,"
                 " removed array<struct<start:int,stop:int>>, first_docs array<bigint>")


def _passage_rows(batches, min_words: int):
    for b in batches:
        out = []
        for r in b.to_pylist():
            low = 0xFFFFFFFF
            found = [(c["place"] >> 32, c["place"] & low, c["extent"] >> 32, c["extent"] & low, c["first"], c["first"] == r["doc_id"])
                     for c in r["found"]]
            got = _runs(found, min_words)
            if got["spans"]:
                out.append({"doc_id": r["doc_id"], "tid": r["tid"], **got})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PASSAGES)


def passages(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with repeated passages: doc_id (null: the least long), tid, their byte spans, those to remove, the keepers' ids.

    A text's chunks are gathered as a set, so that rows equal in id and text count once.
    """
    found = _rows(docs, id_col, text_col).mapInArrow(_chunk_rows, _CHUNK_DDL)
    repeated = (found.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                .filter("first < last").select(F.col("hi").alias("h"), F.col("lo").alias("l"), "first"))
    hits = found.join(repeated, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")))
    per_text = hits.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("place", "extent", "first")).alias("found"))
    return per_text.mapInArrow(lambda it: _passage_rows(it, min_words), _PASSAGES_DDL)


def report(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: how much of its text is repeated in other documents, where, and what would go."""
    found = passages(docs, min_words, id_col=id_col, text_col=text_col)
    none = F.array().cast("array<struct<start:int,stop:int>>")
    rows = _rows(docs, id_col, text_col).select(
        "doc_id", "tid", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    named = found.withColumnsRenamed({"doc_id": "i", "tid": "t"})
    return rows.join(named, (F.col("doc_id") == F.col("i")) & (F.col("tid") == F.col("t")), "left").select(
        F.nullif(F.col("doc_id"), F.lit(_NO_ID)).alias("doc_id"), "n_bytes", F.coalesce("shared_words", F.lit(0)).alias("shared_words"),
        F.col("spans").isNotNull().alias("repeated"),
        F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]), F.lit(0).cast("long")).alias("removed_bytes"),
        F.coalesce("spans", none).alias("spans"), F.coalesce("removed", none).alias("removed"),
        F.transform(F.coalesce("first_docs", F.array().cast("array<bigint>")), lambda i: F.nullif(i, F.lit(_NO_ID))).alias("first_docs"))


def _without(text, removed):
    """The text without the byte spans ``removed``, which are in order: what lies between them, put together."""
    raw = text.cast("binary")
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda r: r["stop"]))
    stops = F.concat(F.transform(removed, lambda r: r["start"]), F.array(F.octet_length(text)))
    return F.transform(F.array(raw), lambda b: F.array_join(F.zip_with(
        starts, stops, lambda s, e: F.substring(b, s + 1, e - s).cast("string")), ""))[0]


def remove(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text",
           length_col: str | None = None) -> DataFrame:
    """``docs`` with each repeated passage left in its first document only; a text of which nothing but white space is left goes.

    ``length_col``, if given, becomes the number of characters of the new text.
    """
    found = (passages(docs, min_words, id_col=id_col, text_col=text_col).filter(F.size("removed") > 0)
             .select(F.col("doc_id").alias("i"), F.col("tid").alias("t"), "removed"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), _tid(text_col).alias("tid"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = rows.join(found, (F.col("doc_id") == F.col("i")) & (F.col("tid") == F.col("t")), "left")
    text = F.col("row")[text_col].cast("string")
    left = joined.select("row", F.when(F.col("removed").isNotNull(), _without(text, F.col("removed"))).alias("new"))
    types = docs.schema

    def of(c):
        value = {text_col: F.col("new"), length_col: F.char_length("new")}.get(c)
        return F.col("row")[c] if value is None else F.when(F.col("new").isNotNull(), value.cast(types[c].dataType)).otherwise(F.col("row")[c])
    return left.filter(F.col("new").isNull() | F.col("new").rlike(r"\S")).select(*[of(c).alias(c) for c in docs.columns])
