"""Benchmark decontamination on a positional inverted index (operator 3).

The index is a Parquet table with one row per shard of documents: the ids and
word counts of its documents and, for every term kept, the places of its
occurrences in the shard (documents are numbered through with a gap between
them, so no phrase crosses two). Terms are 64-bit hashes of words. The index
may hold all words, or those of a test set only, which is much smaller.

A test phrase is looked up shard by shard. Its terms' lists, each shifted by
the term's offset in the phrase, are intersected from the term that is rarest
in the whole corpus on; the corpus counts come from the index by partial
aggregation and are as many as the test set has words. What is left of the
lists after the last term are exact occurrences; with ``slack`` the lists are
matched within so many places of their offset (proximity).

The test set is the query set: it goes to all shards in blocks of at most about
``BLOCK_BYTES`` of text, one pass over the index per block. Documents are never
shuffled with their texts.

Defined results: null and empty texts have no words; an item without words has
no window; items with equal ids count once; a null item_id is left out; null and
repeated doc_ids are kept, one row per input row, told apart by 128 bits of hash of
their texts where rows are removed; a very long text is a shard of
its own; an empty table on either side gives no rows, or rows without hits;
other columns are ignored, and kept by ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import text_bytes
from .common import hash128, keep

WINDOW = 13
SLACK = 2
#: Text bytes of a shard, and of a block of the test set.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20

_LOWERED = np.zeros(256, np.uint8)  # 0: no part of a word
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _LOWERED[_b] = _b
for _b in range(65, 91):
    _LOWERED[_b] = _b + 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0], have, step = 1, 1, base
    while have < n:
        more = min(have, n - have)
        out[have:have + more] = out[:more] * np.uint64(step)
        have, step = have + more, step * step % (1 << 64)
    return out


class Words:
    """Words of the rows of a string column, as 64-bit hashes."""

    _up, _down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def __init__(self, column: pa.Array):
        data, starts, ends = text_bytes(column)
        low = _LOWERED[data]
        inside = low != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        own = starts[starts < ends]
        first[own] = inside[own]  # a row's first byte starts a word even where the row before ends in one
        begin = np.flatnonzero(first)
        stop = np.flatnonzero(inside & np.append(~inside[1:] | first[1:], True)) + 1 if len(data) else begin
        if len(Words._up) < len(data) + 1:
            Words._up, Words._down = _powers(_BASE, 2 * len(data) + 1), _powers(_INVERSE, 2 * len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(low.astype(np.uint64) * Words._up[:len(data)], out=total[1:])
        h = (total[stop] - total[begin]) * Words._down[begin]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        self.hashes = h.view(np.int64)
        # words of row i: hashes[at[i]:at[i + 1]]
        self.at = np.append(np.searchsorted(begin, starts), len(begin)) if len(starts) else np.zeros(1, np.int64)
        null = starts == ends
        if null.any():  # an empty row begins where the next one does
            self.at[:-1] = np.searchsorted(begin, starts)

    def rows(self) -> list[np.ndarray]:
        return [self.hashes[a:b] for a, b in zip(self.at[:-1], self.at[1:])]


_INDEX_DDL = ("shard bigint, doc_ids array<bigint>, t1s array<bigint>, t2s array<bigint>, n_words array<int>, terms array<bigint>,"
              " counts array<int>, places binary")
_INDEX = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("t1s", pa.list_(pa.int64())), ("t2s", pa.list_(pa.int64())),
                    ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
                    ("places", pa.binary())])


def _bases(n_words: np.ndarray) -> np.ndarray:
    """The place of each document's first word; one place lies between two documents."""
    return np.concatenate([[0], np.cumsum(np.asarray(n_words, np.int64) + 1)])


def _shards(batches, vocabulary: np.ndarray | None, shard_bytes: int):
    part, k = TaskContext.get().partitionId(), 0
    if vocabulary is not None:
        maybe = np.zeros(1 << 16, bool)
        maybe[vocabulary & 0xFFFF] = True
    for batch in batches:
        _, starts, ends = text_bytes(batch.column(1))
        size = np.cumsum(ends - starts)
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, before + shard_bytes, side="right")))
            rows = batch.slice(at, stop - at)
            words = Words(rows.column(1))
            n_words = np.diff(words.at)
            places = np.arange(len(words.hashes)) + np.repeat(np.arange(len(n_words)), n_words)
            terms = words.hashes
            if vocabulary is not None:
                hit = np.flatnonzero(maybe[terms & 0xFFFF])
                found = np.searchsorted(vocabulary, terms[hit])
                hit = hit[(found < len(vocabulary)) & (vocabulary[np.minimum(found, len(vocabulary) - 1)] == terms[hit])] \
                    if len(vocabulary) else hit[:0]
                terms, places = terms[hit], places[hit]
            order = np.argsort(terms, kind="stable")
            terms, places = terms[order], places[order]
            kept, first = np.unique(terms, return_index=True)
            yield pa.RecordBatch.from_pylist([{
                "shard": part << 32 | k, "doc_ids": rows.column(0).to_pylist(), "t1s": rows.column(2).to_pylist(),
                "t2s": rows.column(3).to_pylist(), "n_words": n_words.tolist(), "terms": kept.tolist(),
                "counts": np.diff(np.append(first, len(terms))).tolist(), "places": places.astype("<i4").tobytes()}], schema=_INDEX)
            at, k = stop, k + 1


def build_index(docs: DataFrame, vocabulary=None, *, id_col: str = "doc_id", text_col: str = "text",
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the index of all words, or of the hashed words in ``vocabulary``, to the shared folder."""
    words = None if vocabulary is None else np.unique(np.asarray(vocabulary, np.int64))
    t1, t2 = hash128(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), t1.alias("t1"), t2.alias("t2"))
    return keep(rows.mapInArrow(lambda it: _shards(it, words, shard_bytes), _INDEX_DDL), "phrase-index")


class Phrases:
    """A block of the test set: distinct windows of hashed words, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.windows: list[np.ndarray] = []
        self.items: list[list[str]] = []
        known: dict[bytes, int] = {}
        words = Words(pa.array([t for _, t in items], pa.string())).rows()
        for (name, _), w in zip(items, words):
            if name is None or not len(w):
                continue
            for s in range(max(1, len(w) - window + 1)):
                one = w[s:s + window]
                k = known.setdefault(one.tobytes(), len(self.windows))
                if k == len(self.windows):
                    self.windows.append(one.copy())
                    self.items.append([])
                if name not in self.items[k]:
                    self.items[k].append(name)
        self.vocabulary = np.unique(np.concatenate(self.windows)) if self.windows else np.zeros(0, np.int64)

    def ordered(self, counts: dict[int, int]) -> None:
        """Offsets of each window by the corpus count of the term there, rarest first."""
        self.order = [np.argsort([counts.get(t, 0) for t in w.tolist()], kind="stable") for w in self.windows]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        flat = np.concatenate(self.windows) if self.windows else np.zeros(0, np.int64)
        self.term = np.searchsorted(self.vocabulary, flat)
        self.first = np.concatenate([[0], np.cumsum(self.length)])[:-1] if self.windows else self.length


def _near(lists: np.ndarray, want: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place wanted: is one of the list within ``slack``, and is it there itself."""
    at = np.searchsorted(lists, want - slack)
    near = lists[np.minimum(at, len(lists) - 1)]
    ok = (at < len(lists)) & (near <= want + slack)
    if not slack:
        return ok, ok
    there = np.searchsorted(lists, want)
    return ok, (there < len(lists)) & (lists[np.minimum(there, len(lists) - 1)] == want)


def _lookup(batches, phrases: Phrases, slack: int):
    schema = pa.schema([("shard", pa.int64()), ("ord", pa.int32()), ("spans", pa.list_(pa.int32())),
                        ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
    for batch in batches:
        for r in batch.to_pylist():
            terms = np.array(r["terms"], np.int64)
            places, ends = np.frombuffer(r["places"], "<i4").astype(np.int64), np.cumsum(r["counts"], dtype=np.int64)
            if not len(terms) or not phrases.windows:
                continue
            slot = np.searchsorted(terms, phrases.vocabulary)
            present = (slot < len(terms)) & (terms[np.minimum(slot, len(terms) - 1)] == phrases.vocabulary)
            all_there = np.logical_and.reduceat(present[phrases.term], phrases.first)
            base = _bases(r["n_words"])
            found: dict[int, tuple] = {}
            for k in np.flatnonzero(all_there).tolist():
                window, cand, exact = phrases.windows[k], None, None
                for o in phrases.order[k].tolist():
                    s = int(np.searchsorted(terms, window[o]))
                    listed = places[(ends[s - 1] if s else 0):ends[s]]
                    if cand is None:
                        cand = listed - o
                        exact = np.ones(len(cand), bool)
                    else:
                        ok, there = _near(listed, cand + o, slack)
                        cand, exact = cand[ok], (exact & there)[ok]
                    if not len(cand):
                        break
                if not len(cand):
                    continue
                doc = np.searchsorted(base, np.maximum(cand, 0), side="right") - 1
                for d in np.unique(doc).tolist():
                    spans, items, near = found.setdefault(d, ([], set(), set()))
                    mine = cand[(doc == d) & exact] - base[d]
                    near.update(phrases.items[k])
                    if len(mine):
                        items.update(phrases.items[k])
                        spans.append((mine, len(window)))
            out = []
            for d, (spans, items, near) in found.items():
                merged: list[int] = []
                if spans:
                    first = np.concatenate([a for a, _ in spans])
                    stop = np.concatenate([a + n for a, n in spans])
                    order = np.argsort(first, kind="stable")
                    first, stop = first[order], np.maximum.accumulate(stop[order])
                    new = np.append(True, first[1:] > stop[:-1])
                    begin = np.flatnonzero(new)
                    merged = np.stack([first[begin], stop[np.append(begin[1:], len(first)) - 1]], axis=1).ravel().tolist()
                out.append({"shard": r["shard"], "ord": d, "spans": merged, "items": sorted(items), "near": sorted(near)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)


def _verdict(batches):
    """Rows of all blocks of one document -> covered words and items."""
    schema = pa.schema([("shard", pa.int64()), ("ord", pa.int32()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                        ("items_sha256", pa.string()), ("n_near_items", pa.int64())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            spans = sorted((s[i], s[i + 1]) for s in r["spans"] for i in range(0, len(s), 2))
            hit, upto = 0, 0
            for a, b in spans:
                hit += max(0, b - max(a, upto))
                upto = max(upto, b)
            items = sorted({i for x in r["items"] for i in x})
            out.append({"shard": r["shard"], "ord": r["ord"], "n_hit": hit, "n_items": len(items),
                        "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(),
                        "n_near_items": len({i for x in r["near"] for i in x})})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The test set in blocks of about ``block_bytes``; one block at a time is in the driver's memory."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes))
    for b in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r.item, r.text) for r in part.collect()]


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK, *, id_col: str = "doc_id",
                text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, t1, t2 (the text's hashes), n_words, n_hit, n_items, items_sha256, n_near_items.

    Items found by proximity have a window whose words all stand within ``slack`` places of where they should.
    """
    out = None
    for block in _blocks(items, item_col, item_text_col, block_bytes):
        phrases = Phrases(block, window)
        index = build_index(docs, phrases.vocabulary, id_col=id_col, text_col=text_col, shard_bytes=shard_bytes)
        # as many counts as the block has different words
        counts = (index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms")
                  .agg(F.sum("t.counts").alias("n")).collect())
        phrases.ordered({r.terms: r.n for r in counts})
        hits = index.select("shard", "n_words", "terms", "counts", "places").mapInArrow(
            lambda it, p=phrases: _lookup(it, p, slack),
            "shard bigint, ord int, spans array<int>, items array<string>, near array<string>")
        listed = index.select("shard", "doc_ids", "t1s", "t2s", "n_words") if out is None else listed
        out = hits if out is None else out.unionByName(hits)
    # the shards of all blocks are cut alike: same input, same bytes
    merged = (out.groupBy("shard", "ord").agg(*[F.collect_list(c).alias(c) for c in ("spans", "items", "near")])
              .mapInArrow(_verdict, "shard bigint, ord int, n_hit bigint, n_items bigint, items_sha256 string, n_near_items bigint"))
    rows = (listed.select("shard", F.posexplode(F.arrays_zip("doc_ids", "t1s", "t2s", "n_words")).alias("ord", "d"))
            .select("shard", "ord", "d.doc_ids", "d.t1s", "d.t2s", "d.n_words"))
    none = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    return rows.join(merged, ["shard", "ord"], "left").select(
        F.col("doc_ids").alias("doc_id"), F.col("t1s").alias("t1"), F.col("t2s").alias("t2"), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), F.coalesce("n_near_items", zero).alias("n_near_items"))


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` without the rows of which test windows cover a twentieth of the words or more."""
    t1, t2 = hash128(F.col(text_col))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"),
                        F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    bad = (occurrences(docs, items, id_col=id_col, text_col=text_col, **kwargs).filter(contaminated())
           .select(F.col("doc_id").alias("i"), F.col("t1").alias("h1"), F.col("t2").alias("h2")).distinct())
    left = named.join(bad, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
