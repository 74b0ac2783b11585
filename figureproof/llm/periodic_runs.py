"""Detection of periodic runs of words by recursive frequency splitting (operator 13).

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) of at least max(``MIN_WORDS``, 2 q) words that no neighbouring
word extends. Every word of a run occurs in it twice at least. So a word that
occurs once in a segment splits the segment, stretches shorter than
``MIN_WORDS`` fall away, and what is left is counted and split again until
nothing changes. All texts of a batch are split together, by one sort a round.

Surviving segments are scanned lag by lag. A run of period q has at least
max(``MIN_WORDS``, 2 q) - q places in a row that equal the one q words on, so one of the
multiples of that number is among them: only those are probed, and a hit
is extended to both sides. A stretch that is found again is one of a smaller
period. Places inside a known run whose period divides the lag are passed over, so that a
text of one word repeated costs no more than its probes.

A text is one row and one task's work; nothing is shuffled.

Defined results: null, empty and white texts have no words and no runs; null and
repeated doc_ids, repeated rows stay rows; a long text is processed whole; an
empty table gives no rows; other columns are ignored, and kept by ``collapse``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import text_slices

MIN_WORDS = 12
#: Text bytes that are looked at in one go (a longer text is one go).
SLICE_BYTES = 2 << 20


def segments(ids: np.ndarray, group: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the segments that survive the splitting; ``group`` numbers the texts, in order."""
    at, n_ids = np.arange(len(ids)), int(ids.max(initial=0)) + 1
    while len(at):
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (group[at[1:]] != group[at[:-1]])
        seg = np.cumsum(new) - 1
        long = np.bincount(seg)[seg] >= min_words
        if not long.all():
            at, seg = at[long], seg[long]
        _, which, n = np.unique(seg * n_ids + ids[at], return_inverse=True, return_counts=True)
        often = n[which] > 1
        if often.all():
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(at) else at
            return at[first], at[np.append(first[1:], len(at)) - 1] + 1 if len(at) else at
        at = at[often]
    return at, at


def _reach(x: np.ndarray, i: int, q: int, step: int) -> int:
    """How many places from ``i`` on in direction ``step`` equal the one q words on, ``i`` itself left out."""
    n, span = 0, 8
    while True:
        if step > 0:
            a = i + 1 + n
            b = min(a + span, len(x) - q)
            same = x[a:b] == x[a + q:b + q]
        else:
            b = i - n
            a = max(b - span, 0)
            same = (x[a:b] == x[a + q:b + q])[::-1]
        if not len(same):
            return n
        miss = int(same.argmin())
        if not same[miss]:
            return n + miss
        n, span = n + len(same), span * 2


def lag_scan(x: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one segment, by period and start."""
    m, out, seen = len(x), [], set()
    # of a run over each place: its period and its stop
    period, stop = np.full(m, m + 1), np.zeros(m, np.int64)
    for q in range(1, m // 2 + 1):
        least = max(min_words, 2 * q)
        step = least - q
        hits = np.flatnonzero(x[:m - q:step] == x[q::step]) * step
        if not len(hits):
            continue
        hits = hits[(q % period[hits] != 0) | (hits + q >= stop[hits])]
        upto = -1
        for i in hits.tolist():
            if i < upto:
                continue
            right = _reach(x, i, q, 1)
            upto = i + right + 1
            start, end = i - _reach(x, i, q, -1), upto + q
            if end - start < least or (start, end) in seen:
                continue
            seen.add((start, end))
            out.append((start, end - start, q))
            wider = stop[start:end] < end
            period[start:end][wider], stop[start:end][wider] = q, end
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def runs_of(texts: list[list], min_words: int = MIN_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, a list of words, by start and period."""
    known: dict = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
    group = np.repeat(np.arange(len(texts)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    found: list[list] = [[] for _ in texts]
    for a, b in zip(*(v.tolist() for v in segments(ids, group, min_words))):
        t = int(group[a])
        found[t] += [(s + a - int(first[t]), n, q) for s, n, q in lag_scan(ids[a:b], min_words)]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_DDL = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _scan(batches, min_words: int, edit: Callable | None):
    """Rows of an id, further columns and a text -> the same without the text, and what was found in it."""
    for b in text_slices(batches, -1, SLICE_BYTES):
        texts = [(t or "").encode("utf-8").split() for t in b.columns[-1].to_pylist()]
        if edit is not None:
            texts = [edit(i, w) for i, w in zip(b.column(0).to_pylist(), texts)]
        runs = runs_of(texts, min_words)
        yield pa.RecordBatch.from_arrays([
            *b.columns[:-1], pa.array([len(w) for w in texts], pa.int64()),
            pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], _RUNS),
            pa.array([b" ".join(collapsed(w, r) if r else w).decode("utf-8") for w, r in zip(texts, runs)], pa.string())],
            names=[*b.schema.names[:-1], "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, edit: Callable | None = None, *, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of bytes other than ASCII white space. ``collapsed`` joins the words that no run contains after its first
    period by one space. ``edit``, if given, turns (doc_id, words) into the words to look at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scan(it, min_words, edit), f"doc_id bigint, {_DDL}")


def collapse(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every text that holds a run replaced by its collapsed words; other texts stay as they are."""
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                        F.col(text_col).cast("string").alias("text"))
    row = whole.schema["row"].dataType.simpleString()
    done = whole.mapInArrow(lambda it: _scan(it, min_words, None), f"doc_id bigint, row {row}, {_DDL}")
    return done.select(*[(F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("row")[c]) if c == text_col
                          else F.col("row")[c]).alias(c) for c in docs.columns])
