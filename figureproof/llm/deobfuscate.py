"""Toxicity by noisy-channel deobfuscation (operator 8).

1. A character trigram model is counted over all documents (counts per task,
   summed by Spark; as many rows as there are trigrams of 64 letter classes).
2. Tokens that look disguised (digits or signs beside letters, a letter three
   times in a row, single letters in a row) become lattices: a sign may be one
   of a few letters or nothing, a repeated letter may be nothing, a separator is
   nothing. Viterbi decoding finds the reading of least cost under the channel
   and the trigram model; it takes the token's place in the text.
3. The restored text is scored: each of its 5-letter windows within a word
   (word ends count as a letter) has a weight, the log ratio of the shares of
   toxic and other training documents that hold it; a logistic function of the
   strongest weights gives the score.

Labels are learned from training rows only. The classifier is fitted on at most
``SAMPLE`` of them, those with the least hash of doc_id; window weights for the
logistic fit come from the other half of the sample. The sample is the only
thing broadcast. Texts are never shuffled.

Defined results: a null or empty text has no windows and gets the score of a
text without evidence; rows without labels are only scored; with no labels of
one kind all scores are the share of toxic labels; repeated rows and null
doc_ids are scored like others; a long text is scored whole; an empty table
gives no rows; other columns stay.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import keep

#: Labelled training rows that the classifier is fitted on, at most.
SAMPLE = 30_000
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Buckets of hashed 5-letter windows.
BUCKETS = 1 << 20
#: Training documents that must hold a window for it to have a weight.
SUPPORT = 3
STRONG = 3.0
#: Characters that a task counts before it hands its trigrams on.
COUNT_CHARS = 4 << 20

# ---- fixed values: what signs may stand for
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
# ---- end of fixed values
SEPARATORS = " .-_*~"

# letter classes: 0 no letter, 1-26 a-z, 27-62 the letters of Latin-1 and their like, 63 any other letter
_ACCENTED = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7) + "œšžł"
LETTERS = "\0abcdefghijklmnopqrstuvwxyz" + _ACCENTED[:36]
_CLASS = np.zeros(0x110000, np.uint8)


def _fill() -> None:
    letters = [c for c in range(0x80, 0x3000) if chr(c).isalpha()]
    _CLASS[letters] = 63
    _CLASS[0x3000:0xE000] = 63
    _CLASS[0xF900:0xFB00] = 63
    _CLASS[0x10000:] = 63
    for k, c in enumerate(LETTERS):
        if k:
            _CLASS[ord(c)] = k


_fill()


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def lowered(text: str) -> str:
    """Lower case, one character for one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


# ---- the character model

def _count(batches):
    counts, seen = np.zeros(1 << 18, np.int64), 0
    def out():
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["gram", "n"])
    for b in batches:
        for at in range(0, b.num_rows, 500):
            text = "\n" + "\n".join(lowered(t) for t in b.column(0).slice(at, 500).to_pylist() if t) + "\n"
            for s in range(0, len(text), COUNT_CHARS):
                c = _CLASS[codepoints(text[max(0, s - 2):s + COUNT_CHARS])].astype(np.int32)
                grams = c[:-2] << 12 | c[1:-1] << 6 | c[2:]
                # letters and ends of words; runs of other characters are one end
                counts += np.bincount(grams[(c[1:-1] > 0) | ((c[:-2] == 0) & (c[2:] > 0))], minlength=1 << 18)
            seen += len(text)
            if seen >= COUNT_CHARS:
                yield out()
                counts[:], seen = 0, 0
    if seen:
        yield out()


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): trigrams of letter classes (6 bits each) over all texts."""
    return (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count, "gram int, n bigint")
            .groupBy("gram").agg(F.sum("n").alias("n")))


#: Readings of disguised tokens that a Python worker keeps.
KEPT = 50_000
_WORKER: dict[tuple, object] = {}


def _in_worker(build, *parts):
    """An unpickled model is one object per worker, not one per task: tasks of a stage share it and what it has learned."""
    key = (build.__qualname__, *(hashlib.sha1(p.tobytes()).digest() if isinstance(p, np.ndarray) else None for p in parts))
    if key not in _WORKER:
        for old in [k for k in _WORKER if k[0] == key[0]]:
            del _WORKER[old]
        _WORKER[key] = build(*parts)
    return _WORKER[key]


class Model:
    """Costs -log P(c | a, b), interpolated with the shorter contexts, and the decoder over them."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(64, 64, 64).astype(np.float64)
        tri = n / np.maximum(n.sum(axis=2, keepdims=True), 1)
        two = n.sum(axis=0)
        bi = two / np.maximum(two.sum(axis=1, keepdims=True), 1)
        one = two.sum(axis=0)
        uni = (one + 1) / (one.sum() + 64)
        # contexts seen often are trusted
        seen = n.sum(axis=2, keepdims=True)
        w3, w2 = seen / (seen + 20), (two.sum(axis=1) / (two.sum(axis=1) + 20))[None, :, None]
        p = w3 * tri + (1 - w3) * (w2 * bi[None] + (1 - w2) * uni[None, None])
        self._set(-np.log(0.999 * p + 0.001 * uni[None, None]).astype(np.float32))

    def _set(self, cost: np.ndarray) -> None:
        self.cost = cost
        self._rows: dict[tuple[int, int], list[float]] = {}
        self._known: dict[str, str] = {}

    @classmethod
    def of_cost(cls, cost: np.ndarray) -> "Model":
        out = cls.__new__(cls)
        out._set(cost)
        return out

    def __reduce__(self):
        return _in_worker, (Model.of_cost, self.cost)

    def restore(self, token: str) -> str:
        """The reading of least cost of one lower-case token; readings are kept, up to ``KEPT``."""
        known = self._known
        if token not in known:
            if len(known) >= KEPT:
                known.clear()
            known[token] = self._restore(token)
        return known[token]

    def _row(self, a: int, b: int) -> list[float]:
        if (a, b) not in self._rows:
            self._rows[a, b] = self.cost[a, b].tolist()
        return self._rows[a, b]

    def _lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each character the letters (or nothing) that it may stand for, with the channel's cost."""
        out, n = [], len(token)
        body = [i for i, c in enumerate(token) if c.isalpha()]
        first, last = (body[0], body[-1]) if body else (0, n - 1)
        spaced = any(c in SEPARATORS for c in token[first:last])
        for i, c in enumerate(token):
            if c.isalpha():
                arcs = [(c, 0.0)]
                if i and token[i - 1] == c:
                    run = len(token[:i + 1]) - len(token[:i + 1].rstrip(c))
                    more = len(token[i:]) - len(token[i:].lstrip(c))
                    arcs.append(("", 0.2 if run + more > 3 else 5.0))
                    if run > 2:
                        arcs[0] = (c, 3.0)
            elif c in LEET:
                # nothing rather than a letter: in a row of the same sign, and for punctuation beside the word
                row = token[max(0, i - 2):i + 3].count(c * 3) > 0 and not c.isdigit()
                nothing = 0.5 if row else 8.0 if first < i < last else 1.0 if c in WEAK else 7.0
                arcs = [(x, 0.5) for x in LEET[c]] + [("", nothing)]
            elif c in SEPARATORS:
                arcs = [("", 0.0 if spaced else 1.0)]
            else:
                arcs = [("", 4.0)]
            out.append(arcs)
        return out

    def _restore(self, token: str) -> str:
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for arcs in self._lattice(token):
            step: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in best.items():
                row = self._row(a, b)
                for letter, price in arcs:
                    if letter:
                        k = int(_CLASS[ord(letter)])
                        key, total, way = (b, k), cost + price + row[k], (letter, path)
                    else:
                        key, total, way = (a, b), cost + price, path
                    if key not in step or total < step[key][0]:
                        step[key] = (total, way)
            best = step
        total, path = min(((cost + self._row(a, b)[0], path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])
        out = []
        while path:
            letter, path = path
            out.append(letter)
        return "".join(reversed(out))


_SIGN = np.zeros(0x110000, bool)
_SIGN[[ord(c) for c in LEET]] = True
# ordinary punctuation beside a word; a sign for a letter only between letters
WEAK = "!(<|+"
_WEAK = np.zeros(0x110000, bool)
_WEAK[[ord(c) for c in WEAK]] = True
_SEP = np.zeros(0x110000, bool)
_SEP[[ord(c) for c in SEPARATORS]] = True
_SPACE = re.compile(r"\s")


def disguised(low: str) -> list[tuple[int, int]]:
    """Spans of the tokens of a lower-case text that look disguised, in order, none within another."""
    cp = codepoints(low)
    n = len(cp)
    if n < 2:
        return []
    letter = _CLASS[cp] > 0
    flag = np.zeros(n, bool)
    sign = _SIGN[cp]
    sure = sign & ~_WEAK[cp]
    pair = (letter[:-1] & sure[1:]) | (sure[:-1] & letter[1:])
    flag[:-1] |= pair
    flag[1:] |= pair
    if n > 2:
        flag[1:-1] |= letter[:-2] & sign[1:-1] & letter[2:]
        triple = letter[2:] & (cp[2:] == cp[1:-1]) & (cp[1:-1] == cp[:-2])
        flag[2:] |= triple
    # letters or signs one by one: x . x . x . x
    like = letter | sign
    alone = like.copy()
    alone[1:] &= ~like[:-1]
    alone[:-1] &= ~like[1:]
    spans = []
    if n > 6:
        step = alone[:-2] & _SEP[cp[1:-1]] & alone[2:]
        run = step[:-4] & step[2:-2] & step[4:] & (letter[:-6] | letter[2:-4] | letter[4:-2] | letter[6:])
        last = -1
        for s in np.flatnonzero(run).tolist():
            if s < last:
                continue
            e = s
            while e + 2 < n and step[e]:
                e += 2
            spans.append((s, e + 1))
            last = e + 1
    white = np.flatnonzero((cp == 32) | ((cp >= 9) & (cp <= 13)))
    at = np.flatnonzero(flag)
    if len(at):
        k = np.unique(np.searchsorted(white, at))
        starts = np.where(k > 0, white[np.maximum(k - 1, 0)] + 1, 0) if len(white) else np.zeros(len(k), np.int64)
        stops = np.where(k < len(white), white[np.minimum(k, len(white) - 1)], n) if len(white) else np.full(len(k), n)
        spans += list(zip(starts.tolist(), stops.tolist()))
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def restore(text: str | None, model: Model) -> str:
    """The text in lower case with its disguised tokens restored."""
    low, out, last = lowered(text or ""), [], 0
    for s, e in disguised(low):
        out += [low[last:s], model.restore(low[s:e])]
        last = e
    return "".join([*out, low[last:]])


# ---- the classifier

def windows(text: str) -> np.ndarray:
    """Buckets of the 5-letter windows within words; a word's ends count as letters."""
    c = _CLASS[codepoints("\n" + text + "\n")].astype(np.uint32)
    if len(c) < 5:
        return np.zeros(0, np.int64)
    inner = (c[1:-3] > 0) & (c[2:-2] > 0) & (c[3:-1] > 0)
    at = np.flatnonzero(inner)
    g = c[at] << np.uint32(24) | c[at + 1] << np.uint32(18) | c[at + 2] << np.uint32(12) | c[at + 3] << np.uint32(6) | c[at + 4]
    return ((g * np.uint32(2654435761)) >> np.uint32(12)).astype(np.int64)


def _document_counts(batches, model: Model):
    """(half, bucket, toxic, other): training documents that hold each window."""
    n = np.zeros((2, 2, BUCKETS), np.int32)
    for b in batches:
        for text, toxic, half in zip(*(b.column(i).to_pylist() for i in range(3))):
            n[half, toxic, np.unique(windows(restore(text, model)))] += 1
    for half in (0, 1):
        at = np.flatnonzero(n[half].any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), half, np.int32)), pa.array(at.astype(np.int32)),
                                          pa.array(n[half, 1, at]), pa.array(n[half, 0, at])], names=["half", "bucket", "toxic", "other"])


def features(text: str | None, model: Model, weights: np.ndarray) -> list[float]:
    at = np.unique(windows(restore(text, model)))
    w = weights[at]
    strong = w[w > STRONG]
    top = np.sort(w)[-6:][::-1] if len(w) else np.zeros(0)
    top = np.maximum(top, 0)
    return [float(top[0]) if len(top) else 0.0, float(top.sum() / 6), float(np.log1p(len(strong))), float(np.log1p(len(at)))]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: (mean, scale, coefficients with the intercept first)."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta, penalty = np.zeros(z.shape[1]), np.diag([0.0, *[ridge] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, beta


def _weights_of(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS, np.float32)
    out[at] = values
    return out


class Weights:
    """Weights of the window buckets; those that are not 0 travel."""

    def __init__(self, dense: np.ndarray):
        self.dense = dense

    @classmethod
    def of_parts(cls, at: np.ndarray, values: np.ndarray) -> "Weights":
        return cls(_weights_of(at, values))

    def __reduce__(self):
        at = np.flatnonzero(self.dense)
        return _in_worker, (Weights.of_parts, at.astype(np.int32), self.dense[at])


class Classifier:
    def __init__(self, model: Model, weights: np.ndarray, fit, base: float):
        self.model, self._weights, self.fit, self.base = model, Weights(weights), fit, base

    @property
    def weights(self) -> np.ndarray:
        return self._weights.dense

    def score(self, text: str | None) -> float:
        if self.fit is None:
            return self.base
        mean, scale, beta = self.fit
        z = beta[0] + ((np.array(features(text, self.model, self.weights)) - mean) / scale) @ beta[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned: crc32 of the id as text modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _log_ratio(toxic, other, n_toxic: int, n_other: int):
    return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((other + 0.5) / (n_other + 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, *, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit the character model on all ``docs`` and the classifier on labelled rows that are not held out."""
    counts = np.zeros(1 << 18, np.int64)
    for r in character_counts(docs, text_col).collect():  # at most 64 ** 3 rows
        counts[r.gram] = r.n
    model = Model(counts)
    rows = (labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
            .groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
            .orderBy(F.xxhash64("__id"), "__id").limit(sample))
    chosen = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
              .join(F.broadcast(rows), F.col("id") == F.col("__id"))
              .select("text", "toxic", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)).cast("int").alias("half")))
    chosen = keep(chosen, "labelled-sample")
    sizes = {(r.half, r.toxic): r.n for r in chosen.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    n = np.array([[sizes.get((h, t), 0) for t in (0, 1)] for h in (0, 1)])
    total = n.sum()
    base = float(n[:, 1].sum() / total) if total else 0.0
    if not n.all():
        return Classifier(model, np.zeros(BUCKETS, np.float32), None, base)
    held = keep(chosen.mapInArrow(lambda it: _document_counts(it, model), "half int, bucket int, toxic int, other int")
                .groupBy("half", "bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "window-counts")

    def weights(frame: DataFrame, toxic: int, other: int) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        ratio = _log_ratio(F.col("toxic"), F.col("other"), toxic, other)
        for r in frame.filter(F.col("toxic") + F.col("other") >= SUPPORT).select("bucket", ratio.alias("w")).filter("w > 0.5").collect():
            out[r.bucket] = r.w  # as many as there are buckets, at most
        return out

    x, y = [], []
    for half in (0, 1):
        w = weights(held.filter(F.col("half") == half), int(n[half, 1]), int(n[half, 0]))

        def run(batches, w=Weights(w)):
            for b in batches:
                got = [features(t, model, w.dense) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])
        for r in chosen.filter(F.col("half") != half).select("text", "toxic").mapInArrow(run, "x array<double>, y int").collect():
            x.append(r.x)
            y.append(r.y)
    fit = _fit(np.array(x), np.array(y, np.float64))
    both = held.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    return Classifier(model, weights(both, int(n[:, 1].sum()), int(n[:, 0].sum())), fit, base)


def with_score(docs: DataFrame, classifier: Classifier, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the score of each text in ``out``; one pass, nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            got = pa.array([classifier.score(t.as_py()) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, out])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def toxic(score):
    return score >= THRESHOLD


def remove_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose restored text is scored as toxic."""
    classifier = train(docs, labels, sample, id_col=id_col, text_col=text_col)
    return with_score(docs, classifier, "__score", text_col).filter(~toxic(F.col("__score"))).drop("__score")
