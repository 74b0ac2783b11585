import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from figureproof.llm import deobfuscate as D
from figureproof.llm import queries as Q
from helpers import AWKWARD, table

SF = "/root/testdata/sf0.01"


def plain_counts(texts):
    out = Counter()
    for t in texts:
        c = [0, *[int(D._CLASS[ord(x)]) for x in D.lowered(t or "")], 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            if b or (a == 0 and d):
                out[a << 12 | b << 6 | d] += 1
    return out


def test_character_counts(spark):
    got = {r.gram: r.n for r in D.character_counts(table(spark)).collect()}
    want = plain_counts([t for _, t in AWKWARD])
    # texts of a batch are joined by one end: contexts of two ends before a letter differ there
    inner = {g: n for g, n in want.items() if (g >> 6) & 63}
    assert {g: n for g, n in got.items() if (g >> 6) & 63} == inner


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    words = ["idiot", "stupid", "pathetic", "loser", "garbage", "house", "garden", "window", "class", "glass"]
    text = " ".join(rng.choice(words) for _ in range(4000))
    counts = np.zeros(1 << 18, np.int64)
    for g, n in plain_counts([text]).items():
        counts[g] = n
    return D.Model(counts)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="idotsl01$!.s", min_size=1, max_size=7))
def test_viterbi_equals_all_paths(model, token):
    best = None
    for arcs in itertools.product(*model._lattice(token)):
        letters = [x for x, _ in arcs if x]
        c = [0, 0, *[int(D._CLASS[ord(x)]) for x in letters], 0]
        cost = sum(p for _, p in arcs) + sum(float(model.cost[a, b, d]) for a, b, d in zip(c, c[1:], c[2:]))
        best = cost if best is None else min(best, cost)
    got = model.restore(token)
    reach = [sum(p for _, p in arcs) + sum(float(model.cost[a, b, d]) for a, b, d in zip(c, c[1:], c[2:]))
             for arcs in itertools.product(*model._lattice(token))
             for c in [[0, 0, *[int(D._CLASS[ord(x)]) for x, _ in arcs if x], 0]] if "".join(x for x, _ in arcs) == got]
    assert min(reach) == pytest.approx(best, abs=1e-3)


@pytest.mark.parametrize("noisy,clean", [
    ("1d10t", "idiot"), ("$tup1d", "stupid"), ("p@thet1c", "pathetic"), ("l o s e r", "loser"), ("l.0.s.e.r", "loser"),
    ("loooooser", "loser"), ("g4rb4ge", "garbage"), ("idiot!", "idiot!"), ("class", "class")])
def test_restoration(model, noisy, clean):
    assert D.restore(f"the {noisy} there", model) == f"the {clean} there"


def test_plain_text_stays(model):
    text = "a plain text, of 3 lines (or 4.5)\nand more été 漢字 \U0001f600"
    assert D.restore(text, model) == text
    assert D.restore(None, model) == ""


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdé. \n", max_size=40))
def test_windows(text):
    words = re.findall(r"[a-zé]+", text)
    want = set()
    for w in words:
        c = [0, *[int(D._CLASS[ord(x)]) for x in w], 0]
        for i in range(len(c) - 4):
            g = c[i] << 24 | c[i + 1] << 18 | c[i + 2] << 12 | c[i + 3] << 6 | c[i + 4]
            want.add((g * 2654435761 % (1 << 32)) >> 12)
    assert set(D.windows(text).tolist()) == want


def labelled(spark, seed=1, n=600):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(300)]
    bad = ["idiot", "stupid", "pathetic", "loser", "garbage"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(0, 60))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randint(0, len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), clean


def test_disguised_toxic_texts_are_found(spark):
    docs, labels, clean = labelled(spark)
    rng = random.Random(9)
    fresh = lambda: [rng.choice(clean) for _ in range(30)]
    extra = [(1000 + k, " ".join([*fresh(), w, *fresh()])) for k, w in enumerate(
        ["1d10t and stüpid l0ser", "$tup1d p@thet1c", "l o s e r i d i o t", "g.a.r.b.a.g.e 1diot"])]
    harmless = [(2000 + k, " ".join([*fresh(), w, *fresh()])) for k, w in enumerate(["2024-05-06", "a1b2c3", "hellooo", "1 2 3 4 5", "x.y.z"])]
    df = table(spark, docs + extra + harmless)
    clf = D.train(df, labels)
    got = {r.doc_id: r.score for r in D.with_score(df, clf).collect()}
    assert all(got[i] >= D.THRESHOLD for i, _ in extra)
    assert all(got[i] < D.THRESHOLD for i, _ in harmless)
    wrong = sum((got[i] >= D.THRESHOLD) != (i % 3 == 0) for i, _ in docs)
    assert wrong <= 6
    left = D.remove_toxic(df, labels)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, s in got.items() if s < D.THRESHOLD}


def test_awkward_rows_and_missing_labels(spark):
    docs = table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    clf = D.train(docs, none)
    assert [r.score for r in D.with_score(docs, clf).collect()] == [0.0] * len(AWKWARD)
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r.score for r in D.with_score(docs, D.train(docs, one)).collect()} == {1.0}
    assert D.with_score(docs.limit(0), clf).count() == 0
    assert D.train(docs.limit(0), none).base == 0.0


def test_query_on_held_out_rows(spark):
    rows = Q.op8_deobfuscate(spark, SF).collect()
    import zlib
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert not any(s >= 0.7 and not y for s, y in held)
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert sum(pairs) / len(pairs) > 0.9
