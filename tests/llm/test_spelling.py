import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from figureproof.llm import queries as Q
from figureproof.llm import spelling as S
from helpers import AWKWARD, table

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Do the two words differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows, min_chars=5, min_count=3, typo=97):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if typo and h % typo == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}


def brute(n):
    out = {}
    by = {w: [] for w in n}
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if abs(len(a) - len(b)) < 2 and near(a, b):
                by[a].append(b)
                by[b].append(a)
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in by.items()}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None)
    return out


def check(rows, want):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(rows) == len(got) and got == want


letters = st.text(st.sampled_from("abé"), min_size=4, max_size=12)


@settings(max_examples=500, deadline=None)
@given(letters, st.integers(0, 12), st.sampled_from(["insert", "delete", "replace"]), st.sampled_from("abé"),
       st.lists(letters, max_size=8))
def test_the_pivots_of_one_word_are_met_in_the_other(a, at, edit, c, others):
    at %= len(a)
    b = {"insert": a[:at] + c + a[at:], "delete": a[:at] + a[at + 1:], "replace": a[:at] + c + a[at + 1:]}[edit]
    if a == b or len(b) < 4:
        return
    grams = Counter(g for w in {a, b, *others} for g in {w[i:i + 2] for i in range(len(w) - 1)})
    order = {g: (k, n) for k, (n, g) in enumerate(sorted((n, g) for g, n in grams.items()))}
    one, two = sorted((S.prefix_and_pivots(w, order)[0], w) for w in (a, b))
    left, right = S.prefix_and_pivots(one[1], order)[2]
    assert right - left >= 2
    places = S.prefix_and_pivots(two[1], order)[1]
    x, y = one[1], two[1]
    assert any(x[:left + 2] == y[:p + 2] and x[:right] == y[:right] or x[right:] == y[p:] for p in places)


def test_pivots_are_the_rarest_disjoint_two():
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(4, 14)))
        grams = sorted({word[i:i + 2] for i in range(len(word) - 1)})
        order = {g: (k, n) for k, (n, g) in enumerate(sorted((rng.randint(1, 50), g) for g in grams))}
        last, places, (left, right) = S.prefix_and_pivots(word, order)
        weight = lambda p: order[word[p:p + 2]][1]
        assert places == [p for p in range(len(word) - 1) if order[word[p:p + 2]][0] <= last] and len(places) >= 3
        best = min(weight(p) + weight(q) for p in places for q in places if q - p >= 2)
        assert weight(left) + weight(right) == best


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(Q.op11_pivotal_grams(spark, SF).collect(), brute(counted(rows)))


def test_dense_words_and_long_chains(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdñ") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words = dict.fromkeys(base)
    for w in base:
        for _ in range(8):
            at = rng.randrange(len(w))
            words[rng.choice([w[:at] + rng.choice("abcdñ") + w[at + 1:], w[:at] + w[at + 1:], w[:at] + "a" + w[at:]])] = None
    n = {w: 3 * 2 ** rng.randint(0, 6) for w in words if len(w) >= 5}
    # a chain of words, each twice as frequent as the one before
    chain = ["zyxwvuts" + "q" * k for k in range(12)]
    n |= {w: 3 * 2 ** k for k, w in enumerate(chain)}
    text = [(k, f"{w} " * (c // 3)) for w, c in n.items() for k in range(3)]
    frame = spark.createDataFrame(text, "doc_id long, text string")
    got = S.variants(frame).collect()
    want = brute(n)
    check(got, want)
    assert {r.root for r in got if r.word in chain} == {chain[-1]}


@pytest.mark.parametrize("keys", [0, 10])
def test_long_lists_in_blocks(spark, monkeypatch, keys):
    monkeypatch.setattr(S, "BROADCAST_KEYS", keys)
    rng = random.Random(8)
    n = {"tho" + "".join(rng.choice("abc") for _ in range(rng.randint(2, 5))): 3 for _ in range(150)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in S.near_pairs(words, block=4).collect()]
    listed = sorted(n)
    assert sorted(got) == [(a, b) for i, a in enumerate(listed) for b in listed[i + 1:] if near(a, b)]


def test_letters_and_counts(spark):
    rows = [(1, "Straße straße STRAßE Étés étés wordsĀwords words1words"), (2, "words"), (None, "words" * 2 + " Words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in S.vocabulary(frame, min_count=1).collect()}
    assert got == counted(rows, min_count=1, typo=0)
    typos = {r.word: r.n for r in S.vocabulary(frame, min_count=1, typo_every=2).collect()}
    assert typos == counted(rows, min_count=1, typo=2)


def test_awkward_rows(spark):
    docs = table(spark)
    check(S.variants(docs, typo_every=97).collect(), brute(counted(AWKWARD)))
    check(S.variants(docs, min_count=1).collect(), brute(counted(AWKWARD, min_count=1, typo=0)))
    assert S.variants(docs.limit(0)).count() == 0
