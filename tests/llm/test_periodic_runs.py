import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from figureproof.llm import periodic_runs as P
from figureproof.llm import queries as Q
from helpers import AWKWARD, LONG, table

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """Every maximal stretch of every period, kept if no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                part = words[i:j + q]
                if not any(part[:-p] == part[p:] for p in range(1, q)):
                    out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return (text or "").encode().split()


pieces = st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 12)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(pieces, st.integers(4, 14))
def test_runs_against_all_periods(parts, least):
    words = [w for unit, times in parts for w in unit * times]
    assert P.runs_of([words], least)[0] == brute(words, least)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=5))
def test_texts_of_a_batch_do_not_meet(texts):
    assert P.runs_of(texts) == [brute(t) for t in texts]


def test_words_that_occur_once_split_until_nothing_changes():
    import numpy as np
    # a is rare only after the first cut: x stands between the two halves
    words = [*"abcdefabcdef", "x", *"ghijklghijka"]
    ids = np.array([ord(w) for w in words])
    starts, stops = P.segments(ids, np.zeros(len(words), np.int64))
    assert list(zip(starts.tolist(), stops.tolist())) == [(0, 12)]


def test_long_texts_cost_no_square():
    n = 300_000
    assert P.runs_of([["w"] * n])[0] == [(0, n, 1)]
    assert P.runs_of([[i % 1000 for i in range(n)]])[0] == [(0, n, 1000)]


def test_query(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = split(r.text)
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        want[r.doc_id] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                          hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
                          hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())
    rows = Q.op13_periodic_runs(spark, SF).collect()
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows}
    assert got == want and len(rows) == len(want) and sum(v[0] > 0 for v in want.values()) > 5


def test_awkward_rows(spark):
    docs = table(spark)
    rows = P.periodic_runs(docs).collect()
    assert len(rows) == len(AWKWARD)
    assert sorted((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs]) for r in rows) == sorted(
        (i or -1, len(split(t)), brute(split(t)) if t != LONG else [(0, 16000, 4)]) for i, t in AWKWARD)
    assert {r.collapsed for r in rows if r.doc_id == 7} == {"alpha beta gamma delta", "another text of the same id"}
    kept = P.collapse(docs)
    assert kept.columns == docs.columns and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    texts = sorted((r.doc_id or -1, r.text or "", r.text is None) for r in kept.collect())
    assert texts == sorted((i or -1, "alpha beta gamma delta" if t == LONG else t or "", t is None) for i, t in AWKWARD)
    assert P.periodic_runs(docs.limit(0)).count() == 0 and P.collapse(docs.limit(0)).count() == 0
