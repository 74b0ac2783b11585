import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from figureproof.llm import gear_chunks as G
from figureproof.llm import queries as Q
from helpers import AWKWARD, table

SF = "/root/testdata/sf0.001"


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=80))
def test_gear_equals_definition(raw):
    h = G.gear(np.frombuffer(raw, np.uint8))
    for i in range(len(raw)):
        want = sum(int(G._GEAR[raw[i - j]]) << 2 * j for j in range(min(i + 1, 16))) % (1 << 32)
        assert int(h[i]) == want


LONGER = " ".join(f"word{i * 7919 % 1000}" for i in range(400))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(n))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=300)), max_size=6))
def test_chunks_of_a_batch_are_those_of_each_text(texts):
    def of(column):
        got = G.chunks(column)
        if got is None:
            return []
        row, seq, pos, length, w, digest = got
        return [(int(r), int(s), int(p), int(n), int(k), digest[16 * i:16 * i + 16])
                for i, (r, s, p, n, k) in enumerate(zip(row, seq, pos, length, w))]
    want = [(i, *c[1:]) for i, t in enumerate(texts) for c in of(pa.array([t], pa.string()))]
    assert of(pa.array(texts, pa.string())) == want
    longer = pa.array([LONGER, *texts, LONGER], pa.string())
    assert of(longer[1:-1]) == want, "a slice holds its own rows alone"
    for i, _, pos, length, *_ in want:
        texts[i].encode()[pos:pos + length].decode()  # no character is cut


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [words(rng, rng.randint(55, 90)) for _ in range(12)]
    texts = {i: words(rng, rng.randint(5, 200)) for i in range(n)}
    put = {}
    for p in passages:
        for i in rng.sample(range(n), 4):
            put.setdefault(i, []).append(p)
    for i, ps in put.items():  # passages stand beside each other, never one within another
        t = texts[i].split(" ")
        for at, p in zip(sorted(rng.sample(range(len(t)), min(len(t), len(ps))), reverse=True), ps):
            t.insert(at, p)
        texts[i] = " ".join(t)
    return texts, passages


def windows(text, n=50):
    w = text.split()
    return {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_repeated_passages_are_found_and_left_once(spark):
    texts, passages = corpus(1)
    docs = table(spark, [(i + 100, t) for i, t in texts.items()])
    got = {r.doc_id - 100: r for r in G.report(docs).collect()}
    where = {k: {i for i, t in texts.items() if p in t} for k, p in enumerate(passages)}
    held = set().union(*[v for v in where.values() if len(v) > 1])
    assert {i for i, r in got.items() if r.repeated} == held
    left = {r.doc_id - 100: r.text for r in G.remove(docs, length_col="n_chars").collect()}
    assert all(left[i] == t for i, t in texts.items() if i not in held)
    seen = {}
    for i, t in left.items():
        for w in windows(t):
            assert seen.setdefault(w, i) == i, "a passage of 50 words is still in two documents"
    for k, ids in where.items():  # its first document keeps it whole
        if len(ids) > 1:
            assert any(passages[k] in left[i] for i in ids)


def test_slices_of_a_batch(monkeypatch):
    rng = random.Random(2)
    batch = pa.record_batch([pa.array(range(50), pa.int64()), pa.array([words(rng, 60) for _ in range(50)]),
                             pa.array([0] * 50, pa.int64())], names=["doc_id", "text", "tid"])
    whole = [r for b in G._chunk_rows([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(G, "SLICE_BYTES", 900)
    assert [r for b in G._chunk_rows([batch]) for r in b.to_pylist()] == whole


def test_insertion_moves_no_later_cut():
    rng = random.Random(5)
    a = words(rng, 400)
    b = "new words in front " + a
    def keys(t):
        return {G.chunks(pa.array([t]))[5][16 * i:16 * i + 16] for i in range(len(G.chunks(pa.array([t]))[0]))}
    assert len(keys(a) - keys(b)) <= 3


def longest_shared(a, b):
    """Words of the longest run of consecutive chunks of ``a`` that ``b`` has as well."""
    def of(t):
        _, seq, _, _, w, digest = G.chunks(pa.array([t]))
        return [(int(w[k]), digest[16 * k:16 * k + 12]) for k in range(len(seq))]
    theirs, best, run = {k for _, k in of(b)}, 0, 0
    for w, k in of(a):
        run = run + w if k in theirs else 0
        best = max(best, run)
    return best


def test_recall_by_passage_length():
    rng, found = random.Random(17), {}
    for n in (16, 20, 25, 30, 40, 51):
        hits = 0
        for _ in range(200):
            p = words(rng, n)
            a, b = (" ".join([words(rng, rng.randint(20, 80)), p, words(rng, rng.randint(20, 80))]) for _ in range(2))
            hits += longest_shared(a, b) >= G.MIN_WORDS
        found[n] = hits / 200
    assert found[30] >= 0.85 and found[40] >= 0.97 and found[51] >= 0.99, found


def test_rows_of_one_id_are_told_apart(spark):
    rng = random.Random(23)
    p, other = words(rng, 60), words(rng, 60)
    rows = [(1, p), (5, "in front " + p), (5, other), (None, other + " end"), (None, words(rng, 40))] + [(9, p + " tail")] * 40
    docs = spark.createDataFrame(rows, "__id long, __removed string")
    got = {(r["__id"], len(r["__removed"].split())) for r in G.remove(docs, id_col="__id", text_col="__removed").collect()}
    whole = {(1, 60), (None, 61), (None, 40)}
    assert whole <= got and all(n < 20 for i, n in got - whole if i == 5 or i == 9)
    named = spark.createDataFrame([(1, p), (5, p + " x"), (5, other)], "i long, row string")
    assert {(r.i, len(r.row.split())) for r in G.remove(named, id_col="i", text_col="row").collect()} >= {(1, 60), (5, 60)}


def test_awkward_rows(spark):
    docs = table(spark)
    got = G.report(docs).collect()
    assert len(got) == len(AWKWARD)
    assert not any(r.repeated for r in got), "repeats of one doc_id, and short ones, are left alone"
    again = table(spark, [*AWKWARD, (70, AWKWARD[4][1])])
    left = G.remove(again, length_col="n_chars")
    assert left.columns == again.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted((i or 0, t or "") for i, t in AWKWARD)
    assert G.report(docs.limit(0)).count() == 0 and G.remove(docs.limit(0)).count() == 0


def test_query_finds_what_brute_force_finds(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in Q.op2_gear_chunks(spark, SF).collect()}
    assert len(got) == len(rows)
    seen = {}
    for i, t in rows:
        for w in windows(t, 60):
            seen.setdefault(w, set()).add(i)
    repeated = set().union(*[v for v in seen.values() if len(v) > 1])
    assert repeated <= {i for i, r in got.items() if r.repeated}
    grams = {}
    for i, t in rows:
        for w in windows(t, 8):
            grams.setdefault(w, set()).add(i)
    for i, t in rows:  # a document reported shares at least some run of words with another
        if got[i].repeated:
            assert any(len(grams[w]) > 1 for w in windows(t, 8)), i
