import random

import pytest
import xxhash
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from figureproof.llm import queries as Q
from figureproof.llm import simhash as S
from helpers import AWKWARD, table

SF = "/root/testdata/sf0.001"


def plain(text, k=4):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def brute(prints, bits):
    """{fp: least fp reachable} by comparing all pairs."""
    up = {p: p for p in prints}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a
    ps = sorted(set(prints))
    for i, a in enumerate(ps):
        for b in ps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {p: root(p) for p in ps}


def check(rows, texts, bits=4):
    prints = {i: plain(t) for i, t in texts}
    roots = brute(prints.values(), bits)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=120))
def test_fingerprint(text):
    assert S.fingerprint(text) & (1 << 64) - 1 == plain(text)


def test_hash_is_that_of_spark(spark):
    v = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0]
    assert v & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", seed=42)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_every_link_shares_a_key_whose_chain_holds(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    import numpy as np
    x = np.array([a ^ b], np.uint64)
    assert any(a & k == b & k and len(S._chain(x, np.array([c // 2]), 4)) for c, k in enumerate(S.KEYS))


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(Q.op5_simhash(spark, SF).collect(), [tuple(r) for r in rows])


@pytest.mark.parametrize("bucket", [4, 64, S.BUCKET])
def test_dense_ball_and_chains(spark, bucket):
    rng = random.Random(bucket)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(300):
        p = base
        for b in rng.sample(range(64), rng.randint(1, 4)):
            p ^= 1 << b
        prints.add(p)
    chain = rng.getrandbits(64)
    for _ in range(15):
        for b in rng.sample(range(64), 4):
            chain ^= 1 << b
        prints.add(chain)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    from figureproof.llm.components import components
    got = {r.node: r.root for r in components(S.links(df, 4, bucket)).collect()}
    signed = brute(prints, 4)
    groups = {}
    for p, r in signed.items():
        groups.setdefault(r, set()).add(p - (1 << 64) if p >> 63 else p)
    want = {p: min(g) for g in groups.values() for p in g if p != min(g)}
    assert got == want


def test_awkward_rows(spark):
    docs = table(spark)
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(AWKWARD)
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert by[(3, 0)] == by[(4, 0)] == by[(1, 0)] == 1 and {r.component_id for r in got if r.doc_id == 5} == {2}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    # one row of each component: all rows of AWKWARD that have a text of their own stay, whatever their id
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted(
        (i or -1, t or "") for i, t in [AWKWARD[8], AWKWARD[6], AWKWARD[4], *AWKWARD[7:8], AWKWARD[3], *AWKWARD[9:]])
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.keep_one(docs.limit(0)).count() == 0


def test_unlike_texts_of_one_id_all_stay(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    rows = [(i, text()) for i in (None, None, None, 7, 7, 8)]
    rows += [(9, rows[0][1]), (9, rows[0][1]), (3, rows[4][1]), (None, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, row string").withColumn("r", F.lit(1))
    got = sorted(((r.doc_id or -1, r.row) for r in S.keep_one(docs, text_col="row").collect()))
    assert got == sorted([(9, rows[0][1]), (-1, rows[1][1]), (-1, rows[2][1]), (7, rows[3][1]), (3, rows[4][1]), (8, rows[5][1])])
