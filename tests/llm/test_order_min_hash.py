import hashlib
import re

import pytest

from figureproof.llm import order_min_hash as O
from figureproof.llm import queries as Q
from helpers import AWKWARD, table

SF = "/root/testdata/sf0.001"


def plain_bins(spark, text):
    """The definition in plain Python, with the hashes of Spark given by a lookup."""
    tokens = re.findall(r"[^ \t\n\x0b\x0c\r]{1,24}", text)
    k = O.K
    grams = [tuple(tokens[i:i + k]) for i in range(len(tokens) - k + 1)] if len(tokens) >= k else ([tuple(tokens)] if tokens else [])
    seen, out = {}, []
    for pos, g in enumerate(grams):
        out.append((g, seen.get(g, 0), pos))
        seen[g] = seen.get(g, 0) + 1
    return tokens, out


def likeness_set(a, b):
    used = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len(set(a) & set(b)) / len(used) if used else 1.0


def ring(rows):
    """[(doc_id, text, edited, next text)] in descending order of the id."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        out.append((i, t, t[:len(t) - third] + nxt[:third], nxt))
    return out


def sigs(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return {r.k: list(r.s) for r in O.signatures(df, "t", "s").collect()}


def test_query(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    want = ring([tuple(r) for r in docs.collect()])
    s = sigs(spark, [x for w in want for x in w[1:]])
    got = {r.doc_id: r for r in Q.op10_order_min_hash(spark, SF).collect()}
    assert len(got) == len(want)
    for k, (i, t, e, n) in enumerate(want):
        r, (a, b, c) = got[i], (s[3 * k + j] for j in range(3))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:010x}" for x in a) and r.edited_fingerprint == "".join(f"{x:010x}" for x in b)
        assert r.near_edited == pytest.approx(likeness_set(a, b)) and r.near_next == pytest.approx(likeness_set(a, c))
    long = [r for r in got.values() if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_signature_against_definition(spark):
    from pyspark.sql import functions as F
    text = "a b c a b c a b c d e f g " * 30 + "x y z w " * 70 + "end"
    _, grams = plain_bins(spark, text)
    rows = [(p, o, *g) for g, o, p in grams]
    mask = (1 << 37) - 1
    hashed = spark.createDataFrame(rows, "p int, o int, a string, b string, c string").select(
        "p", "o", F.xxhash64("a", "b", "c").alias("g")).collect()
    low = spark.createDataFrame([(r.p, r.g & mask, r.o) for r in hashed], "p int, g long, o int").select(
        "p", F.xxhash64("g", "o").alias("r")).collect()
    bins = {}
    for r in low:
        rank = r.r & mask
        bins.setdefault(rank >> 31, []).append((rank, r.p))
    pairs = []
    for b, es in sorted(bins.items()):
        es = sorted(sorted(es)[:O.L], key=lambda e: e[1])
        ranks = [e[0] & (1 << 31) - 1 for e in es]
        pairs.append((b, ranks[0], ranks[1] if len(ranks) > 1 else None))
    want = [b << 32 | h & (1 << 32) - 1 for b, h in spark.createDataFrame(pairs, "b long, x long, y long").select(
        "b", F.xxhash64("x", "y")).orderBy("b").collect()]
    assert sigs(spark, [text])[0] == want


def test_sensitive_to_order(spark):
    import random
    words = [f"w{i}" for i in range(600)]
    moved = words[300:] + words[:300]
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    s = sigs(spark, [" ".join(x) for x in (words, words, moved, shuffled, words[:590] + ["new"] * 10)])
    assert likeness_set(s[0], s[1]) == 1 and likeness_set(s[0], s[4]) > 0.8
    assert 0.2 < likeness_set(s[0], s[2]) < 0.8 and likeness_set(s[0], s[3]) < 0.05


def test_awkward_rows(spark):
    got = O.with_edited(table(spark)).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i, _ in AWKWARD)
    assert {tuple(r.sig) for r in got if r.doc_id in (3, 4, 1)} == {()}
    same = [tuple(r.sig) for r in got if r.doc_id in (2, 5)]
    assert same[0] == same[1] != ()
    one = O.with_edited(table(spark, [(8, "abcdef")])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert O.with_edited(table(spark).limit(0)).count() == 0
