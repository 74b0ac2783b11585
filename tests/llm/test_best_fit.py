import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from figureproof.llm import best_fit as B
from figureproof.llm import queries as Q
from helpers import AWKWARD, table

SF = "/root/testdata/sf0.001"


def plain(items, capacity):
    """The definition: for each item in order look at all bins and take the tightest compatible one (the oldest of equals)."""
    bins, out = [], []
    for size, source, cluster in items:
        fit = [b for b in bins if b["free"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fit:
            b = min(fit, key=lambda b: (b["free"], b["k"]))
        else:
            b = {"free": capacity, "s": set(), "c": set(), "k": len(bins)}
            bins.append(b)
        out.append((b["k"], capacity - b["free"]))
        b["free"] -= size
        b["s"].add(source)
        b["c"].add(cluster)
    return out


ITEM = st.tuples(st.integers(0, 20), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 5)))


@settings(max_examples=200, deadline=None)
@given(st.lists(ITEM, max_size=60))
def test_bins_equal_the_definition(items):
    bins, s, c = B.Bins(20), {}, {}
    got = [bins.put(n, B._bit(s, a), B._bit(c, b)) for n, a, b in items]
    assert got == plain(items, 20)


def check(rows, sizes, capacity):
    by_bin, pieces = {}, {}
    for r in rows:
        by_bin.setdefault(r.bin, []).append(r)
        pieces.setdefault((r.doc_id or -1, r.cluster, r.copy), []).append(r)
    for rs in by_bin.values():
        assert sum(r.size for r in rs) == capacity - rs[0].free <= capacity
        spans = sorted((r.at, r.at + r.size) for r in rs)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        for c in ("source", "cluster"):
            held = [getattr(r, c) for r in rs if getattr(r, c) is not None]
            assert len(held) == len(set(held)), "two of a kind in one bin"
    got = []
    for (i, *_), rs in pieces.items():
        rs.sort(key=lambda r: r.piece)
        assert [r.start for r in rs] == [sum(x.size for x in rs[:k]) for k in range(len(rs))]
        got.append((i, sum(r.size for r in rs)))
    assert sorted(got) == sorted(sizes)


@pytest.mark.parametrize("group", [10, 8192])
def test_constraints(spark, group):
    rng = random.Random(group)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 64, 65, 300]) + [str(rng.randint(0, 60))])) for i in range(400)] + AWKWARD
    df = table(spark, docs).withColumn("source", __import__("pyspark").sql.functions.expr("case when doc_id % 3 = 0 then 'hot' when doc_id % 7 > 0 then cast(doc_id % 7 as string) end"))
    rows = B.best_fit(df, capacity=64, group_rows=group).collect()
    check(rows, [(i or -1, len((t or "").encode().split())) for i, t in docs], 64)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = Q.op6_best_fit(spark, SF).collect()
    check(rows, [(i or -1, len((t or "").encode().split())) for i, t in docs], B.CAPACITY)


def test_empty_table(spark):
    assert B.best_fit(table(spark).limit(0)).count() == 0
