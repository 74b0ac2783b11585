import random
import zlib
from collections import Counter

import pytest

from figureproof.llm import queries as Q
from figureproof.llm import shards as S
from helpers import AWKWARD, table

SF = "/root/testdata/sf0.001"


def check(rows, docs, shards=8):
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    counts = Counter(r.shard for r in rows)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert sorted(counts.get(s, 0) for s in range(shards)) == sorted(S.capacities(len(docs), shards))
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def spread(rows, docs):
    """Shards over which each text's copies lie, by text."""
    crc, out = {}, {}
    for r in rows:
        out.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    return out


def least(docs, shards=8):
    cap = max(S.capacities(len(docs), shards))
    return {t: -(-n // cap) for t, n in Counter(t or "" for _, t in docs).items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_stay_together(spark, seed):
    rng = random.Random(seed)
    docs = [(i, f"own text {i}") for i in range(400)]
    for k in range(40):
        docs += [(1000 + 100 * k + j, f"group {k}") for j in range(rng.randint(2, 9))]
    docs += [(9000 + j, "the very large group") for j in range(300)]
    rows = S.assign(table(spark, docs)).collect()
    check(rows, docs)
    want = {(zlib.crc32(t.encode()), len(t.encode()) + 1): n for t, n in least(docs).items()}
    got = spread(rows, docs)
    whole = sum(len(got[k]) == n for k, n in want.items() if n == 1)
    assert whole >= 0.97 * len([n for n in want.values() if n == 1]), "many small groups were cut"
    assert len(got[zlib.crc32(b"the very large group"), 21]) <= 5


def test_only_copies(spark):
    docs = [(i, "same") for i in range(50)]
    check(S.assign(table(spark, docs)).collect(), docs)


def test_awkward_rows(spark):
    check(S.assign(table(spark)).collect(), AWKWARD)
    check(S.assign(table(spark, AWKWARD[:3])).collect(), AWKWARD[:3])
    assert S.assign(table(spark).limit(0)).count() == 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(Q.op7_balanced_shards(spark, SF).collect(), docs)
