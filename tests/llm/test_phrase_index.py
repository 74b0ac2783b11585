import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from figureproof.llm import phrase_index as P
from figureproof.llm import queries as Q
from helpers import AWKWARD, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, n=13):
    """{position: (n_words, n_hit, items)} of every document."""
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None:
            for s in range(max(1, len(w) - n + 1) if w else 0):
                windows.setdefault(tuple(w[s:s + n]), set()).add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in lengths:
            for s in range(len(w) - k + 1):
                if names := windows.get(tuple(w[s:s + k])):
                    found |= names
                    hit |= set(range(s, s + k))
        out.append((i or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=6))
def test_words_of_a_batch(texts):
    got = P.Words(pa.array(texts, pa.string())).rows()
    flat = {}
    for t, h in zip(texts, got):
        assert len(h) == len(words(t))
        for w, x in zip(words(t), h.tolist()):
            assert flat.setdefault(w, x) == x
    assert len(set(flat.values())) == len(flat)


def run(spark, docs, items, **kwargs):
    items = spark.createDataFrame(items, "item_id long, text string")
    got = P.occurrences(table(spark, docs), items, **kwargs).withColumn("c", P.contaminated()).collect()
    return sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.c) for r in got), got


@pytest.mark.parametrize("shard,block", [(200, 1 << 20), (1 << 20, 300)])
def test_small_vocabulary_equals_brute_force(spark, shard, block):
    rng = random.Random(shard)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "Ünï", "42"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 120))) for i in range(40)] + AWKWARD
    items = [(i, text(rng.choice([0, 1, 3, 4, 6, 14, 20]))) for i in range(12)] + [(3, "another text of the same id"), (77, None)]
    items.append((78, docs[5][1][10:90]))
    got, _ = run(spark, docs, items, shard_bytes=shard, block_bytes=block)
    assert got == brute(docs, items)


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    near = "zero one two three so four five six seven eight nine ten eleven twelve thirteen"
    far = "one two three so so so so four five six seven eight nine ten eleven twelve thirteen"
    _, rows = run(spark, [(1, item), (2, near), (3, far)], [(9, item)])
    assert {r.doc_id: (r.n_items, r.n_near_items) for r in rows} == {1: (1, 1), 2: (0, 1), 3: (0, 0)}


def test_empty_tables_and_removal(spark):
    docs = table(spark)
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert P.occurrences(docs.limit(0), items).count() == 0
    assert P.remove_contaminated(docs, items.limit(0)).count() == len(AWKWARD)
    left = P.remove_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == sorted(i or 0 for i, t in AWKWARD if i not in (2, 5))


def test_index_of_all_words(spark):
    index = P.build_index(table(spark), shard_bytes=100).collect()
    assert sum(sum(r.counts) for r in index) == sum(len(words(t)) for _, t in AWKWARD)


def test_query(spark):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                 for r in Q.op3_phrase_index(spark, SF).collect())
    assert got == brute(read("documents", ["doc_id", "text"]), read("benchmark", ["item_id", "text"]))
