import hashlib

import pytest

from figureproof.llm import line_dedup as L
from figureproof.llm import queries as Q
from helpers import AWKWARD, table

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, min_chars=1):
    """[(doc_id, n_lines, n_dropped, kept)] of (doc_id, text) rows."""
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(line.strip(WHITE).translate(LOWER), set()).add(("text", t) if i is None else i)
    gone = {k for k, d in docs.items() if len(d) >= min_docs and len(k) >= min_chars}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(WHITE).translate(LOWER) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check(frame, rows, **kw):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in L.report(frame, **kw).collect()), key=key) == sorted(brute(rows, **kw), key=key)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.op12_line_dedup(spark, SF).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted(
        (i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows))


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_hot_and_other_keys(spark, monkeypatch, hot):
    """With few keys told apart as hot, and with all of them."""
    monkeypatch.setattr(L, "HOT", hot)
    rows = [(i, "\n".join(["  Same Line\t", f"own {i}", f"by three {i % 3}", *["twice", "twice"] * (i % 2), "", f"by nine {i % 9}", "\x0bsame LINE"]))
            for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(frame, rows)
    check(frame, rows, min_docs=3, min_chars=6)


def test_white_space_and_case_of_keys(spark):
    rows = [(i, t) for i, t in enumerate(["a ", "a", "A ", "\x0ca\r", "Ä", "ä", "a\x1c", "\n", "", "a\n\na"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (2, 3, 5):
        check(frame, rows, min_docs=n)


def test_repeated_rows_are_one_document_and_unnamed_ones_their_texts(spark):
    rows = [(1, "x\ny")] * 12 + [(None, "x\nz")] * 5 + [(None, f"x\nq{k}") for k in range(3)] + [(2, "q0\nz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(frame, rows)                 # x: documents 1 and four texts
    check(frame, rows, min_docs=5)


def test_awkward_rows(spark):
    docs = table(spark)
    check(docs, AWKWARD, min_docs=2)
    check(docs, AWKWARD)
    kept = L.remove(docs, min_docs=2)
    assert kept.columns == docs.columns
    texts = sorted((r.doc_id or -1, r.text or "", r.text is None) for r in kept.collect())
    assert texts == sorted((i or -1, k, t is None) for (i, t), (_, _, _, k) in zip(AWKWARD, brute(AWKWARD, 2)))
    assert L.report(docs.limit(0)).count() == 0 and L.remove(docs.limit(0)).count() == 0


def test_no_python(spark):
    plan = Q.op12_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
