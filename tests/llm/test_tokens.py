import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from figureproof.llm import queries as Q
from figureproof.llm.common import new_path
from figureproof.llm.encoder import Encoder
from figureproof.llm.separator_scan import count_tokens, named_counts, write_flat_files
from figureproof.llm.token_files import EliasFano, read_token_files, write_token_files
from helpers import AWKWARD, table

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(0, 9000))
def test_elias_fano_round_trip(values, more):
    v = sorted(values)
    ef = EliasFano.encode(v, (v[-1] if v else 0) + more)
    assert ef.values().tolist() == v
    assert [ef.select(i) for i in range(len(v))] == v


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_encoder_equals_library(text):
    enc = test_encoder_equals_library.__dict__.setdefault("enc", Encoder(Q._tokenizer()))
    assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'ab1é,.\u3000\xa0\x85\x1c ś漢½²\u0301"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=30))
def test_split_equals_the_pattern(text):
    import public_tokenizers
    import regex
    from figureproof.llm.encoder import split
    text = text.replace("'", "-")
    got = split(text)
    if any(unicodedata.category(c) == "Cn" for c in text):
        assert got is None
    else:
        assert got == regex.findall(public_tokenizers.PATTERN, text)


def brute(rows, end):
    enc, start, out = Encoder(Q._tokenizer()), 0, []
    for name, text in rows:
        ids = [*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op1_equals_whole_text_encoding(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r)[:4] for r in Q.op1_elias_fano(spark, SF).orderBy("doc_id").collect()]
    assert got == brute(sorted((r.doc_id, r.text) for r in rows), Q.END_ID)


def test_token_files_awkward_rows(spark):
    folder = write_token_files(table(spark), new_path(spark, "t"), Q._tokenizer(), 2, block_tokens=50)
    got = read_token_files(spark, folder, with_ids=True).orderBy("ordinal").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in AWKWARD), key=lambda i: -1 if i is None else i)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.ids[-1] == 2 for r in got)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, n) for i, _, n, _ in brute(AWKWARD, 2))


def test_token_files_empty_table(spark):
    folder = write_token_files(table(spark).limit(0), new_path(spark, "t"), Q._tokenizer(), 2)
    assert read_token_files(spark, folder).count() == 0


@pytest.mark.parametrize("block", [7, 50, 1 << 18])
def test_flat_counts(spark, block):
    folder = write_flat_files(table(spark), new_path(spark, "t"), Q._tokenizer(), Q.SEPARATOR, block_tokens=block)
    got = named_counts(spark.read.parquet(folder), Q.SEPARATOR).collect()
    enc = Encoder(Q._tokenizer(), specials_as_text=True)
    want = [(i or 0, len(enc.tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in AWKWARD]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted(want)
    assert all(r.terminated for r in got)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9))
def test_scan_of_any_flat_file(spark, ids, block):
    from figureproof.llm import separator_scan as S
    rows = [(0, k, 4, np.array(ids[at:at + block], "<u4").tobytes()) for k, at in enumerate(range(0, len(ids), block))]
    S.SCAN_GROUP, was = 3, S.SCAN_GROUP
    try:
        got = count_tokens(spark.createDataFrame(rows, "file int, block int, width int, ids binary"), 0).orderBy("ordinal").collect()
    finally:
        S.SCAN_GROUP = was
    want, start = [], 0
    for at, i in enumerate([*ids, 0]):
        if i == 0:
            if at < len(ids) or at > start:
                want.append((len(want), start, at - start, at < len(ids)))
            start = at + 1
    assert [(r.ordinal, r.start, r.n_tokens, r.terminated) for r in got] == want


def test_op4_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in Q.op4_separator_scan(spark, SF).collect()}
    assert got == {i: n - 1 for i, _, n, _ in brute([tuple(r) for r in rows], 2)}
