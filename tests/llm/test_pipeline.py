import random
import re

import pytest

import corpus_pipeline as P
from figureproof.llm import best_fit, deobfuscate
from helpers import AWKWARD, table
from test_phrase_index import brute as brute_hits
from test_simhash import brute as brute_roots
from test_simhash import plain as plain_print


def words(rng, n, clean):
    return [rng.choice(clean) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted cases; labels and a benchmark."""
    rng = random.Random(11)
    clean = ["".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(4000)]
    bad = ["idiot", "stupid", "pathetic", "loser", "garbage"]
    docs, labels = {i: words(rng, rng.randint(90, 200), clean) for i in range(700)}, []
    for i in range(0, 450):
        if i % 3 == 0:
            for _ in range(3):
                docs[i].insert(rng.randint(0, len(docs[i])), rng.choice(bad))
        labels.append((i, 1, int(i % 3 == 0)))
    docs[452] = words(rng, 2500, clean)
    docs[500] = docs[451][:]                                     # an exact copy
    docs[501] = [*docs[452][:100], "changed", *docs[452][101:]]  # a near copy
    passage = words(rng, 80, clean)
    for i in (460, 510, 520):
        docs[i][30:30] = passage
    item = words(rng, 30, clean)
    docs[530][50:50] = item
    docs[540][10:10] = ["st", "1d10t", "p@thet1c", "l0ser", "you", "$tup1d"]
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(2000 + (i or 0), t) for i, t in AWKWARD[1:3]]
    spark.createDataFrame([(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, " ".join(words(rng, 30, clean)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(rows), passage


def test_stage_by_stage_against_brute_force(spark, folder):
    d, docs, passage = folder
    frames, df = [], spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in P.STAGES:
        df = P.keep(stage(spark, df, d), name)
        frames.append(df)
        if name != "packing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames[:4]]

    # toxicity: scored one by one by the same classifier
    clf = deobfuscate.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert texts[0] == {i: t for i, t in docs.items() if clf.score(t) < deobfuscate.THRESHOLD}
    assert not any(i in texts[0] for i in range(0, 450, 3)) and 540 not in texts[0]
    assert all(i in texts[0] for i in range(450) if i % 3) and all(i in texts[0] for i in range(600, 700))

    # near-duplicates: all pairs of fingerprints
    prints = {i: plain_print(t) for i, t in texts[0].items()}
    roots, least = brute_roots(prints.values(), 4), {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert texts[1] == {i: t for i, t in texts[0].items() if least[roots[prints[i]]] == i}
    assert 500 not in texts[1] and 501 not in texts[1] and 451 in texts[1] and 452 in texts[1]

    # substrings: no 50 words of a passage are left in two documents, all other texts stay
    changed = {i for i in texts[1] if texts[2].get(i) != texts[1][i]}
    held = {i for i in (460, 510, 520) if i in texts[1]}
    assert changed == held - {min(held)}
    seen = {}
    for i, t in texts[2].items():
        w = (t or "").split()
        for s in range(len(w) - 49):
            assert seen.setdefault(tuple(w[s:s + 50]), i) == i
    assert " ".join(passage) in texts[2][min(held)]
    assert all(r.n_chars == len(r.text or "") for r in frames[2].collect())

    # decontamination: every window of every item
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, *_, c in brute_hits(list(texts[2].items()), items) if c}
    assert texts[3] == {i: t for i, t in texts[2].items() if i not in bad} and 530 in bad

    # packing: the same groups packed in plain Python
    rows = frames[4].collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.bin >> 32, {}).setdefault((r.doc_id, r.copy, r.source, r.cluster), 0)
        groups[r.bin >> 32][r.doc_id, r.copy, r.source, r.cluster] += r.size
    for g, held in groups.items():
        again = best_fit.pack([{"doc_id": i, "copy": c, "source": s, "cluster": k, "size": n} for (i, c, s, k), n in held.items()],
                              best_fit.CAPACITY, g)
        assert sorted(map(repr, again)) == sorted(repr(r.asDict()) for r in rows if r.bin >> 32 == g)
    size = {}
    for r in rows:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.size
    assert size == {i: len(re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "")) for i, t in texts[3].items()}


def test_run_equals_its_stages(spark, folder):
    d = folder[0]
    df = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in P.STAGES:
        df = P.keep(stage(spark, df, d), name)
    assert sorted(map(repr, df.collect())) == sorted(map(repr, P.run(spark, d).collect()))


def test_each_stage_counts_its_survivors_on_awkward_rows(spark, folder):
    """No row is lost but for what a stage takes out: copies, and null, empty and white texts as copies of one another."""
    frames, df = {}, table(spark)
    for name, stage in P.STAGES[:4]:
        df = P.keep(stage(spark, df, folder[0]), name)
        frames[name] = sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    every = sorted((i or -1, t or "") for i, t in AWKWARD)
    # seven of the rows are left: of ids 2 and 5, of 1, 3 and 4, and of the two long rows of id 7 one each
    one_each = sorted((i or -1, t or "") for i, t in (AWKWARD[8], AWKWARD[6], AWKWARD[4], AWKWARD[7], AWKWARD[3], AWKWARD[9], AWKWARD[10]))
    assert frames["toxicity"] == every and frames["simhash"] == one_each
    # a text of white space alone repeats nothing: all stay
    assert frames["substrings"] == one_each and frames["decontamination"] == one_each


def test_stages_bear_awkward_and_empty_tables(spark, folder):
    for docs in (table(spark), table(spark).limit(0)):
        n = docs.count()
        for name, stage in P.STAGES:
            out = P.keep(stage(spark, docs, folder[0]), name)
            if name != "packing":
                assert out.count() <= n and out.columns == docs.columns
            else:
                assert out.select("doc_id", "copy").distinct().count() <= n
