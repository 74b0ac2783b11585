import re

from figureproof.llm import license_scan as S
from figureproof.llm import queries as Q
from helpers import AWKWARD, table

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """Plain Python: all matches of all rules, containment by comparing all pairs."""
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    body, found = " " + " ".join(w) + " ", []
    for n, label, p, c, word, pattern, base in S.rules():
        if f" {word} " in body:
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", body):
                start = body[:m.start()].count(" ") - 1
                found.append((start, start + m.group().count(" ") + 1, p, n, label, c, base))
    kept = [a for a in found if a[6] or not any(
        b[0] <= a[0] and a[1] <= b[1] and ((b[0], b[1]) != (a[0], a[1]) or (b[2], -b[3]) > (a[2], -a[3])) for b in found)]
    at = []
    for phrase, label in S.BASE:
        p = phrase.split(" ")
        at += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return (len(w), len(at), min([i for i, _ in at], default=None), max([i for i, _ in at], default=None),
            ",".join(sorted({x for _, x in at})), ",".join(sorted({k[4] for k in kept})), max([k[5] for k in kept], default=0.0))


def rows(df):
    return sorted(((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
                   for r in df.collect()), key=repr)


TEXTS = [(i, t) for i, t in enumerate([
    "Licensed under the Apache License, Version 2.0. Also under the MIT license; CC BY-NC-SA 4.0 and cc-by-nc",
    "Under the MIT License under the MIT license under the mit license",
    "SPDX-License-Identifier: GPL-3.0 and the GNU Lesser General Public License version 2.1 as well",
    "This work is licensed under the GNU General Public License, version 3.",
    "cc by nc cc by nc " * 500, "permit license", "the unlicense; all rights reserved", "BSD 3-Clause License",
    "licensed under the terms of the Mozilla Public License v. 2.0", "dedicated to the public domain, CC0 1.0 Universal"], 100)]


def test_rules_are_many_and_distinct():
    listed = S.rules()
    assert len(listed) > 300 and len({r[5] for r in listed}) > 300


def test_against_brute_force(spark):
    docs = TEXTS + AWKWARD
    assert rows(S.report(table(spark, docs))) == sorted([(i or 0, *brute(t)) for i, t in docs], key=repr)


def test_labels(spark):
    got = {r.doc_id: r.labels for r in S.report(table(spark, TEXTS)).collect()}
    assert got[102] == "gpl-3,lgpl-2.1" and got[103] == "gpl-3" and got[105] == "" and got[107] == "bsd-3-clause"
    assert got[108] == "mpl-2" and got[100] == "apache-2,cc-by-nc,cc-by-nc-sa,mit"


def test_names_and_sentences_of_licenses(spark):
    texts = ["GPLv3", "GNU GENERAL PUBLIC LICENSE Version 3", "Permission is hereby granted, free of charge, to any person obtaining a copy"
             " of this software and associated documentation files (the Software)", "Redistribution and use in source and binary forms,"
             " with or without modification, are permitted provided that the following conditions are met", "a general idea of the library"]
    got = {r.doc_id: r.labels for r in S.report(table(spark, list(enumerate(texts)))).collect()}
    assert got == {0: "gpl-3", 1: "gpl-3", 2: "mit", 3: "bsd", 4: ""}


def test_unnamed_texts_are_told_apart(spark):
    got = S.report(table(spark, [(None, "under the MIT license"), (None, "nothing at all"), (3, "CC BY-NC"), (3, "plain")])).collect()
    assert sorted((r.doc_id or 0, r.n_base, r.labels) for r in got) == [(0, 0, ""), (0, 1, "mit"), (3, 0, ""), (3, 1, "cc-by-nc")]


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(Q.op9_license_scan(spark, SF)) == sorted([(i, *brute(t)) for i, t in docs], key=repr)


def test_empty_table(spark):
    assert S.report(table(spark).limit(0)).count() == 0
