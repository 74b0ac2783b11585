"""License detection by ordered signature rules (operator 9), in DataFrame functions only.

Texts are lower-cased (A-Z) and reduced to words joined by one space; all
patterns are written for that form. A rule has a keyword, a pattern, a priority
and a confidence. Only rules whose keyword a text contains are tried on it; the
rules, a few hundred, travel with the plan as constants. A match is marked in
the text, the text is split at the marks, and the words of the parts, summed up
in order, give every match's first and last word.

Of detections within one another the inner one goes; at equal intervals the one
with the lower priority, then the later rule. Containment is found in one sweep
by first word with a running maximum of the stops; base phrases always stay.

Defined results: null is the empty text; a text without words has n_words 0, no
labels and score 0; null and repeated doc_ids stay rows, told apart by 128 bits of hash
of their texts; rows equal in id and text are scanned once; long texts are scanned whole, a match is one row on its way;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NON_WORD, hash128, lower_ascii

# ---- fixed values: base phrases and their labels, as given
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# ---- end of fixed values

#: (label, keyword, pattern of the name in words).
NAMES = [
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("apache-2", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?1 1"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?1 0"),
    ("gpl-2", "general", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-3", "general", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl(?: version)? ?v?3(?: 0)?"),
    ("gpl", "general", r"gnu general public"),
    ("gpl", "gpl", r"gnu gpl"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version)? ?v?2 1"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?"),
    ("lgpl-2", "library", r"(?:gnu )?library general public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl(?: version)? ?v?3(?: 0)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("mpl-2", "mpl", r"mpl(?: version)? ?v?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?1 1"),
    ("mpl-1.1", "mpl", r"mpl(?: version)? ?v?1 1"),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("cddl-1", "cddl", r"cddl(?: version)? ?v?1(?: 0)?"),
    ("cddl-1", "common", r"common development and distribution licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("cpl-1", "common", r"common public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost-1", "boost", r"boost software licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-2", "artistic", r"artistic licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("artistic-1", "artistic", r"artistic licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("python-2", "python", r"(?:python software foundation|psf)(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: version| v)? ?1 1"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: version| v)? ?1 2"),
    ("eupl-1.2", "eupl", r"eupl(?: version)? ?v?1 2"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("odbl-1", "database", r"open (?:data commons open )?database licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creative", r"creative commons (?:zero|public domain)(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?"),
    ("gpl-2", "gplv2", r"(?:gnu )?gplv2(?: 0)?"),
    ("gpl-3", "gplv3", r"(?:gnu )?gplv3(?: 0)?"),
    ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2 1"),
    ("lgpl-3", "lgplv3", r"(?:gnu )?lgplv3(?: 0)?"),
    ("agpl-3", "agplv3", r"(?:gnu )?agplv3(?: 0)?"),
    ("mpl-2", "mplv2", r"mplv2(?: 0)?"),
    ("proprietary", "rights", r"all rights reserved"),
    ("public-domain", "domain", r"(?:in|into|to) the public domain"),
]

#: Ways of naming a license, {} being the name: (priority, confidence, pattern). Higher priority wins.
FORMS = [
    (4, 0.99, r"spdx licen[cs]e identifier {}"),
    (3, 0.95, r"(?:licen[cs]ed|released|distributed|available|provided|published|redistributed) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a )?{}(?: licen[cs]e)?"),
    (3, 0.9, r"(?:subject to|governed by|in compliance with|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}(?: licen[cs]e)?"),
    (2, 0.85, r"(?:the )?{} (?:public )?licen[cs]e(?: agreement)?"),
    (2, 0.8, r"licen[cs]e(?: is| type| name)? (?:the )?{}"),
]
#: Names that say enough by themselves, by keyword: no other use of these words is usual.
_ALONE = {"unlicense", "wtfpl", "cc0", "rights", "domain", "gpl", "gplv2", "gplv3", "lgpl", "lgplv2", "lgplv3", "agpl", "agplv3",
          "mplv2", "general", "lesser", "library", "affero", "mozilla", "eclipse", "european", "eupl", "font", "database",
          "creative", "cddl", "common", "boost", "artistic"}
BASE_PRIORITY = 5

#: Sentences of the licenses themselves and of their usual headers: (label, keyword, confidence, pattern).
SIGNATURES = [
    ("mit", "hereby", 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "hereby", 0.95, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 0.9, r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "neither", 0.9, r"neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of (?:its|the|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", 0.9, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "apache", 0.95, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-2", "redistribute", 0.95, r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3", "redistribute", 0.95, r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl", "copyleft", 0.9, r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-2.1", "redistribute", 0.95, r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3", "redistribute", 0.95, r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("agpl-3", "affero", 0.95, r"you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("mpl-2", "mozilla", 0.95, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "eclipse", 0.95, r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 2 0"),
    ("zlib", "warranty", 0.9, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost-1", "boost", 0.95, r"distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", 0.95, r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "public", 0.9, r"do what the fuck you want to public license"),
    ("cc-by", "attribution", 0.85, r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "noncommercial", 0.85, r"you may not use the material for commercial purposes"),
    ("postgresql", "postgres", 0.8, r"postgresql database management system formerly known as postgres"),
    ("python-2", "psf", 0.9, r"psf is making python available to licensee on an as is basis"),
    ("ofl-1.1", "font", 0.9, r"this font software is licensed under the sil open font license version 1 1"),
    ("proprietary", "confidential", 0.7, r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", 0.7, r"unauthorized copying of this file via any medium is strictly prohibited"),
]
SIGNATURE_PRIORITY = 4


def rules() -> list[tuple]:
    """(number, label, priority, confidence, keyword, pattern, base) of every rule, in order."""
    out = [(label, BASE_PRIORITY, 1.0, phrase.split(" ")[0] if phrase.startswith("apache") else phrase, phrase, True)
           for phrase, label in BASE]
    out += [(label, p, c, word, form.format(f"(?:{name})"), False) for p, c, form in FORMS for label, word, name in NAMES]
    out += [(label, SIGNATURE_PRIORITY, c, word, pattern, False) for label, word, c, pattern in SIGNATURES]
    out += [(label, 1, 0.6, word, name, False) for label, word, name in NAMES if word in _ALONE]
    return [(k, *r) for k, r in enumerate(out)]


_MARK, _END = "\u0001", "\u0002"


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    body = F.trim(F.regexp_replace(lower_ascii(F.coalesce("text", F.lit(""))), NON_WORD, " "))
    t1, t2 = hash128(F.coalesce("text", F.lit("")))
    return rows.select("doc_id", t1.alias("t1"), t2.alias("t2"), body.alias("body"))


def _spaces(c):
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))


def detections(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match of every rule: doc_id, t1, t2 (the text's hashes), rule, label, priority, confidence, base, start, stop (words), kept."""
    listed = rules()
    table = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"),
                               F.lit(c).alias("confidence"), F.lit(f" {word} ").alias("keyword"),
                               F.lit(f"(?<= )(?:{pattern})(?= )").alias("pattern"), F.lit(base).alias("base"))
                      for n, label, p, c, word, pattern, base in listed])
    any_word = "(?<= )(?:" + "|".join(sorted({r[4] for r in listed})) + ")(?= )"
    texts = (_words(docs, id_col, text_col).withColumn("body", F.concat(F.lit(" "), "body", F.lit(" ")))
             .filter(F.col("body").rlike(any_word)).dropDuplicates(["doc_id", "t1", "t2"]))
    tried = (texts.withColumn("r", F.explode(F.filter(table, lambda r: F.contains(F.col("body"), r["keyword"]))))
             .filter(F.rlike(F.col("body"), F.col("r.pattern"))))
    rule = ["rule", "label", "priority", "confidence", "base"]
    parts = tried.select("doc_id", "t1", "t2", *[F.col(f"r.{c}").alias(c) for c in rule], F.posexplode(F.split(
        F.regexp_replace("body", F.col("r.pattern"), F.lit(f"{_MARK}$0{_END}")), _MARK)).alias("k", "part"))
    counted = parts.select("doc_id", "t1", "t2", *rule, "k", _spaces(F.col("part")).alias("n"),
                           (_spaces(F.substring_index("part", _END, 1)) + 1).alias("w"))
    before = Window.partitionBy("doc_id", "t1", "t2", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    spans = (counted.withColumn("start", F.sum("n").over(before) - 1).filter("k > 0")
             .select("doc_id", "t1", "t2", *rule, "start", (F.col("start") + F.col("w")).alias("stop")))
    order = Window.partitionBy("doc_id", "t1", "t2").orderBy("start", F.desc("stop"), F.desc("priority"), "rule")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("stop").over(ahead)).withColumn(
        "kept", F.col("base") | F.col("reach").isNull() | (F.col("reach") < F.col("stop"))).drop("reach")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = detections(docs, id_col=id_col, text_col=text_col).filter("kept").groupBy(
        F.col("doc_id").alias("i"), F.col("t1").alias("h1"), F.col("t2").alias("h2")).agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("confidence").alias("score"))
    texts = _words(docs, id_col, text_col).select(
        "doc_id", "t1", "t2", F.when(F.col("body") == "", F.lit(0)).otherwise(_spaces(F.col("body")) + 1).cast("long").alias("n_words"))
    joined = texts.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("t1") == F.col("h1"))
                        & (F.col("t2") == F.col("h2")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
                         F.col("first_word").cast("long"), F.col("last_word").cast("long"),
                         F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                         F.coalesce("score", F.lit(0.0)).alias("score"))
