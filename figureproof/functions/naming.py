"""Name similarity between business language and physical identifiers
(F3, F4, F5).

All of it is array expressions of one row. The Ratcliff-Obershelp ratio (F5)
has no Spark built-in (``levenshtein`` is a different measure); it is an
aggregate over a stack of segments, applied to pairs whose characters in common
leave it a chance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviation expansions (token -> words).
ABBREVIATIONS = {
    "amt": "amount", "exp": "exposure", "coll": "collateral",
    "rwa": "risk weighted assets", "le": "legal entity", "cd": "code",
    "nm": "name", "rgn": "region", "asst": "asset", "cls": "class",
    "desc": "description", "snstvty": "sensitivity", "rsk": "risk",
    "fctr": "factor", "evt": "event", "typ": "type", "dt": "date",
    "fct": "fact", "calc": "calculation", "crd": "credit", "mkt": "market",
    "ops": "operational", "cpty": "counterparty", "hdg": "hedge",
    "ntnl": "notional", "ref": "reference", "depr": "deprecated", "usd": "usd",
    "id": "identifier", "avg": "average", "tot": "total", "bal": "balance",
    "qty": "quantity", "pct": "percent",
}
# Qualifiers dropped from both sides.
STOPWORDS = ["the", "of", "by", "a", "an", "in", "for", "to", "and", "total",
             "gross", "net", "adjusted", "all"]
# Version / lifecycle tokens dropped from identifiers.
NOISE_TOKENS = ["v1", "v2", "v3", "v4", "v5", "depr", "deprecated", "old",
                "legacy", "bak", "tmp", "new"]
# Fixed value: what the sequence ratio counts beside shared words.
RATIO_WEIGHT = 0.8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Lower-case tokens split on non-alphanumerics, distinct, no blanks."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), "[^a-z0-9]+"),
                                     lambda t: t != ""))


def _abbrev_map() -> Column:
    # as text: one expression to parse instead of a call per entry
    return F.expr("map(" + ", ".join(f"'{x}'" for kv in ABBREVIATIONS.items() for x in kv) + ")")


def _listed(words: list[str]) -> Column:
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def expand(toks: Column) -> Column:
    """Each token plus the words of its expansion (if any)."""
    m = _abbrev_map()
    return F.array_distinct(F.flatten(F.transform(
        toks, lambda t: F.concat(F.array(t), F.coalesce(F.split(F.element_at(m, t), " "),
                                                         F.array().cast("array<string>"))))))


def business_words(text) -> Column:
    return F.array_except(expand(tokens(text)), _listed(STOPWORDS))


def identifier_words(ident) -> Column:
    t = F.array_except(tokens(ident), _listed(NOISE_TOKENS))
    return F.array_except(expand(t), _listed(STOPWORDS))


def token_f1(a: Column, b: Column) -> Column:
    """``2 |a ∩ b| / (|a| + |b|)``; 0 when either side is empty."""
    inter = F.size(F.array_intersect(a, b))
    tot = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        2.0 * inter / tot)


def joined_sorted(words: Column) -> Column:
    return F.array_join(F.array_sort(words), " ")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _longest_block(a: Column, b: Column, seg: Column) -> Column:
    """(k, i, j): the longest equal block of a[alo, ahi) and b[blo, bhi), the
    first in ``a``, then in ``b``. ``a`` and ``b`` are arrays of characters.

    Row i of the usual table of suffix lengths comes from row i - 1; only the
    last row and the best block so far are kept.
    """
    zero = F.array_repeat(F.lit(0), seg["bhi"] - seg["blo"] + 1)
    start = F.struct(zero.alias("row"), F.lit(0).alias("k"), F.lit(0).alias("i"), F.lit(0).alias("j"))

    def step(acc, i):
        row = F.transform(F.sequence(seg["blo"], seg["bhi"] - 1), lambda j, x: F.when(
            F.get(a, i) == F.get(b, j), F.get(acc["row"], x) + 1).otherwise(F.lit(0)))
        longer = lambda r, m: F.struct(
            F.concat(F.array(F.lit(0)), r).alias("row"), F.greatest(m, acc["k"]).alias("k"),
            F.when(m > acc["k"], i - m + 1).otherwise(acc["i"]).alias("i"),
            F.when(m > acc["k"], seg["blo"] + F.array_position(r, m).cast("int") - m).otherwise(acc["j"]).alias("j"))
        return _let(row, lambda r: _let(F.array_max(r), lambda m: longer(r, m)))

    return F.aggregate(F.sequence(seg["alo"], seg["ahi"] - 1), start, step)


_SEGMENTS = "array<struct<alo:int,ahi:int,blo:int,bhi:int>>"


def _segment(alo, ahi, blo, bhi) -> Column:
    """The segment as an array of one, empty if either side is empty."""
    return F.when((alo < ahi) & (blo < bhi), F.array(F.struct(
        alo.cast("int").alias("alo"), ahi.cast("int").alias("ahi"), blo.cast("int").alias("blo"), bhi.cast("int").alias("bhi")))).otherwise(
        F.array().cast(_SEGMENTS))


def seq_ratio(a, b) -> Column:
    """Ratcliff-Obershelp ratio of two strings, 2 M / (|a| + |b|).

    M is the length of the longest common block plus, again, that of the parts
    to its left and to its right. The parts still to be looked at are a stack
    in the state of one aggregate; nothing leaves the row.
    """
    a, b = _c(a), _c(b)
    ca, cb = F.split(a, ""), F.split(b, "")
    whole = _segment(F.lit(0), F.length(a), F.lit(0), F.length(b))
    start = F.struct(whole.alias("todo"), F.lit(0).alias("m"))

    def step(acc, _):
        n = F.size(acc["todo"])

        def split(seg):
            rest = F.slice(acc["todo"], 1, n - 1)
            return _let(_longest_block(ca, cb, seg), lambda best: F.struct(
                F.when(best["k"] == 0, rest).otherwise(F.concat(
                    rest, _segment(seg["alo"], best["i"], seg["blo"], best["j"]),
                    _segment(best["i"] + best["k"], seg["ahi"], best["j"] + best["k"], seg["bhi"]))).alias("todo"),
                (acc["m"] + best["k"]).alias("m")))
        return F.when(n == 0, acc).otherwise(_let(F.element_at(acc["todo"], F.greatest(n, F.lit(1))), split))

    # every part that is looked at holds a block or ends there: at most 2 min + 1 parts
    steps = F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1)
    m = F.aggregate(steps, start, step, lambda acc: acc["m"])
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * m / total)


def letters(text) -> Column:
    """The characters of a text, each with its number among the equal ones: a
    set whose overlap with that of another text is an upper bound of the
    matched characters in ``seq_ratio``. Later occurrences come first."""
    chars = F.split(_c(text), "")
    counted = F.transform(chars, lambda c, i: F.struct(
        (-F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c))).alias("k"), c.alias("c")))
    return F.when(F.length(_c(text)) > 0, F.transform(F.array_sort(counted), lambda t: F.concat(t["c"], t["k"].cast("string")))).otherwise(
        F.array().cast("array<string>"))


def description_words(description) -> Column:
    return F.array_except(tokens(F.coalesce(_c(description), F.lit(""))), _listed(STOPWORDS))


def similarity(text, ident, description=None) -> Column:
    """F4 composite: ``max(F1, 0.8 * ratio, description F1)``; 0 when either
    side has no words. The ratio is taken only where the characters in common
    leave it a chance to be the greatest."""
    def of(w: Column) -> Column:
        bw, iw = w["bw"], w["iw"]
        words = F.greatest(token_f1(bw, iw), F.when(F.size(w["dw"]) > 0, token_f1(bw, w["dw"])).otherwise(F.lit(0.0)))

        def with_text(x: Column) -> Column:
            cap = 2.0 * F.size(F.array_intersect(letters(x["a"]), letters(x["b"]))) / (F.length(x["a"]) + F.length(x["b"]))
            return F.when(cap * RATIO_WEIGHT > x["words"], F.greatest(x["words"], seq_ratio(x["a"], x["b"]) * RATIO_WEIGHT)).otherwise(x["words"])
        return F.when((F.size(bw) == 0) | (F.size(iw) == 0), F.lit(0.0)).otherwise(_let(F.struct(
            words.alias("words"), joined_sorted(bw).alias("a"), joined_sorted(iw).alias("b")), with_text))

    described = F.array().cast("array<string>") if description is None else description_words(description)
    return _let(F.struct(business_words(text).alias("bw"), identifier_words(ident).alias("iw"), described.alias("dw")), of)
