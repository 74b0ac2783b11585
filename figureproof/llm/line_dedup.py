"""Line deduplication by document counts (operator 12), in DataFrame functions only.

Texts are split at line feeds. A line's key is the line without white space at
both ends, A-Z lower-cased; it travels as 128 bits of hash, with the line's
place and the text's identity (doc_id and 128 bits of hash of the text). The
distinct documents of each key are counted; keys of enough documents are common.
The places of common lines are gathered per text and the other lines are put
together again in their order.

A common line may stand in a third of all documents. Distinct (key, document)
pairs are spread by both, their count by key is partially aggregated, and the
join that finds the places takes hot keys apart: those with more than
1 / ``HOT`` of the pairs of common keys are fewer than ``HOT`` by definition,
so they are broadcast; the rest is joined by key and has no hot key left.

Defined results: a null or empty text is one empty line; keys shorter than
``min_chars`` always stay; rows with one doc_id are one document, rows without
an id are told apart by their texts; repeated rows stay rows, each with the same
result; a long text is one row throughout; an empty table gives no rows; other
columns are ignored, and kept by ``remove``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash128, keep, lower_ascii

MIN_DOCS = 10
MIN_CHARS = 1
#: At most so many keys are broadcast: those with more than 1 / HOT of all pairs of common keys.
HOT = 10_000
WHITE = " \t\n\x0b\x0c\r"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, t1, t2, row): the text's identity beside it, the input row as a struct."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t1, t2 = hash128(text)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), t1.alias("t1"), t2.alias("t2"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t1, t2, pos, k1, k2) of every line whose key has ``min_chars`` code points or more."""
    lines = _rows(docs, id_col, text_col).select(
        "doc_id", "t1", "t2", F.posexplode(F.split(lower_ascii(F.col("text")), "\n")).alias("pos", "line"))
    keyed = lines.withColumn("line", F.btrim("line", F.lit(WHITE))).filter(F.char_length("line") >= min_chars)
    k1, k2 = hash128(F.col("line"))
    return keyed.select("doc_id", "t1", "t2", "pos", k1.alias("k1"), k2.alias("k2"))


def common_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2, n_docs) of the keys found in at least ``min_docs`` documents."""
    unnamed = F.when(F.col("doc_id").isNull(), F.col("t1"))
    pairs = lines.select("k1", "k2", "doc_id", unnamed.alias("unnamed")).distinct()
    return pairs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def dropped_places(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, *, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, t1, t2, dropped): of each text with common lines, the places of those."""
    lines = keep(line_keys(docs, min_chars, id_col=id_col, text_col=text_col), "lines")
    common = keep(common_keys(lines, min_docs), "common-lines")
    pairs = common.agg(F.sum("n_docs")).first()[0] or 0
    is_hot = F.col("n_docs") * HOT > F.lit(pairs)
    hot = common.filter(is_hot).select("k1", "k2", F.lit(True).alias("hot"))
    rest = common.filter(~is_hot).select("k1", "k2")
    told = lines.join(F.broadcast(hot), ["k1", "k2"], "left")
    place = ["doc_id", "t1", "t2", "pos"]
    hits = told.filter("hot").select(*place).unionByName(
        told.filter("hot is null").join(rest, ["k1", "k2"], "left_semi").select(*place))
    return hits.groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("dropped"))


def _deduplicated(docs: DataFrame, min_docs: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, row, dropped, kept): every input row with the text that is left."""
    gone = dropped_places(docs, min_docs, min_chars, id_col=id_col, text_col=text_col).select(
        F.col("doc_id").alias("i"), F.col("t1").alias("h1"), F.col("t2").alias("h2"), "dropped")
    joined = _rows(docs, id_col, text_col).join(
        gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")), "left")
    # the lines are bound to a variable once, so that each place is one access
    left = F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped")), lambda i: F.get(lines, i)), "\n"))[0]
    return joined.select("doc_id", "text", "row", "dropped", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left).alias("kept"))


def report(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, *, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept (the text that is left)."""
    return _deduplicated(docs, min_docs, min_chars, id_col, text_col).select(
        "doc_id", (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), "kept")


def remove(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, *, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``docs`` with common lines taken out of every text; a text without such lines stays as it is, null included."""
    done = _deduplicated(docs, min_docs, min_chars, id_col, text_col)
    return done.select(*[(F.when(F.col("dropped").isNull(), F.col("row")[c]).otherwise(F.col("kept")) if c == text_col
                          else F.col("row")[c]).alias(c) for c in docs.columns])
