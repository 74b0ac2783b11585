"""Spelling variants found by pivotal grams (operator 11).

Words of the corpus are counted per text, per task and then by a shuffle; the
rest works on the vocabulary, where each word is one row. Two words are near if
they differ by exactly one inserted, deleted or replaced code point.

All bigrams are ordered by the number of words that hold them, rarest first; a
word's prefix is its three first bigrams in this order, with all further
occurrences of the last of them. Among the prefix, dynamic programming chooses
two disjoint bigrams that are rarest in sum: the pivots. One edit destroys one pivot at
most, and of two near words the one whose prefix ends first has its surviving pivot
in the other one's prefix. So pivots are looked up in the prefix lists, and
position limits tell where: an edit at or behind the start of the right pivot leaves
all before that in place, so the left pivot is met at the same
distance from the front, after the same letters; an edit before it leaves the right pivot and all
behind it, so that one is met at the same distance from the end, before the same
letters. Two look-ups per word, an equi-join on the hash of bigram, side and these
letters; candidates are verified inside the join, none is written.

Forms point to a word at least twice as frequent, hence chains of forms end;
the roots are found by pointer doubling, in as many joins as the logarithm of the
longest chain.

Lists of common letters are long: they are cut into blocks, each joined with the
pivots of its key by itself.

The table of bigrams is broadcast: words are made of 90 different letters, so it has
8,100 rows at most.

Defined results: null and empty texts have no words; a null doc_id counts as empty in the
checksum; repeated rows count each time; a long text is processed whole, a long word is
one; of equally frequent near words the smallest is the form; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import text_slices
from .common import keep

MIN_CHARS = 5
MIN_COUNT = 3
#: A form is at least so many times as frequent as the word.
FORM_RATIO = 2
#: Runs whose checksum this number divides lose a letter (planted typing errors; 0: none).
TYPO_EVERY = 97
#: Different words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
SLICE_BYTES = 2 << 20

_RUN = re.compile(rb"[a-z\xc0-\xff]+")


def _counted(batches, min_chars: int, typo_every: int):
    held: Counter = Counter()

    def passed_on():
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                          pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for b in text_slices(batches, 1, SLICE_BYTES):
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            # one byte a code point; those beyond U+00FF are no letters here and become question marks
            counts = Counter(_RUN.findall((text or "").encode("latin-1", "replace").lower()))
            if not typo_every:
                for w, n in counts.items():
                    if len(w) >= min_chars:
                        held[w] += n
                continue
            seed = zlib.crc32(f"{'' if i is None else i}:".encode())
            for w, n in counts.items():
                h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode("utf-8"), seed)
                if h % typo_every == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1:]
                if len(w) >= min_chars:
                    held[w] += n
            if len(held) > HELD_WORDS:
                yield passed_on()
    if held:
        yield passed_on()


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo_every: int = 0, *,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of ``min_chars`` code points and ``min_count`` occurrences or more.

    Words are maximal runs of letters up to U+00FF, A-Z lower-cased.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(lambda it: _counted(it, min_chars, typo_every), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """bigram -> (rank, words that hold it), rarest first."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))
    rows = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.gram: (k, r.n) for k, r in enumerate(sorted(rows, key=lambda r: (r.n, r.gram)))}


def prefix_and_pivots(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[int], tuple[int, int]]:
    """(rank where the prefix ends, places of the prefix, places of the two pivots)."""
    grams = [order[word[p:p + 2]] for p in range(len(word) - 1)]
    last = sorted(r for r, _ in grams)[2]
    places = [p for p, (r, _) in enumerate(grams) if r <= last]
    # the least sum over one more pivot, place by place: best[j] ends at or before places[j]
    best, choice = (float("inf"), -1), None
    behind = 0
    for p in places:
        while places[behind] <= p - 2:
            best = min(best, (grams[places[behind]][1], places[behind]))
            behind += 1
        if best[1] >= 0 and (choice is None or best[0] + grams[p][1] < choice[0]):
            choice = (best[0] + grams[p][1], best[1], p)
    return last, places, choice[1:]


def _key(side: bytes, part: str) -> int:
    v = xxhash.xxh64_intdigest(side + part.encode("utf-8"))
    return v - (1 << 64) if v >> 63 else v


#: Words of one list that meet the pivots of its key in one group; longer lists are cut into such blocks.
LIST_BLOCK = 1024
#: Keys of long lists that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

_INDEX_DDL = "key bigint, pivot boolean, cut int, last int, word string, n bigint"


def _index(batches, order: dict):
    for b in batches:
        rows = []
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            last, places, (left, right) = prefix_and_pivots(word, order)
            # what stays in front of an edit at or behind the right pivot; what stays behind an edit before it
            rows.append((_key(b"<", word[:left + 2]), True, right, last, word, n))
            rows.append((_key(b">", word[right:]), True, 0, last, word, n))
            for p in places:
                rows.append((_key(b"<", word[:p + 2]), False, 0, last, word, n))
                rows.append((_key(b">", word[p:]), False, 0, last, word, n))
        if rows:
            types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                             names=["key", "pivot", "cut", "last", "word", "n"])


def near_pairs(words: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """(a, na, b, nb): every pair of words that differ by one code point, once.

    A list of more than ``block`` words is cut into blocks of about that size, each of which meets all pivots of its key.
    """
    order = gram_order(words)
    rows = words.filter(F.char_length("word") >= 4).select("word", "n")
    entries = keep(rows.mapInArrow(lambda it: _index(it, order), _INDEX_DDL), "gram-lists")
    pivots = entries.filter("pivot").select("key", "cut", F.col("last").alias("la"), F.col("word").alias("a"), F.col("n").alias("na"))
    lists = entries.filter("not pivot").select("key", F.col("last").alias("lb"), F.col("word").alias("b"), F.col("n").alias("nb"))
    long = keep(lists.groupBy("key").count().filter(F.col("count") > block)
                .select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "long-lists")
    long = F.broadcast(long) if long.count() <= BROADCAST_KEYS else long
    n = F.coalesce("blocks", F.lit(1))
    lists = lists.join(long, "key", "left").withColumn("block", F.pmod(F.xxhash64("b"), n).cast("int")).drop("blocks")
    pivots = pivots.join(long, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), n - 1))).drop("blocks")
    first = (F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))
    length = F.abs(F.char_length("a") - F.char_length("b")) <= 1
    same = F.substr("a", F.lit(1), F.col("cut")) == F.substr("b", F.lit(1), F.col("cut"))
    found = pivots.join(lists, ["key", "block"]).filter(first & length & same & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "na", "b", "nb").distinct()


def forms(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n): the most frequent near word, if ``ratio`` times as frequent."""
    pairs = keep(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("v"), F.col("nb").alias("nv")).unionByName(
        pairs.select(F.col("b").alias("w"), F.col("a").alias("v"), F.col("na").alias("nv")))
    of = both.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("nv")).alias("minus"), "v")).alias("top"))
    joined = words.join(of, F.col("word") == F.col("w"), "left")
    enough = -F.col("top.minus") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(enough, F.col("top.v")).alias("form"), F.when(enough, -F.col("top.minus")).alias("form_n"))


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO,
             typo_every: int = 0, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    if min_chars < 4:
        raise ValueError("pivots need words of at least four code points")
    words = keep(vocabulary(docs, min_chars, min_count, typo_every, id_col=id_col, text_col=text_col), "words")
    named = keep(forms(words, ratio), "forms")
    up = named.filter("form is not null").select(F.col("word").alias("w"), F.col("form").alias("root"))
    while True:
        further = up.select(F.col("w").alias("from"), F.col("root").alias("to"))
        step = up.join(further, F.col("root") == F.col("from"), "left")
        up = keep(step.select("w", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        if up.filter("moved").limit(1).count() == 0:
            break
        up = up.drop("moved")
    return named.join(up.drop("moved"), F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
