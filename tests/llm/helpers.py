"""Rows that every operator must bear: nulls, empty and long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

LONG = "alpha beta gamma delta " * 4000
AWKWARD = [(5, "one two three four five six seven"), (3, None), (4, ""), (9, "ünï çødé – 漢字 and   spaces\n\nlines\t\x1c x"),
           (7, LONG), (7, LONG), (2, "one two three four five six seven"), (7, "another text of the same id"),
           (1, "   "), (None, "a text without an id"), (12, "\U0001f600 it's we'll 1234 <|endoftext|> done")]


def table(spark, rows=AWKWARD):
    """documents with the given (doc_id, text) and columns whose names clash with inner ones."""
    df = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in ("part", "block", "start", "n", "g", "key", "h", "shard", "file")})
