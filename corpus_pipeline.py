"""The corpus pipeline: stages over ``documents``, each calling one operator of figureproof.llm.

1. toxicity: documents whose restored text is scored as toxic go.
2. simhash: one document of each group of near-duplicates stays.
3. substrings: a passage repeated in other documents stays in its first one; a
   document of which nothing is left goes. ``n_chars`` follows the text.
4. decontamination: documents of which benchmark windows cover a twentieth go.
5. packing: the rest is packed into training sequences; the rows are the pieces.

Each stage bears what its operator bears: null and repeated doc_ids, null, empty
and very long texts, ties, repeated rows, empty tables and further columns, with
the results that the operator's docstring states. Rows of one doc_id are told apart
by their texts; of rows equal in all columns the SimHash stage keeps one. Null and
empty texts are equal there: one such row stays. All stages but packing return the
columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from figureproof.llm import best_fit, deobfuscate, gear_chunks, phrase_index, simhash
from figureproof.llm.common import keep


#: Words that the whole chunks of a repeated passage have at least: passages of about 40 words and more are found.
SUBSTRING_WORDS = 24


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deobfuscate.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return gear_chunks.remove(docs, SUBSTRING_WORDS, length_col="n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrase_index.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.best_fit(docs)


#: (name, function): each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [("toxicity", toxicity), ("simhash", near_duplicates), ("substrings", substrings),
          ("decontamination", decontamination), ("packing", packing)]

#: Trained models, rolling hashes and packing are beyond SQL; tests/llm/test_pipeline.py checks the rows instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
